"""The splitter as a table function for SQL: `FROM t, LATERAL split_text(t.text, 120, 20)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from siltstone.functions.token_count import TokenLength
from siltstone.operators.splitter import Splitter

UNITS = ("characters", "tokens")


class SplitText:
    """split_text(text, size, overlap, unit): chunk_index, content, chunk_size of each chunk.

    size and overlap (512, 51) are constants in `unit`s ('characters' or
    'tokens', 'characters' by default). Null and empty texts have no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, unit: AnalyzeArgument | None = None) -> AnalyzeResult:
        """Check what can be checked before the query runs."""
        if not isinstance(text.dataType, StringType):
            raise TypeError(f"split_text splits strings, not {text.dataType.simpleString()}")
        for name, arg, least in (("size", size, 1), ("overlap", overlap, 0)):
            if arg is not None and (not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < least):
                raise ValueError(f"{name} of split_text is a constant of {least} or more")
        if unit is not None and (not unit.isConstantExpression or unit.value not in UNITS):
            raise ValueError(f"unit of split_text is one of {', '.join(UNITS)}")
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("content", StringType()).add("chunk_size", IntegerType()))

    def __init__(self):
        self._made: dict = {}

    def eval(self, text, size=512, overlap=51, unit="characters"):
        key = (size, overlap, unit)
        if key not in self._made:
            self._made[key] = Splitter(size, overlap, length=len if unit == "characters" else TokenLength())
        s = self._made[key]
        for i, chunk in enumerate(s.split(text)):
            yield i, chunk, s.length(chunk)


def register(spark: SparkSession) -> SparkSession:
    """Let SQL of this session call split_text()."""
    spark.udtf.register("split_text", udtf(SplitText))
    return spark

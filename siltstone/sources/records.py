"""What a format parser returns, and the router that picks one by suffix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import native
from siltstone.operators.shared import bounded
from siltstone.schemas import EXTRACTED
from siltstone.sources import docx, pdf, xlsx, xml

#: Formats that are read (fixed values, as are the messages below).
SUPPORTED = (".pdf", ".docx", ".xlsx", ".xml")
#: Formats that are refused with a message of their own.
REFUSED = {
    ".iwa": "iWork format - use PDF export (Strategy B)",
    ".pages": "Pages - use PDF export",
    ".numbers": "Numbers - use PDF export",
    ".key": "Keynote - use PDF export",
}
_PARSERS = {".pdf": pdf.parse, ".docx": docx.parse, ".xlsx": xlsx.parse, ".xml": xml.parse}
#: Largest file that is read; binaryFile holds a file in memory.
MAX_FILE = 1 << 30


def route_error(suffix: Column) -> Column:
    """The message for a suffix that isn't read; null for one that is."""
    refused = F.lit(None).cast("string")
    for s, message in REFUSED.items():
        refused = F.when(suffix == s, message).otherwise(refused)
    listed = "[" + ", ".join(f"'{s}'" for s in SUPPORTED) + "]"
    unknown = F.concat(F.lit("Unsupported format: "), suffix, F.lit(f". Supported: {listed}"))
    return F.when(suffix.isin(*REFUSED), refused).when(~suffix.isin(*SUPPORTED), unknown)


def parse_bytes(content: bytes | None, suffix: str) -> dict:
    """The record of one file's bytes; any failure becomes its error."""
    try:
        if content is None:
            raise ValueError("no content")
        return {"error": None, **_PARSERS[suffix](bytes(content))}
    except Exception as e:  # noqa: BLE001  a bad file is a result, not a failure of the job
        return {"text": "", "page_count": 0, "error": f"Extraction failed: {e}", "metadata": {"format": suffix}}


@F.pandas_udf(EXTRACTED)
def _parse(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    meta = ("format", "tables_found", "sheets", "total_rows", "record_count", "record_types", "partial")
    rows = [parse_bytes(c, s) for c, s in zip(content, suffix, strict=True)]
    for r in rows:
        r["metadata"] = {k: r["metadata"].get(k) for k in meta}
    return pd.DataFrame(rows, columns=["text", "page_count", "error", "metadata"])


def extract(files: DataFrame) -> DataFrame:
    """files (path, content) as path, filename, stem, suffix, text, page_count, error, metadata.

    A null content is a file that can't be read: an error record if its suffix
    is read, like all failures. Columns other than path and content are kept.
    """
    bounded(files.sparkSession)
    suffix = native.suffix("path")
    rows = files.withColumn("suffix", suffix).withColumn("_route", route_error(F.col("suffix")))
    meta = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "format" else F.col("suffix").alias("format") for f in EXTRACTED["metadata"].dataType))
    refused = rows.where(F.col("_route").isNotNull()).withColumn("_x", F.struct(F.lit("").alias("text"), F.lit(0).alias("page_count"), F.col("_route").alias("error"), meta.alias("metadata")))
    parsed = rows.where(F.col("_route").isNull()).withColumn("_x", _parse("content", "suffix"))
    keep = [c for c in files.columns if c not in ("content", "filename", "stem", "suffix", "text", "page_count", "error", "metadata")]
    both = refused.unionByName(parsed)
    return both.select(*keep, native.filename("path").alias("filename"), native.stem("path").alias("stem"), "suffix", "_x.*")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of existing files by Spark's binaryFile source (globs and directories too). A file above MAX_FILE has a null content, so that it becomes an error record."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    path = F.regexp_replace("path", "^file:(//)?", "").alias("path")
    small = rows.where(F.col("length") <= MAX_FILE).select(path, "content")
    return small.unionByName(rows.where(F.col("length") > MAX_FILE).select(path, F.lit(None).cast("binary").alias("content")))

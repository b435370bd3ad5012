"""Times as whole numbers, for operators that compute with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(df: DataFrame, name: str) -> Column:
    """A column as long: microseconds of a timestamp (without a zone as it stands), days of a date, a whole number as it is. Others raise."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):  # not by way of the session's zone, in which hours are skipped and repeated
        since = F.col(f"`{name}`") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(f"`{name}`").cast("long")
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(f"`{name}`").cast("long")
    raise TypeError(f"{name} is {kind.simpleString()}, neither a time nor a whole number")


def columns(names) -> list[str]:
    return [f"`{n}`" for n in names]


def no_clash(*groups) -> None:
    """Raise if two of the result's columns have one name."""
    names = [n.lower() for g in groups for n in g]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns with equal names: {', '.join(twice)}; rename one side")

"""As-of join: for each left row the latest right row at or before its time, by key.

Both sides are united and sorted by key and time; the last right row is carried
along by one window, so the join is a sort and never compares pairs. Keys with
more than HOT rows are dealt by ranges of (key, time) instead, of about equal
size: each range carries within itself, and what the ranges before it carried
comes from one row a range. So a key that holds most of the rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import columns, no_clash, number
from siltstone.operators.shared import cut

#: Rows of a key above which it is dealt by ranges of time.
HOT = 100_000


def _carried(rows: DataFrame, *by: str) -> DataFrame:
    """rows with the last right row up to each in `r`."""
    w = Window.partitionBy(*by).orderBy("o", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("r", F.last("r", ignorenulls=True).over(w))


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """_carried() by key for rows of hot keys, in n ranges of (key, time)."""
    # rows of one key and time are told apart by a hash of the row, so that they can be cut, too
    dealt = cut(rows.repartitionByRange(n, "k", "o", "side", "tie", F.xxhash64("l", "r")).withColumn("p", F.spark_partition_id()))
    last = F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("o", "side", "tie")))
    ends = dealt.groupBy("k", "p").agg(last.alias("end"))
    # a range starts with one key of the range before it at most, so this has no more rows than there are ranges
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("carry", F.last("end", ignorenulls=True).over(before)).where(F.col("carry").isNotNull()).select("k", "p", "carry")
    inside = _carried(dealt.where("side is not null"), "k", "p")
    return inside.join(carry, ["k", "p"], "left").withColumn("r", F.coalesce("r", "carry")).select("k", "o", "side", "tie", "l", "r")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, take: list[str] | None = None, *, direction: str = "backward", strict: bool = False, tolerance: int | None = None, tie: list[str] | None = None, how: str = "left", hot: int = HOT) -> DataFrame:
    """left with the columns `take` of the nearest right row of the same `by`.

    on, right_on: the time columns (timestamps, dates or whole numbers).
    direction: "backward" for the latest right row at or before a left row,
    "forward" for the earliest at or after it; strict leaves equal times out.
    tolerance: the greatest distance that counts (microseconds, days or units).
    Of right rows of one key and time the one with the greatest `tie` columns
    counts, in their order (null least); without them, any. how: "left" keeps
    left rows without a match, with nulls; "inner" drops them. Rows with a null
    key or time match nothing. Left rows that repeat are kept as often. Columns
    of one name on both sides raise unless `take` leaves them out.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError("direction is backward or forward, how is left or inner")
    right_on = right_on or on
    take = [c for c in right.columns if c not in by] if take is None else take
    no_clash(left.columns, take)
    sign = 1 if direction == "backward" else -1
    lkey, rkey = F.struct(*columns(by)), F.struct(*columns(by))
    whole = lambda df, time: F.lit(True) if not by and time is None else ~F.greatest(*[F.col(c).isNull() for c in columns([*by, time])], F.lit(False))
    payload = F.struct(*columns(take), (sign * number(right, right_on)).alias("_asof"))
    kind = right.select(payload.alias("r")).schema["r"].dataType
    ties = F.struct(*columns(tie or []), F.lit(0).alias("_asof"))
    tie_kind = right.select(ties.alias("t")).schema["t"].dataType
    rows_r = right.where(whole(right, right_on)).select(rkey.alias("k"), (sign * number(right, right_on)).alias("o"), F.lit(int(strict)).alias("side"), ties.alias("tie"), F.lit(None).cast(_packed(left)).alias("l"), payload.alias("r"))
    rows_l = left.where(whole(left, on)).select(lkey.alias("k"), (sign * number(left, on)).alias("o"), F.lit(1 - int(strict)).alias("side"), F.lit(None).cast(tie_kind).alias("tie"), F.struct(*columns(left.columns)).alias("l"), F.lit(None).cast(kind).alias("r"))
    rows = rows_r.union(rows_l)
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    counts = cut(counts)
    size = counts.agg(F.count("*"), F.sum("n")).first()
    if size[0]:
        keys = F.broadcast(counts.select("k")) if size[0] <= 10_000 else counts.select("k")
        found = _carried(rows.join(keys, "k", "left_anti"), "k").unionByName(_ranged(rows.join(keys, "k", "left_semi"), -(-size[1] // hot) + 1))
    else:
        found = _carried(rows, "k")
    near = F.col("r._asof").isNotNull() if tolerance is None else F.coalesce(F.col("o") - F.col("r._asof") <= tolerance, F.lit(False))
    found = found.where(F.col("l").isNotNull()).withColumn("r", F.when(near, F.col("r")))
    if how == "inner":
        found = found.where(F.col("r").isNotNull())
    out = found.select(*(F.col(f"l.`{c}`") for c in left.columns), *(F.col(f"r.`{c}`") for c in take))
    if how == "left":
        none = left.where(~whole(left, on)).select(*columns(left.columns), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take))
        out = out.union(none)
    return out


def _packed(df: DataFrame):
    return df.select(F.struct(*columns(df.columns)).alias("l")).schema["l"].dataType

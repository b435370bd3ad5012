"""Gapless numbers over a distributed order, without one task that sees all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def numbered(df: DataFrame, order: list, within: list[str] | None = None, name: str = "idx") -> DataFrame:
    """df with a long column `name`: 0, 1, ... in `order`, anew for each value of `within`.

    Rows are dealt to ranges of (within, order) and counted by range; only
    these counts (one for each partition and group that meet, so partitions +
    groups at most) come to the driver. Groups must be few; rows need not be.
    Rows that tie in `order` get their numbers in some order, once.
    """
    within = within or []
    keys = [F.col(c) for c in within] + list(order)
    laid = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    laid = laid.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    counts = laid.groupBy("_part", *within).agg(F.count("*").alias("n"), F.min("_row").alias("_least")).collect()
    ahead: dict = {}
    rows = []
    for r in sorted(counts, key=lambda r: r["_part"]):
        g = tuple(r[c] for c in within)
        rows.append((*g, r["_part"], ahead.get(g, 0) - r["_least"]))
        ahead[g] = ahead.get(g, 0) + r["n"]
    schema = [df.schema[c] for c in within]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    cols = [pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(schema)]
    cols += [pa.array([r[-2] for r in rows], pa.int32()), pa.array([r[-1] for r in rows], pa.int64())]
    base = df.sparkSession.createDataFrame(pa.table(cols, names=[*(f"_g_{c}" for c in within), "_p", "_base"]))
    on = laid["_part"] == base["_p"]
    for c in within:
        on &= laid[c].eqNullSafe(base[f"_g_{c}"])
    joined = laid.join(F.broadcast(base), on)
    return joined.select(*df.columns, (F.col("_row") + F.col("_base")).alias(name))

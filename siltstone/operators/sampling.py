"""Stratified sampling by weight: an exact number of rows of each stratum, the same rows in any partitioning.

A row's key is an exponential variable whose rate is its weight, drawn from a
hash of the row's id; the rows with the least keys of a stratum are a weighted
sample without replacement. The threshold is found without sorting a stratum:
keys are counted by cells of their logarithm, in one aggregate that combines on
the map side; rows of cells below the threshold's are taken as they stand, and
only those of its own cell, about a hundredth of the sample, are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import columns

#: Cells for each doubling of a key.
CELLS = 64


def uniform(ids: list[str], seed: int) -> Column:
    """In (0, 1], from 52 bits of the MD5 of the ids (null is an empty text) and the seed, joined by bars."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns(ids)), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def sample(df: DataFrame, strata: list[str], n: int | DataFrame, ids: list[str], weight: str | None = None, seed: int = 0) -> DataFrame:
    """df's columns, for n rows of each stratum, or all that can be drawn if there are fewer.

    n: a number, or a table of the strata columns and n; strata that it lacks
    have none. Null is a stratum. A row's chance grows with its weight; rows of
    null, zero, negative or endless weight are never drawn. ids tell rows apart:
    rows of equal ids have equal keys, and of those at the threshold the ones
    of the least hash are taken. Another seed draws other rows.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.select(F.struct(*columns(df.columns)).alias("row"), *(F.col(c).alias(f"s{i}") for i, c in enumerate(columns(strata))), uniform(ids, seed).alias("u"), w.alias("w"))
    rows = rows.where((F.col("w") > 0) & (F.col("w") < float("inf"))).withColumn("key", -F.log("u") / F.col("w"))
    rows = rows.withColumn("cell", F.when(F.col("key") > 0, F.floor(F.log2("key") * CELLS)).otherwise(F.lit(-(1 << 20)))).drop("u", "w")
    by = [f"s{i}" for i in range(len(strata))]
    counts = rows.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    same = lambda names: [F.col(a).eqNullSafe(F.col(b)) for a, b in names]
    if isinstance(n, DataFrame):
        wanted = n.select(*(F.col(c).alias(f"t{i}") for i, c in enumerate(columns(strata))), F.col("n").alias("most"))
        counts = counts.join(wanted, same([(f"s{i}", f"t{i}") for i in range(len(strata))]) or F.lit(True)).drop(*(f"t{i}" for i in range(len(strata))))
    else:
        counts = counts.withColumn("most", F.lit(n))
    # some thousand cells a stratum at most
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("cell")) - F.col("n")
    cells = counts.withColumn("before", before).where(F.col("before") < F.col("most"))
    cells = cells.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("cell").alias("_cell"), F.when(F.col("before") + F.col("n") > F.col("most"), F.col("most") - F.col("before")).alias("rest"))
    taken = rows.join(cells, same([(c, f"_{c}") for c in by] + [("cell", "_cell")]))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("key", F.xxhash64("row"), F.to_json("row")))
    edge = taken.where(F.col("rest").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= F.col("rest"))
    return taken.where(F.col("rest").isNull()).select("row.*").union(edge.select("row.*"))

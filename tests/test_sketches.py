"""Summaries by part, merged, against exact counts."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import sketches


def test_merged_parts_are_within_the_stated_errors(spark):
    df = spark.range(120_000).select((F.col("id") % 40_000).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("v"), (F.col("id") % 11).alias("part"))
    whole = sketches.estimates(sketches.merge(sketches.summarize(df, ["g", "part"], "k", "v"), ["g"]), (0.1, 0.5, 0.9)).collect()
    rows = df.toPandas()
    assert {r.g for r in whole} == set(rows.g)
    for r in whole:
        own = rows[rows.g == r.g]
        assert r.n == len(own)
        assert abs(r["distinct"] - own.k.nunique()) <= 4 * 1.04 / 2**7 * own.k.nunique()
        values = np.sort(own.v)
        for q, x in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(np.searchsorted(values, x) / len(values) - q) < 0.04
    # generations: what was summarized before is merged with what is new, and rows that come again add no keys
    old = sketches.summarize(df.where("part < 5"), ["g"], "k", "v")
    new = sketches.summarize(df.where("part >= 5"), ["g"], "k", "v")
    again = sketches.estimates(sketches.merge(old.union(new).union(new), ["g"])).collect()
    direct = {r.g: r["distinct"] for r in sketches.estimates(sketches.summarize(df, ["g"], "k", "v")).collect()}
    assert {r.g: r["distinct"] for r in again} == direct


def test_odd_groups(spark):
    rows = [("a", None, None), ("a", None, None), ("b", "x", 1.0), (None, "x", 2.0), (None, "y", None)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = {r.g: (r.n, r["distinct"], r.quantiles) for r in sketches.estimates(sketches.merge(sketches.summarize(df, ["g"], "k", "v"), ["g"]), (0.5,)).collect()}
    assert got == {"a": (2, 0, None), "b": (1, 1, [1.0]), None: (2, 2, [2.0])}
    assert sketches.summarize(df.limit(0), ["g"], "k", "v").count() == 0

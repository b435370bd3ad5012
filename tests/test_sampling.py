"""Stratified samples: exact counts, the same rows in any partitioning, chances by weight, odd rows."""

from collections import Counter

from pyspark.sql import functions as F

from siltstone.operators import sampling


def test_counts_are_exact_and_rows_the_same(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "few").when(F.col("id") % 7 == 2, "some").alias("k"), (F.col("id") % 9).cast("double").alias("w"))
    drawn = [sorted(map(repr, sampling.sample(df.repartition(p), ["k"], 100, ["id"], "w").collect())) for p in (1, 5, 17)]
    assert drawn[0] == drawn[1] == drawn[2]
    sizes = Counter(r.k for r in sampling.sample(df, ["k"], 100, ["id"], "w").collect())
    there = {r.k: r.n for r in df.where("w > 0").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: min(100, n) for k, n in there.items()} and None in sizes and there["few"] < 100
    assert sorted(map(repr, sampling.sample(df, ["k"], 100, ["id"], "w", seed=1).collect())) != drawn[0]
    targets = spark.createDataFrame([("hot", 7), (None, 3)], "k string, n int")
    assert Counter(r.k for r in sampling.sample(df, ["k"], targets, ["id"]).collect()) == {"hot": 7, None: 3}
    whole = sampling.sample(df, [], 1000, ["id"])
    assert whole.count() == 1000 and whole.columns == df.columns


def test_chances_follow_weights(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 200, 1.0).otherwise(3.0).alias("w"))
    heavy = [sampling.sample(df, [], 40, ["id"], "w", seed=s).where("w = 3").count() for s in range(12)]
    # without replacement the heavy half has 29.4 of 40 on the average, its standard deviation over twelve draws being 0.8
    assert 27 <= sum(heavy) / len(heavy) <= 32


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", 0.0), (3, "a", -1.0), (4, "a", float("inf")), (5, "a", float("nan")), (6, "a", 2.0), (6, "a", 2.0), (6, "a", 2.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, row string, key double")  # names that are used within
    got = sampling.sample(df, ["row"], 3, ["id"], "key").collect()
    assert len(got) == 3 and {r.id for r in got} <= {6, None}
    assert sampling.sample(df, ["row"], 0, ["id"], "key").count() == 0
    assert sampling.sample(df.limit(0), ["row"], 5, ["id"], "key").count() == 0

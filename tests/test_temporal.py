"""As-of joins, spans and sessions against plain code, with hot keys dealt by ranges."""

import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import asof, intervals


def sides(seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(0, 60)] * 3 + [7] * 90)) for i in range(400)]
    right = [(key(), rng.choice([None, *range(0, 60)] * 3 + [7, 9] * 20), rng.choice([None, 1, 2, 3]), f"v{i}") for i in range(120)]
    return left + left[:3], right + [("d", 1, 1, "only right")]


def plain(left, right, forward, strict, tolerance, how):
    out = Counter()
    for i, k, t in left:
        best = None
        for rk, rt, tie, v in right:
            if k is None or t is None or rt is None or rk != k:
                continue
            d = (rt - t if forward else t - rt)
            if d < 0 or (strict and d == 0):
                continue
            rank = (-d, tie is not None, tie or 0, v)
            if best is None or rank > best[0]:
                best = rank, rt, v
        if best and tolerance is not None and -best[0][0] > tolerance:
            best = None
        if best or how == "left":
            out[i, k, t, best and best[1], best and best[2]] += 1
    return out


@pytest.mark.parametrize("hot", [10**6, 40])
@pytest.mark.parametrize("direction,strict,tolerance,how", [("backward", False, None, "left"), ("backward", True, 5, "left"), ("forward", False, None, "inner"), ("forward", True, 3, "left")])
def test_asof_by_plain_code(spark, hot, direction, strict, tolerance, how):
    a, b = sides()
    left = spark.createDataFrame(a, "i int, k string, t int").repartition(3)
    right = spark.createDataFrame(b, "k string, at int, tie int, v string").repartition(3)
    got = asof.asof_join(left, right, ["k"], "t", "at", ["at", "v"], direction=direction, strict=strict, tolerance=tolerance, tie=["tie", "v"], how=how, hot=hot)
    assert Counter(map(tuple, got.collect())) == plain(a, b, direction == "forward", strict, tolerance, how)


def test_asof_deals_a_hot_key_to_many_tasks(spark):
    left = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").alias("t"), F.lit("pad").alias("pad"))
    right = spark.range(0, 4000, 400).select(F.lit("x").alias("k"), F.col("id").alias("at"))
    rows = left.select(F.struct("k").alias("k"), F.col("t").alias("o"), F.lit(1).alias("side"), F.lit(None).cast("struct<_asof:int>").alias("tie"), F.struct("k", "t").alias("l"), F.lit(None).cast("struct<at:bigint,_asof:bigint>").alias("r"))
    n = asof._ranged(rows, 9).select(F.col("l.t").alias("t")).count()
    assert n == 4000
    got = asof.asof_join(left, right, ["k"], "t", "at", hot=500)
    assert got.where(F.col("at") == F.floor(F.col("t") / 400) * 400).count() == 4000


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", 5)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 3, 1)], "k string, t int, v int")
    with pytest.raises(ValueError):
        asof.asof_join(left, right, ["k"], "t")  # both have t
    with pytest.raises(ValueError):
        asof.asof_join(left, right, ["k"], "t", take=["v"], direction="nearest")
    with pytest.raises(TypeError):
        asof.asof_join(left.withColumn("t", F.lit("x")), right, ["k"], "t", take=["v"])
    assert asof.asof_join(left.limit(0), right, ["k"], "t", take=["v"]).count() == 0
    assert [r.v for r in asof.asof_join(left, right.limit(0), ["k"], "t", take=["v"]).collect()] == [None]
    odd = left.withColumnRenamed("i", "a.b")
    assert asof.asof_join(odd, right, ["k"], "t", take=["v"]).first()["a.b"] == 1
    assert asof.asof_join(left, right.select("t", "v"), [], "t", take=["v"]).first()["v"] == 1  # no key: one series


def spans(rng, n, long):
    out = []
    for i in range(n):
        s = rng.randint(-300, 300)
        out.append((i, rng.choice(["a", "a", "b", None]), rng.choice([s, s, s, None]), s + rng.choice([0, -5, 1, 2, 3, 17, 64, rng.randint(1, long)])))
    return out


@pytest.mark.parametrize("long", [20, 5000])
@pytest.mark.parametrize("keyed", [True, False])
def test_overlaps_by_every_pair(spark, long, keyed):
    rng = random.Random(long)
    a, b = spans(rng, 150, 20), spans(rng, 120, long)
    a += a[:4]
    left, right = spark.createDataFrame(a, "i int, k string, s long, e long"), spark.createDataFrame(b, "j int, m string, x int, y int")
    got = intervals.overlap_join(left, right, ("s", "e"), ("x", "y"), ["k"] if keyed else [], ["m"] if keyed else [])
    want = Counter((i, j) for i, k, s, e in a for j, m, x, y in b if None not in (s, e, x, y) and s < e and x < y and s < y and x < e and (not keyed or (k is not None and k == m)))
    assert Counter((r.i, r.j) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_of_times_and_of_one_table(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00"), (2, "2024-01-01 00:59:59.999999", "2024-03-01 00:00:00"), (3, "2024-01-01 01:00:00", "2024-01-01 01:00:00.000001")], "i int, s string, e string")
    a = t.select("i", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    b = t.select(F.col("i").alias("j"), F.col("s").cast("timestamp_ntz").alias("x"), F.col("e").cast("timestamp_ntz").alias("y"))
    got = intervals.overlap_join(a, b, ("s", "e"), ("x", "y"))
    assert {(r.i, r.j) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)}
    assert intervals.overlap_join(a.limit(0), b, ("s", "e"), ("x", "y")).count() == 0
    with pytest.raises(ValueError):
        intervals.overlap_join(a, a, ("s", "e"), ("s", "e"))


def test_a_long_span_is_not_spread_over_many_bins(spark):
    one = spark.createDataFrame([(0, 1 << 50)], "s long, e long")
    many = spark.range(2000).select((F.col("id") * (1 << 39)).alias("x"), (F.col("id") * (1 << 39) + 1).alias("y"))
    rows = intervals._binned(intervals._levelled(one, [], "s", "e", "a"), "a", [0, 3, 9])
    assert rows.count() <= 2
    assert intervals.overlap_join(one, many, ("s", "e"), ("x", "y")).count() == 2000


def test_few_long_spans_go_to_a_finer_level():
    assert intervals._targets({0: 50, 2: 3, 9: 1}, 100, [9, 2, 0]) == {0: 0, 2: 0, 9: 9}
    assert intervals._targets({3: 7}, 1000, [5, 3, 1]) == {3: 1}
    assert intervals._targets({}, 5, []) == {}


def test_sessions_by_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-200, 900, 1)]), rng.randint(-3, 3)) for _ in range(300)]
    got = intervals.sessions(spark.createDataFrame(rows, "k string, t int, v int").repartition(5), ["k"], "t", 10, "v")
    want = Counter()
    for k in ("a", "b", None):
        run = []
        for t, v in [*sorted((t, v) for x, t, v in rows if x == k and t is not None), (10**9, 0)]:
            if run and t - run[-1][0] > 10:
                want[k, run[0][0], run[-1][0], len(run), sum(v for _, v in run)] += 1
                run = []
            run.append((t, v))
    assert Counter((r.k, r.started, r.ended, r.n, r.total) for r in got.collect()) == want
    assert bisect.bisect([r.n for r in got.orderBy("n").collect()], 1) < got.count()

"""The vector index against exact search: recall, tiles, pruned reads, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ann

KIND = "vec_id long, embedding array<float>"


def nearest(ids, v, queries, k):
    """The k-th best cosine of each query over all vectors."""
    u = v / np.linalg.norm(v, axis=1)[:, None]
    return {q: np.sort(u @ (x / np.linalg.norm(x)))[::-1][:k] for q, x in queries}


def table(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in zip(ids if ids is not None else range(len(v)), v, strict=True)], KIND).repartition(6)


def recall(found, want):
    hit = sum(r.score >= want[r.query_id][-1] - 1e-6 for r in found)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_scores(spark, tmp_path, monkeypatch, clusters):
    monkeypatch.setattr(ann, "PART", 64)  # many tiles a list
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(clusters)
    v = rng.normal(size=(1500, 16))
    if clusters:
        v = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 1500)] * 3 + v
        v[500:1000] = v[7]  # a third of all rows is one vector
    vectors = table(spark, v)
    index = ann.load(spark, ann.build(vectors, f"{tmp_path}/ix").path)
    assert index.rows().count() == 1500
    if clusters:
        assert index.probes < len(index.centres) / 2  # clustered vectors are found in few lists
    queries = vectors.where("vec_id % 15 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = ann.search(index, vectors, queries, 10).collect()
    want = nearest(range(1500), v, [(i, v[i]) for i in range(0, 1500, 15)], 10)
    assert len(got) == 1000 and recall(got, want) >= 0.9
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert all(abs(r.score - u[r.query_id] @ u[r.id]) < 1e-5 for r in got)
    ranks = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == ranks.get(r.query_id, 0) + 1
        ranks[r.query_id] = r["rank"]
    # looking into all lists and far enough gives exact search, ties by id
    all_of = ann.search(index, vectors, queries, 10, probes=len(index.centres), depth=1500).collect()
    assert recall(all_of, want) == 1


def test_only_lists_that_are_asked_for_are_read(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(800, 8))
    vectors = table(spark, v)
    index = ann.build(vectors, f"{tmp_path}/ix")
    one = vectors.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plan = ann.search(index, vectors, one, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and any("list" in x and ("IN" in x or "INSET" in x) for x in plan.split("\n") if "PartitionFilters" in x)
    assert ann.search(index, vectors, one, 5, probes=2).first()["id"] == 3


def test_odd_rows(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(40, 4)).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 4), (None, v[0]), (5, v[6])]
    vectors = spark.createDataFrame(rows, KIND)
    index = ann.build(vectors, f"{tmp_path}/ix", lists=3)
    assert index.rows().count() == 41  # 40 and the second row of id 5
    queries = spark.createDataFrame([(1, v[1]), (2, [0.0] * 4), (3, None)], "query_id long, query array<double>")
    got = ann.search(index, vectors, queries, 3).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 3 and got[0].id == 1
    assert ann.search(index, vectors, queries, 0).count() == 0
    assert ann.search(index, vectors, queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ann.search(index, vectors, queries, -1)
    with pytest.raises(Exception, match="dimension"):
        ann.search(index, vectors, spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>"), 3).collect()
    with pytest.raises(ValueError):
        ann.build(vectors.limit(0), f"{tmp_path}/none")

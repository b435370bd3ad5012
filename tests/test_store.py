import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import half_pack, native
from siltstone.operators import embed, search
from siltstone.operators.store import VectorStore
from siltstone.plans import ingest
from siltstone.sources import samples
from siltstone.streaming.ingest import ingest_stream

META = "struct<source:string,filename:string,chunk_index:int,total_chunks:int,token_count:int,page_count:int>"


def records(spark, rows):
    df = spark.createDataFrame([(i, t, s, v) for s, (i, t, v) in enumerate(rows)], "id string, text string, seq bigint, v array<double>")
    return df.select("id", "text", F.lit(None).cast(META).alias("metadata"), half_pack.pack("v").alias("embedding"), F.size("v").alias("dimension"), native.norm("v").alias("norm"), "seq")


def test_half_agrees_with_numpy(spark):
    x = [0.0, 65519.9, 65520.0, -7e4, 2.0**-25, 1 + 2.0**-11, 1 + 3 * 2.0**-11, *np.random.default_rng(1).normal(0, 1e-5, 500).tolist(), *np.random.default_rng(2).normal(0, 9e3, 500).tolist()]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(native.half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == np.array(x).astype(np.float16).astype(float).tolist()


def test_store_round_trip(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s")
    assert s.stats()["chunk_count"] == 0
    assert s.store(records(spark, [("a", "one", [1.0, 0.0]), ("b", "two", [0.0, 1.0]), ("a", "three", [1.0, 1.0]), ("c", "no vector", None), (None, "x", [1.0, 0.0])])) == 3
    assert {r.id: r.text for r in s.chunks().collect()} == {"a": "three", "b": "two", "c": "no vector"}
    assert s.stats() == {"chunk_count": 3, "vector_count": 2, "db_path": s.path}
    assert [(r.id, round(r.score, 4)) for r in s.search([1, 0], 5).collect()] == [("a", 0.7071), ("b", 0.0)]
    s.store(records(spark, [("b", "new", [1.0, 0.0])]))
    assert [r.text for r in s.search([1, 0], 1).collect()] == ["new"]
    assert s.search([0, 0], 5).count() == 0
    assert s.delete("nope") and s.delete("a") and s.stats()["vector_count"] == 1
    s.vacuum()
    s.clear()
    assert s.stats()["chunk_count"] == 0 and s.stats()["vector_count"] == 0


def test_ties_and_limits(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0])], "ingest_seq bigint, embedding array<double>")
    assert [r.ingest_seq for r in search.topk(v, [1.0, 0.0], 5).collect()] == [1, 2]
    assert search.topk(v, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        search.topk(v, [1.0, 0.0], -1)
    with pytest.raises(Exception, match="dimension"):
        search.topk(v, [1.0], 1).collect()


def test_search_many_takes_any_number_of_queries(spark):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5 - 2)]) for i in range(9)], "ingest_seq int, embedding array<double>")
    n = 2 * search.QUERIES + 52
    rows = [(i, [float(i % 11 - 5), 1.0]) for i in range(n)]
    got = search.search_many(v, spark.createDataFrame(rows, "query_id int, query array<double>"), 2).collect()
    assert len(got) == 2 * n and {(r.query_id, r.rank) for r in got} == {(i, k) for i in range(n) for k in (1, 2)}
    best = {r.query_id: r.ingest_seq for r in got if r.rank == 1}
    for i in (0, search.QUERIES, n - 1):
        assert best[i] == search.topk(v, rows[i][1], 1).first().ingest_seq


def test_mean_pool_kernels():
    h = np.arange(12.0).reshape(1, 3, 4)
    assert embed.mean_pool(h, np.array([[1, 1, 0]])).tolist() == [[2, 3, 4, 5]]
    assert np.allclose(np.linalg.norm(embed.HashProvider()(["a b", "", "c"]), axis=1), [1, 0, 1])


def test_ingest_and_search(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(samples.pdf([["cooking pasta at home"]]))
    (tmp_path / "b.docx").write_bytes(samples.docx(["dogs bark"]))
    (tmp_path / "e.docx").write_bytes(samples.docx([" "]))
    s = VectorStore(spark, f"file://{tmp_path}/store")
    paths = [str(tmp_path / x) for x in ("b.docx", "a.pdf", "missing.xml", "e.docx", "z.key")]
    rows = ingest.ingest_paths(spark, paths, s).collect()
    assert [r.file for r in rows] == paths
    assert [r.total_chunks for r in rows] == [1, 1, 0, 0, 0] and rows[0].chunk_ids == ["b_0000"]
    assert rows[3].errors == ["No text content extracted from document"] and rows[4].errors == ["Extraction error: Keynote - use PDF export"]
    assert ingest.search_text(s, "cooking pasta", 1).first().id == "a_0000"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.docx").write_bytes(samples.docx([f"text number {i}"]))
    q = ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/ckpt", files_per_batch=2)
    q.awaitTermination(120)
    assert VectorStore(spark, f"file://{tmp_path}/store").stats()["vector_count"] == 3


def test_an_upsert_writes_no_more_than_its_rows(spark, tmp_path):
    from siltstone.operators import store as module
    from siltstone.operators.commits import Folder

    s = VectorStore(spark, f"file://{tmp_path}/s")
    many = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("text"), F.lit(None).cast(META).alias("metadata"), F.lit(None).cast("binary").alias("embedding"), F.lit(None).cast("int").alias("dimension"), F.lit(None).cast("double").alias("norm"), F.col("id").alias("seq"))
    s.store(many)
    assert len(s.compact()) == module.BUCKETS
    data = Folder(spark, f"file://{tmp_path}/s/data")
    before, base = data.size(), s.state().base.copy()
    ids = [f"k{i}" for i in range(10)]
    s.store(many.where(F.col("id").isin(ids)).withColumn("text", F.lit("new")))
    assert data.size() - before < before / 100
    before = data.size()
    touched = s.compact()
    assert 0 < len(touched) <= 10 and data.size() - before < before * (len(touched) + 3) / module.BUCKETS
    after = s.state().base
    assert {b for b in base if after[b] != base[b]} == set(touched)  # no other bucket is written
    assert s.chunks().count() == 20_000 and s.chunks().where("text = 'new'").count() == 10
    assert s.compact() == []


def test_two_writers_at_once_both_get_in(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/s"
    VectorStore(spark, path).open()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: VectorStore(spark, path).store(records(spark, [(f"w{k}-{i}", f"text {k}", [1.0, float(k)]) for i in range(5)] + [("shared", f"by {k}", [1.0, 1.0])])), range(4)))
    s = VectorStore(spark, path)
    assert s.generation() == 5 and s.stats()["vector_count"] == 21
    last = s.log.entries()[1][-1][1]["segment"]
    assert s.chunks().where("id = 'shared'").first().text == spark.read.parquet(s._at(last, "chunks")).where("id = 'shared'").first().text
    assert len({r.ingest_seq for r in s.vectors().collect()}) == 21


def test_a_number_of_the_log_is_given_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from siltstone.operators.commits import Folder, Log

    folder = Folder(spark, f"file://{tmp_path}/f")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda k: folder.publish("one", f"{k}"), range(8))) == 1
    assert folder.names().count("one") == 1 and len(folder.read("one")) == 1
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: Log(spark, f"file://{tmp_path}/log").append({"k": k}), range(16)))
    assert sorted(got) == list(range(1, 17))
    assert sorted(e["k"] for _, e in Log(spark, f"file://{tmp_path}/log").entries()[1]) == list(range(16))


def test_random_writes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    import random

    from siltstone.operators import store as module

    monkeypatch.setattr(module, "NEWER", 3)
    rng = random.Random(4)
    s, chunks, vectors, states = VectorStore(spark, f"file://{tmp_path}/s").open(), {}, {}, []
    for k in range(14):
        step = rng.choice(["store", "store", "store", "delete", "compact", "clear" if k == 8 else "store"])
        if step == "store":
            rows = [(f"i{rng.randrange(12)}", f"t{k}-{j}", rng.choice([None, [1.0, float(j)]])) for j in range(5)]
            s.store(records(spark, rows))
            for i, t, v in rows:
                chunks[i] = t
                if v:
                    vectors[i] = v
        elif step == "delete":
            gone = [f"i{rng.randrange(12)}" for _ in range(3)]
            s.delete(*gone)
            for i in gone:
                chunks.pop(i, None)
                vectors.pop(i, None)
        elif step == "compact":
            s.compact()
        else:
            s.clear()
            chunks, vectors = {}, {}
        assert {r.id: r.text for r in s.chunks().collect()} == chunks and {r.chunk_id for r in s.vectors().collect()} == set(vectors)
        states.append((s.generation(), dict(chunks)))
    for since, old in states[:: 4]:
        feed = {r.id: (r.change, r.text) for r in s.changes(since).collect()}
        new = dict(old)
        for i, (change, text) in feed.items():
            assert (change == "added") == (i not in old)
            new.pop(i, None)
            if change != "removed":
                new[i] = text
        assert new == chunks  # the feed turns the old state into the new one
    assert {r.id: r.text for r in s.chunks(states[5][0]).collect()} == states[5][1]
    s.vacuum(grace=0)
    assert {r.id: r.text for r in s.chunks().collect()} == chunks
    assert set(folder_names(s)) <= {*s.state().base.values(), *(x[1] for x in s.state().newer)}


def folder_names(s):
    from siltstone.operators.commits import Folder

    return Folder(s.spark, f"{s.path}/data").names()


def test_a_merge_that_a_clear_overtook_is_void(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s")
    s.store(records(spark, [("a", "one", [1.0, 0.0])]))
    state = s.state()
    s.compact()
    s.clear()
    entry = s.log.entries()[1]
    s.log.append({"kind": "compact", "segment": state.newer[0][1], "buckets": state.newer[0][3], "through": state.version})
    assert s.stats()["chunk_count"] == 0 and entry
    s.store(records(spark, [("b", "two", None)]))
    assert [r.id for r in s.chunks().collect()] == ["b"]

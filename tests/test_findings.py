"""Queries on small tables of their own, against their SQL."""

import contextlib
import pathlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.llm import passages, rolling, rules


@pytest.fixture
def check(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.sql(sql).write_parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
        got = entry.queries()[name](spark, str(tmp_path))
        cols = ", ".join(got.columns)
        rows = [tuple(r) for r in got.collect()]
        assert sorted(map(repr, con.sql(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall())) == sorted(map(repr, rows))
        return sorted(rows, key=repr)

    return run


def test_repeated_vectors_are_packed_each_for_itself(check):
    assert len(check("half_pack_roundtrip", embeddings="SELECT 1::BIGINT AS vec_id, unnest([[1.5, 3e-8], [2.5, 0.1, -7.0]])::FLOAT[] AS embedding")) == 5


def test_vectors_of_any_id_are_rounded(check):
    got = check("half_round", embeddings="SELECT unnest([NULL, 0, 1, 2, -1, -2, -3])::BIGINT AS vec_id, [1.5, NULL, 'NaN', '-inf', -3e-8]::FLOAT[] AS embedding")
    assert sum(h is None for _, _, h in got) == 2 * 5 + 5


def test_packed_vectors_keep_nulls_and_nan(check):
    got = check("half_pack_roundtrip", embeddings="SELECT unnest([0, NULL, 1, 2, -1, -2])::BIGINT AS vec_id, unnest([[NULL, 'NaN', '1.5'], NULL, [], [NULL]])::FLOAT[] AS embedding UNION ALL SELECT 3, [NULL, '-3e-8', 'inf']::FLOAT[] UNION ALL SELECT -1, ['NaN', '2']::FLOAT[] UNION ALL SELECT 6, NULL")
    assert sum(h is None for _, _, h in got) == 5 and sum(h is not None and h != h for _, _, h in got) == 1


def test_documents_without_text_yield_no_chunks(check):
    blank = "[NULL, '', ' \n', chr(160) || chr(8195), chr(31) || chr(133), chr(8203), ' a ']"
    got = check("ingest_failures", documents=f"SELECT i AS doc_id, t AS text FROM range(1, 9) r(i), (SELECT unnest({blank}) AS t)")
    assert sum(f is None for _, f in got) == 2 * 7 and len(got) == 8 * 7


def test_users_of_a_type_are_counted_exactly(check):
    got = check("sketch_events", events="SELECT CASE WHEN i % 3 = 0 THEN NULL ELSE 't' || i % 2 END AS event_type, CASE WHEN i % 11 > 0 THEN i % 50000 - 20000 END AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, 0.5 AS value FROM range(200000) r(i)")
    assert len(got) == 3


#: arrival in four equal ranges, of which each has a click of client 2 that moves the watermark
_CLICKS = "SELECT client_id, TIMESTAMP '2024-01-01' + to_seconds(made) AS ts, TIMESTAMP '2024-01-01' + to_seconds(arrived) AS arrived_at FROM (VALUES {}) c(client_id, made, arrived)"


def test_a_session_that_is_written_gets_no_more_clicks(check):
    # client 1's session ended at 00:30, the watermark is then 00:31, and the click of 00:02 is not late, but stands alone
    rows = "(1, 0, 0), (2, 2460, 10), (1, 120, 3000), (1, 180, 3010), (2, 2500, 3020), (1, 200, 5900), (2, 9000, 5950), (1, 210, 8000)"
    got = check("stream_click_sessions", clicks=_CLICKS.format(rows))
    assert [r[3] for r in got if r[0] == 1] == [1, 3]


def test_equal_late_clicks_are_counted_each(check):
    rows = "(1, 0, 0), (2, 7200, 10), (1, 60, 3000), (1, 60, 3000), (1, 60, 3001), (1, 7000, 3002), (2, 9000, 8000)"
    got = check("stream_late_clicks", clicks=_CLICKS.format(rows))
    assert got == [(0, 2, 0), (1, 4, 3), (2, 0, 0), (3, 1, 0)]


def test_queries_meet_vectors_in_tiles(spark, check, monkeypatch):
    import io
    from contextlib import redirect_stdout

    from pyspark.sql import functions as F

    from siltstone.operators import search

    for name, n in (("QUERIES", 2), ("PART", 50), ("AT_ONCE", 16)):
        monkeypatch.setattr(search, name, n)
    # a third of the vectors are copies of one, which tie whatever tile they lie in
    got = check("search_multi_query", embeddings="SELECT i AS vec_id, [CASE WHEN i % 3 = 0 THEN 0.3 ELSE sin(i * j) END FOR j IN range(1, 8)]::FLOAT[] AS embedding FROM range(700) r(i)")
    assert len(got) == 35
    v = spark.range(10).select(F.col("id").alias("ingest_seq"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    out = io.StringIO()
    with redirect_stdout(out):
        search.search_many(v, v.select(F.col("ingest_seq").alias("query_id"), F.col("embedding").alias("query")), 2).explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_small_files_of_much_work_are_dealt_over_tasks(spark, monkeypatch):
    from siltstone.plans import catalog

    at = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "DEALT", 20)
    monkeypatch.setattr(catalog, "FILED", 300)
    n, m = (spark.read.parquet(f"{at}/{t}.parquet").count() for t in ("part", "orders"))
    assert catalog._parts(spark, at).rdd.getNumPartitions() == -(-n // 20) > 4
    assert catalog._books(spark, at).rdd.getNumPartitions() == -(-m // 300) > 4


def test_files_reach_python_in_bounded_batches(spark):
    from siltstone.sources import records

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    for n in names:
        spark.conf.unset(n)
    files = spark.createDataFrame([("/in/a.txt", b"x")], "path string, content binary")
    assert records.extract(files).count() == 1
    assert int(spark.conf.get(names[0])) <= 1024 and int(spark.conf.get(names[1])) <= 8 << 20


def test_the_threshold_of_isolation_is_of_all_labelled_rows(spark):
    word = F.concat(F.lit("w"), ((F.col("id") * 7919 + F.col("k") * 104729) % 997).cast("string"), F.when((F.col("id") * 31 + F.col("k")) % 50 < F.col("id") % 7, "#$").otherwise(""))
    docs = spark.range(24_000, numPartitions=5).withColumn("k", F.explode(F.sequence(F.lit(0), 50 + F.col("id") % 23))).groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.collect_list(word), " ").alias("text"))
    labels = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") % 7 == 6) & (F.col("id") % 3 > 0), 0).when(F.col("id") % 101 == 0, 0).otherwise(1).alias("quality"))
    got = rules.judge(docs, labels).join(labels, "doc_id").select("anomaly", "kept", "quality").where("anomaly is not null").toPandas()
    assert len(got) == 24_000 and got.quality.nunique() == 2
    limit = rules.calibrate(got.anomaly.to_numpy(), got.quality.to_numpy() > 0)
    assert limit < 1 and ((got.anomaly < limit) == got.kept).all()
    for n, good in ((0, True), (5, True), (5, False)):
        assert rules.threshold(spark.range(n).select((F.col("id") / 10).alias("score"), F.lit(good).alias("good"))) == 2.0


def _crowded_mosaics(seed=5, passages_=3, copies=36):
    """Passages of 60 words, all 14-word slices of which stand in 36 earlier documents each, and two documents that share each passage but for six words."""
    rng = random.Random(seed)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    early, late = [], []
    for _ in range(passages_):
        p = say(60)
        early += [say(20) + p[i : i + 14] + say(20) for i in range(0, 47, 7) for _ in range(copies)]
        q = list(p)
        for i in rng.sample(range(4, 56), 6):
            q[i] = f"changed{rng.randrange(10**6)}"
        late += [say(30) + p + say(30), say(30) + q + say(30)]
    rng.shuffle(early)
    return [(i, " ".join(x)) for i, x in enumerate(early + late)], [(len(early) + 2 * k, len(early) + 2 * k + 1) for k in range(passages_)]


def test_seeds_of_many_places_meet_their_first_holder(spark):
    rows, pairs = _crowded_mosaics()
    found = [sorted(map(tuple, passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())) for parts in (1, 3)]
    assert found[0] == found[1]
    assert all(any(r[0] == b and r[3] == a for r in found[0]) for a, b in pairs)


def test_equal_passages_of_many_documents_name_the_first(spark):
    rng = random.Random(6)
    shared = " ".join(f"s{k}" for k in range(55))
    rows = [(i, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(9))} {shared}") for i in range(60)]
    for parts in (1, 4):
        got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.other_id) for r in got) == [(i, 0) for i in range(1, 60)]


def test_slices_follow_the_points_of_each_series_and_hour(spark, monkeypatch):
    monkeypatch.setattr(rolling, "SLICE", 40)
    monkeypatch.setattr(rolling, "DENSE", 60)
    monkeypatch.setattr(rolling, "PARTS", 8)
    rng = random.Random(8)
    # one busy series among many of few points, with a burst in two hours, and nothing before, between and behind some of its hours
    rows = [("busy", 800 * rng.randrange(-9, 9) + rng.randrange(800), rng.choice([None, *range(9)])) for _ in range(500)]
    rows += [("busy", 4000 + rng.randrange(1000), rng.randrange(9)) for _ in range(300)] + [("busy", 90_000 + rng.randrange(1500), 1) for _ in range(90)]
    rows += [(f"s{k}", rng.randrange(4000), k) for k in range(60) for _ in range(3)] + [(None, 4000 + k, k) for k in range(70)]
    points = spark.createDataFrame(rows, "kind string, us long, c long").repartition(5)
    for sent in (rolling.SENT, 0):
        monkeypatch.setattr(rolling, "SENT", sent)
        got = rolling.rolling(points, "kind", "us", "c", 800)
        want = []
        for s, t in {r[:2] for r in rows}:
            v = sorted(x for a, b, x in rows if a == s and t - 800 < b <= t and x is not None)
            m = v[(len(v) - 1) // 2] + v[len(v) // 2] if len(v) > 1 else None
            d = sorted(abs(2 * x - m) for x in v) if len(v) > 1 else None
            want.append((s, t, len(v), m, d and d[(len(v) - 1) // 2] + d[len(v) // 2]))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_busy_series_is_many_tasks(spark):
    points = spark.range(150_000).select(F.when(F.col("id") % 3 > 0, F.lit("busy")).otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("kind"), (F.col("id") * 10_000).alias("us"), (F.col("id") % 91).alias("c"))
    slices = rolling.dealt(points, "kind", "us", "c", 3_600_000).groupBy("s", "fine", "slice").count()
    assert slices.agg(F.max("count")).first()[0] < 2 * rolling.SLICE


def test_tokens_are_counted_by_words_and_known_words_once(monkeypatch):
    """a split counted every word of a text anew at each of its levels."""
    from siltstone.functions import token_count
    from siltstone.functions.token_count import TokenLength

    plain = token_count.encoding().encode_ordinary
    parts = ["the", "of", "it's", "'s", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", ".", " .", ". ", "é", "漢字", "12", "!", "\r\n", "​", "😀", ""]
    rng = random.Random(5)
    count = TokenLength()
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))
        n = len(plain(text))
        assert count(text) == n, text
        (some,) = count.many([text], 6)
        assert some == n or (n > 6 and some > 6), text

    encoded = []

    class Encoding:
        def encode_ordinary(self, text):
            encoded.append(text)
            return plain(text)

    monkeypatch.setattr(token_count, "encoding", lambda name: Encoding())
    text = "words that recur " * 500 + "end"
    assert count(text) == count(text) == len(plain(text))
    assert count.many([text], 100) == [101]  # far more than a chunk holds: nothing is encoded
    assert len(encoded) <= 8 and sum(map(len, encoded[-1:])) < 20


def test_known_words_cost_a_batch_nothing():
    """each batch of texts was compared with all the words known so far, up to 200,000."""
    from siltstone.operators.embed import HashProvider

    class Known(dict):
        def keys(self):
            raise AssertionError("all known words are gone through")

    p = HashProvider()
    p._known = Known()
    v = p(["The cat cat", "", "a cat"])
    assert (v == HashProvider()(["the cat CAT", "", "a  cat"])).all() and abs((v[0] ** 2).sum() - 1) < 1e-12 and not v[1].any()


def test_a_worker_keeps_words_from_task_to_task():
    """each task learned all its words anew."""
    import pickle

    from siltstone.functions.token_count import TokenLength
    from siltstone.operators.embed import HashProvider

    HashProvider()(["keptword"])
    assert "keptword" in pickle.loads(pickle.dumps(HashProvider()))._known
    TokenLength()("a keptword b")
    assert "keptword" in pickle.loads(pickle.dumps(TokenLength()))._known


@pytest.mark.parametrize("probes, depth", [(12, 5), (3, 5), (1, 40), (12, 500)])
def test_a_tile_of_the_index_keeps_the_best_of_each_query(monkeypatch, probes, depth):
    """`depth` rows of each query and list left a tile, which grows as the power 1.5 of the vectors."""
    import numpy as np

    from siltstone.operators import ann

    monkeypatch.setattr(ann, "AT_ONCE", 16)
    rng = np.random.default_rng(2)
    q, centres = (rng.standard_normal((n, 6)).astype(np.float32) for n in (30, 12))
    own, code, step = np.sort(rng.integers(0, 12, 300)), rng.integers(-127, 128, (300, 6)).astype(np.int8), rng.random(6).astype(np.float32) / 100
    a, b, near = ann._ranked(q, own, code, centres, step, probes, depth)
    exact = q @ (centres[own] + code * step).T
    looks = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
    for i in range(len(q)):
        there = np.flatnonzero(np.isin(own, looks[i]))
        assert b[a == i].tolist() == there[np.argsort(-exact[i, there], kind="stable")][:depth].tolist()
    assert np.allclose(near, exact[a, b], atol=1e-5)


def test_only_stretches_that_can_repeat_are_joined(spark):
    """op5: of documents without repeated words no stretch of 50 words is sent anywhere; equal stretches have equal anchors."""
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    h[520:600] = h[100:180]
    first = np.array([0, 20, 300, 300, 700])
    own, at, anchor = [], [], []
    for a, t, w, n in zip(*(x.tolist() for x in passages.anchors(h, first, 50)), strict=True):
        own += [t] * n
        at += range(w, w + n)
        anchor += [a] * n
    spans = passages.spans(h, first, 50)
    assert own == spans[1].tolist() and at == spans[2].tolist() and len(set(anchor)) < len(anchor) / 5
    of: dict = {}
    assert all(of.setdefault(s, a) == a for s, a in zip(spans[0].tolist(), anchor, strict=True)) and len(of) == len(anchor) - 31

    rows = [(d, " ".join(f"w{d}x{k}" for k in range(200))) for d in range(40)]
    rows[30] = (30, rows[30][1] + " " + " ".join(rows[3][1].split()[60:130]))
    keyed = spark.createDataFrame(rows, "_id long, text string").repartition(3)
    _, ranges, _ = passages._matches(keyed, 50, 4)
    got = {r.doc: np.frombuffer(r.ranges, "<u4").reshape(-1, 2) for r in ranges.collect()}
    assert set(got) == {3, 30}
    for d, begin in ((3, 60), (30, 200)):  # all 21 stretches of the 70 words, and few others
        assert set(range(begin, begin + 21)) <= {k for a, b in got[d].tolist() for k in range(a, b)} <= set(range(begin - 24, begin + 45))


def test_chains_need_one_python_worker_a_task(spark, monkeypatch):
    """pipeline: what a chain of Python operators in one stage starts as workers stays in the executor's memory."""
    plans, with_words = [], passages._with_words

    def spy(keyed, found, width):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return with_words(keyed, found, width)

    monkeypatch.setattr(passages, "_with_words", spy)
    rows, _ = _crowded_mosaics(passages_=3, copies=2)
    assert passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).count()
    assert len(plans) == 3
    for plan in plans:
        steps = [w for w in ("MapInArrow" if "MapInArrow" in line else "Exchange" if "Exchange" in line else "" for line in plan.splitlines()) if w]
        assert all((a, b) != ("MapInArrow", "MapInArrow") for a, b in zip(steps, steps[1:]))


def _mosaics_of_three(changed=6, passages_=4):
    """Passages of five slices of 14 words, of which every three neighbours stand twice in earlier documents, and two documents that share each passage but for some words."""
    rng = random.Random(9)
    say = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    early, late = [], []
    for _ in range(passages_):
        p = say(70)
        early += [say(20) + p[i : i + 42] + say(20) for i in (0, 14, 28) for _ in range(2)]
        q = list(p)
        for i in range(5, 70, 70 // changed):
            q[i] = f"changed{rng.randrange(10**6)}"
        late += [say(30) + p + say(30), say(30) + q + say(30)]
    rng.shuffle(early)
    return [(i, " ".join(x)) for i, x in enumerate(early + late)], [(len(early) + 2 * k, len(early) + 2 * k + 1) for k in range(passages_)]


def test_seeds_of_few_places_meet_all_their_holders(spark):
    """op5, pipeline: neither seeds nor the places where two slices meet occur first in the document that shares the passage."""
    rows, pairs = _mosaics_of_three()
    found = [sorted(map(tuple, passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())) for parts in (1, 5)]
    assert found[0] == found[1]
    assert all(any(r[0] == b and r[3] == a and r[2] - r[1] >= 60 for r in found[0]) for a, b in pairs)


def test_other_holders_are_all_but_the_first():
    rng = np.random.default_rng(3)
    h, doc, at = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(0, 9, 300), np.arange(300)
    hot, want = np.array([3, 7], np.uint64), set()
    for s in set(h.tolist()) - {3, 7}:
        i = np.flatnonzero(h == s)
        if 1 < len(i) <= 8:
            first = {d: int(at[i][doc[i] == d].min()) for d in doc[i].tolist()}
            want |= {(int(doc[k]), d, int(at[k]), p) for k in i for d, p in first.items() if min(first) < d < doc[k]}
    got = list(zip(*(x.tolist() for x in passages.other_holders(h, doc, at, 8, hot)), strict=True))
    assert len(got) == len(want) > 50 and set(got) == want


def test_copies_are_not_joined_word_by_word(spark, monkeypatch):
    """op5, pipeline: what is written between steps follows the different texts; a copy is one row, and no text counts as less for its capitals."""
    sizes, drop = [], passages.drop_path
    monkeypatch.setattr(passages, "drop_path", lambda s, path: (sizes.append(sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet"))), drop(s, path)))
    rng = random.Random(4)
    texts = [" ".join(f"W {rng.randrange(10**7)}" for _ in range(600)) for _ in range(30)]
    rows = [(100 * k + i, t) for k in range(6) for i, t in enumerate([*texts, "a few words", None])]
    got = sorted(map(tuple, passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == [(100 * k + i, 0, 1200, i, 0, 1200, 1200) for k in range(1, 6) for i in range(30)]
    assert sum(sizes) < sum(map(len, texts))


@pytest.mark.parametrize("sent", [0, 200_000])
def test_copies_and_their_passages_by_either_join(spark, monkeypatch, sent):
    monkeypatch.setattr(passages, "SENT", sent)
    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(9, say("x", 70)), (3, say("x", 70)), (5, f"{say('y', 9)} {say('x', 70)}"), (7, say("z", 80)), (8, say("z", 80)), (8, say("z", 80)), (None, say("z", 80)), (11, say("q", 49)), (12, say("q", 49))]
    got = sorted((r.doc_id, r.start, r.stop, r.other_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == [(5, 9, 79, 3), (7, 0, 80, None), (8, 0, 80, None), (9, 0, 70, 3)]


def test_seeds_are_shuffled_in_turns(spark):
    """op5, pipeline: no stage holds the places of all seeds on disk at once."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(2000))) for i in range(60)]
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    assert passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    written = []
    for k in range(first, sc.dagScheduler().nextStageId()):
        with contextlib.suppress(Exception):
            written.append(sc.statusStore().lastStageAttempt(k).shuffleWriteBytes())
    assert len(written) > 5 and 0 < max(written) < 0.8 * sum(len(t) for _, t in rows)

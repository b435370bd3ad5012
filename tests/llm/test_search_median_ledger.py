"""Operators 11 to 13 against plain code: odd rows, ties, repeats, clashing columns, cut limits."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, ledger, lexical, rolling

SCHEMA = "doc_id long, text string, n long, terms string, blob string, found int, score double"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["Zeta", "zETA", "x" * 700, "x" * 699 + "y"]
    say = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=n))
    rows = [say(rng.randint(1, 90)) for _ in range(150)] + ["same words here"] * 12 + [None, "", " \n!? ", "zeta", say(20_000), "Ünï-ço_é zeta"]
    rows += ['token = "abcdef12" password: short', "Password='hunter2xyz' AKIA" + "B" * 16 + " " + "0a" * 12, "AKIA" + "C" * 15 + " token: token: abcdefg", "Ünï " + "f" * 24 + "g", "ſecret=abcdefgh API_KEY:abcdef apiKEY=abcdefg", "-----BEGIN RSA PRIVATE KEY-----"] * 2
    table = [(i, t, 1, "clash", "clash", 2, 0.5) for i, t in enumerate(rows)]
    return spark.createDataFrame([*table, table[5], table[5], (None, rows[5], 1, "", "", 1, 1.0), (None, "zeta zeta", 1, "", "", 1, 1.0)], SCHEMA).repartition(5).cache()


def best(docs, items, k):
    n, tf, df = [], [], Counter()
    for _, t in docs:
        w = TERM.findall(low(t))
        n.append(len(w))
        tf.append(Counter(w))
        df.update(set(w))
    many, total = sum(x > 0 for x in n), sum(n)
    by = defaultdict(set)
    for i, t in items:
        by[i] |= set(TERM.findall(low(t)))
    out = []
    for i, terms in by.items():
        found = []
        for (d, _), size, f in zip(docs, n, tf, strict=True):
            if s := sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * f[t] // (1000 * f[t] + 8 * (10 + 90 * size * many // total))) for t in terms if f[t]):
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block,shard,k", [(200_000, 4_000_000, 10), (40, 300, 3)])
def test_search_by_every_score(spark, docs, monkeypatch, block, shard, k):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHARD", shard)
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(i, " ".join(rng.choices((rows[rng.randrange(150)][1] or "").split() or ["a"], k=rng.randint(1, 30)))) for i in range(25)] + [(90, None), (91, "!!"), (92, "nowhere"), (93, "zeta ZETA"), (93, "same"), (None, "here same"), (94, "x" * 700), (94, "x" * 700)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lexical.ranked(docs, bench, k).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == best(rows, items, k)


def test_search_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), bench).count() == 0
    assert lexical.ranked(docs, bench.limit(0)).count() == 0


def test_terms_are_compared_by_bytes():
    # parity words: sums over their letters agree for any base
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024)).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    t = lexical.Terms([a, b"other"])
    data = np.frombuffer(b + b" " + a, np.uint8)
    word, term = t.find(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert word.tolist() == [1] and term.tolist() == [0]
    t.hash[:] = t.hash[0]  # all hashes alike: bytes still decide
    assert lexical.Terms([a, b]).find(data, np.array([0, 1025]), np.array([1024, 2049]))[1].tolist() == [1, 0]


def test_scores_beyond_64_bits():
    n = np.array([10**7, 3], np.int64)
    assert lexical._ratio(n, 10**11, 10**12).tolist() == [90 * 10**11 * x // 10**12 for x in n.tolist()]


def windows(rows, reach):
    """n, median2, spread4 of every (series, time)."""
    out = {}
    for s, t, _ in rows:
        if t is None:
            continue
        v = sorted(x for a, b, x in rows if a == s and b is not None and t - reach < b <= t and x is not None)
        n, m, d = len(v), None, None
        if n > 1:
            m = v[(n - 1) // 2] + v[n // 2]
            far = sorted(abs(2 * x - m) for x in v)
            d = far[(n - 1) // 2] + far[n // 2]
        out[s, t] = (s, t, n, m, d)
    return Counter(out.values())


@pytest.mark.parametrize("slice_,wide,spread,dense", [(20_000, 40_000, 1000, 100_000), (5, 3000, 7, 100_000), (50, 60, 1 << 57, 100_000), (50, 3000, 40, 8), (50, 900, 5, 1)])
def test_medians_by_sorting_every_window(spark, monkeypatch, slice_, wide, spread, dense):
    monkeypatch.setattr(rolling, "SLICE", slice_)
    monkeypatch.setattr(rolling, "DENSE", dense)  # few: slices shorter than a window
    monkeypatch.setattr(rolling, "WINDOWS", 64)
    rng = random.Random(slice_)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(-wide, wide), rng.choice([None, 0, rng.randint(-spread, spread)])) for _ in range(500)]
    rows += [("hot", 77, 5)] * 300 + [("hot", 78, rng.randint(0, 3)) for _ in range(99)] + [("one", 1, 4), ("none", 1, None), ("gone", None, 3)]
    points = spark.createDataFrame(rows, "kind string, us long, c long").repartition(7)
    got = rolling.rolling(points, "kind", "us", "c", 500).collect()
    assert Counter(map(tuple, got)) == windows(rows, 500)


def test_clicks_with_odd_rows(spark):
    at = "2024-01-01 00:00:00"
    rows = [(1, at, "a", 1.005, 9), (1, at, "a", 1.005, 9), (2, at, "a", -0.005, 1), (3, "2024-01-01 00:59:59.999999", "a", 2.0, 1), (4, "2024-01-01 01:00:00", "a", None, 1), (5, None, "a", 3.0, 1), (5, at, "b", 3.0, 1), (6, at, None, float("nan"), 1), (7, at, None, 1e300, 1), (None, at, None, 4.0, 1), (None, at, None, 4.0, 1)]
    clicks = spark.createDataFrame(rows, "click_id long, ts string, kind string, value double, n int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.click_id: r for r in rolling.op12(clicks).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
    cents = sorted([math.floor(100 * 1.005 + 0.5), math.floor(100 * -0.005 + 0.5)])
    assert (got[1].n, got[1].median2) == (2, sum(cents)) and got[2].mad4 == 2 * abs(cents[1] - cents[0])
    assert got[3].n == 3 and got[4].n == 1 and got[4].far is None and got[4].median2 is None
    assert got[6].n == got[7].n == 1 and got[5].kind == "b"
    assert rolling.op12(clicks.limit(0)).count() == 0


def expected(text):
    """All spans by start and kind, each kind's matches left to right."""
    out = []
    for o, (kind, p, group, least) in enumerate([("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), o, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "", re.A) if len(m[group]) >= least]
    return [x for *_, x in sorted(out)]


def test_secrets_by_plain_patterns(spark, docs):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in ledger.op13(docs).collect())
    want = Counter()
    for r in docs.collect():
        s = expected(r.text)
        want[r.doc_id, *(sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert got == want
    assert "pem:0:31" in {r.spans for r in ledger.op13(docs).collect()}
    assert ledger.op13(docs.limit(0)).count() == 0


def test_ledger_scans_each_pair_once(spark, docs):
    path = common.new_path(spark, "ledger-test")
    size = lambda: spark.read.parquet(path).select(F.explode("versions")).count()
    blobs = docs.select(ledger.blob(F.col("text"))).distinct().count()
    old = (ledger.BASE[0], ledger.BASE[2])
    ledger.scan(docs, path, old)
    assert size() == 2 * blobs
    ledger.scan(docs, path, old)
    assert size() == 2 * blobs  # nothing is new
    ledger.scan(docs.union(docs).withColumn("doc_id", F.col("doc_id") + 1000), path, old)
    assert size() == 2 * blobs  # other places, the same blobs
    more = docs.select("doc_id", F.concat("text", F.lit(" v2")).alias("text")).where("doc_id < 10")
    ledger.scan(more, path, old)
    assert size() == 2 * blobs + 2 * 10
    ledger.scan(docs, path, (*old, ledger.BASE[1]))
    assert size() == 3 * blobs + 2 * 10  # one rule more is run alone
    changed = ledger.Rule("hex", "[0-9a-f]{30,}")
    ledger.scan(docs, path, (changed,))
    assert size() == 4 * blobs + 2 * 10
    by = lambda rules: {(r.doc_id, r.blob): {(f["kind"], f["start"], f["end"]) for f in r.found} for r in ledger.findings(docs, path, rules).collect()}
    assert by(ledger.BASE) == {k: {f for f in v if f[0] in ("assign", "access", "hex")} for k, v in by((*old, ledger.BASE[1])).items()}
    assert all(e - s >= 30 for v in by((changed,)).values() for _, s, e in v)
    assert ledger.findings(docs, path).count() == docs.count()

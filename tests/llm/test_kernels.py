import itertools
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import common, minhash, ordinal, packing, passages, rules, shards, sstable, suffixes, tokens

TEXT = st.text(alphabet="abcA \n\t.é<|>#'", max_size=80)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_hashes(texts):
    data, offs = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = common.runs(data, offs, common.SPACES)
    got = [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in itertools.pairwise(first)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = common.hashes(data, starts, ends)
    flat = [w for x in got for w in x]
    assert len(set(h.tolist())) == len(set(flat))
    one, back = common.distinct(h)
    assert (h[one][back] == h).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_statistics(texts):
    data, offs = common.text_bytes(pa.array(texts))
    got = np.column_stack(rules.statistics(data, offs)).tolist()
    for t, row in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert row == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), TEXT), min_size=1, max_size=6))
def test_encoder_equals_library(texts):
    e = tokens.encoder(tokens.vocabulary())
    ids, first = e.batch(pa.array(texts, pa.string()))
    for t, i, j in zip(texts, first, first[1:], strict=False):
        assert ids[i:j].tolist() == e.full.encode(t or "", add_special_tokens=False).ids


def test_encoder_memory_is_bounded():
    """A worker's own memory after a million distinct words, imports included."""
    code = """
import re, numpy as np, pyarrow as pa, pyspark.sql
from siltstone.llm import tokens
own = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
e, rng, most = tokens.encoder(tokens.vocabulary()), np.random.default_rng(0), 0
for _ in range(8):
    w = rng.integers(97, 123, (125_000, 8)).astype(np.uint8)
    w[:, 7] = 32
    e.batch(pa.array([x.tobytes().decode() for x in np.split(w, 50)] + [w.tobytes().decode()]))
    most = max(most, own())
print(most)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert int(out.stdout.split()[-1]) < 220


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(500, 4000), min_size=1, max_size=8), st.integers(256, 1024))
def test_packing_phases_give_every_token_once(totals, window):
    p = packing.schedule(totals, [max(n, 1) for n in totals], window)
    seen: dict = {}
    for s, n in enumerate(totals):
        at = 0
        for size in (n // 3, n - n // 3):
            if size:
                a, length, w, off = packing.locate(p, s, at, size)
                assert length.sum() == size and a.tolist() == (np.cumsum(length) - length).tolist()
                for x, y, z in zip(w.tolist(), off.tolist(), length.tolist(), strict=True):
                    seen.setdefault(x, []).append((y, z))
            at += size
    sizes = []
    for w in sorted(seen):
        spans = sorted(seen[w])
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(spans)) and spans[0][0] == 0
        sizes.append(sum(z for _, z in spans))
    assert sum(sizes) == sum(totals) and all(x == window or x & (x - 1) == 0 for x in sizes)


def test_packing_of_a_thousand_queues():
    totals = [10_000 + 97 * s for s in range(1000)]
    p = packing.schedule(totals, [1.0] * 1000, 4096)
    assert p.used.nbytes + p.cum.nbytes < 64 << 20
    for s in (0, 500, 999):
        _, length, w, off = packing.locate(p, s, 0, totals[s])
        assert length.sum() == totals[s] and len(set(w.tolist())) == len(w) and ((0 <= off) & (off + length <= 4096)).all()


def test_packing_keeps_proportions():
    totals = [50_000, 30_000, 20_000]
    p = packing.schedule(totals, [5, 3, 2], 1000)
    for s, share in enumerate((500, 300, 200)):
        _, length, w, _ = packing.locate(p, s, 0, totals[s])
        per = np.bincount(w, length, 100)
        assert np.abs(per - share).max() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 7))
def test_schedule_is_lpt(sizes, k):
    by = Counter(sizes)
    first, turns, order = shards.schedule([(by[s], float(s)) for s in sorted(by, reverse=True)], k)
    loads = [0] * k
    for i, s in enumerate(sorted(sizes, reverse=True)):
        j = int(np.searchsorted(first, i, "right")) - 1
        loads[order[j, (i - first[j]) % turns[j]]] += s
    plain = [0] * k
    for s in sorted(sizes, reverse=True):
        plain[plain.index(min(plain))] += s
    assert sorted(loads) == sorted(plain)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=8), max_size=6))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    made = [list(zip(r, suffixes.front_code(r) if r else [], range(len(r)), strict=True)) for r in runs]
    got = list(suffixes.LoserTree(made)) if made else []
    flat = sorted(x for r in runs for x in r)
    assert [g[0] for g in got] == flat
    assert [g[1] for g in got] == ([0] + [suffixes.lcp(a, b, 0) for a, b in itertools.pairwise(flat)] if flat else [])


def test_anchors_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    data[3000:4500] = data[100:1600]
    data[5000:6000] = 97
    offs = np.array([0, 2900, 2900, 7000, 9000])
    whole = suffixes.anchors(data, offs)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    parts = suffixes.anchors(data, offs)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_intervals_by_pairs_and_by_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 100, 800).tolist())
    group = []
    for m in range(20):
        b = bytearray(base)
        for k in rng.integers(0, 800, 2):
            b[k] = 120
        group.append((bytes(b[300:700]), (1, 0, 299, bytes(b[1:300]), m)))
    group.sort()
    line = [(s, suffixes.lcp(group[i - 1][0], s, 0) if i else 0, e) for i, (s, e) in enumerate(group)]
    few = suffixes.intervals(line, 400)
    monkeypatch.setattr(suffixes, "FEW", 100)
    many = suffixes.intervals(line, 400)
    cover = lambda x: {(m, a) for m, lo, hi in x for a in range(lo, hi + 1)}
    assert cover(few) == cover(many) and cover(few)


def test_sstable_round_trip(tmp_path):
    path = str(tmp_path / "a.sst")
    rng = np.random.default_rng(3)
    docs = sorted([(int(i), rng.integers(0, 60_000, rng.integers(0, 3000)).astype("<u2")) for i in rng.integers(-(2**62), 2**62, 300)], key=lambda d: d[0])
    docs = [(None, docs[0][1])] + docs[:5] + docs[4:]
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i, ids in docs:
            w.add(sstable.key_of(i), ids.tobytes())
        w.close()
    r = sstable.Reader(path)
    assert [(sstable.id_of(k), v) for k, v in r.items()] == [(i, x.tobytes()) for i, x in docs] and r.docs == len(docs)
    assert len(r.get(docs[5][0])) == 2 and len(r.get(None)) == 1 and r.get(17) == []
    assert all(any((x == y).all() for y in r.get(i) if len(y) == len(x)) for i, x in docs[::17])
    raw = bytearray(open(path, "rb").read())
    raw[10] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(path).items())


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 75).astype(np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 850 / 1075) < 0.15


def test_forest_and_overlaps():
    x = [np.array(s, np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert minhash.overlaps(x, x).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    linked = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    assert len(minhash.forest(linked, True)) == 2 and len(minhash.forest(linked, False)) == 4


def test_chains_and_alignment():
    a = np.arange(200)
    b = np.concatenate([np.arange(1000, 1030), a[20:90], [7777], a[92:180], np.arange(2000, 2050)])
    where = {v: i for i, v in enumerate(b.tolist())}
    q = np.array([i for i in range(0, 196, 6) if all(x in where for x in a[i : i + 5].tolist())])
    m = np.column_stack([q, [where[int(a[i])] for i in q]])
    m = m[[all(b[y : y + 5] == a[x : x + 5]) for x, y in m]]
    (chain,) = passages.chains(m[:, 0], m[:, 1])
    assert passages.align(a, b, [tuple(x) for x in m[chain].tolist()]) == [(20, 180, 30, 189, 158)]
    assert passages.align(a[:60], b, [tuple(x) for x in m[chain].tolist() if x[0] < 40], least=50) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 120)), min_size=2, max_size=50))
def test_chains_are_those_found_one_by_one(matches):
    m = np.array(sorted({*matches, *((i, i + 3) for i in range(40, 70, 3))}))
    q, r, left, want = m[:, 0], m[:, 1], list(range(len(m))), []
    while len(left) > 1:
        score, before = passages._best_predecessors(q, r, left)
        k, chain = max(range(len(left)), key=lambda k: (score[k], -k)), []
        while k is not None:
            chain.append(left[k])
            k = before[k]
        if len(chain) < 2:
            break
        want.append(chain[::-1])
        left = [i for i in left if not q[chain[-1]] <= q[i] <= q[chain[0]]]
    assert passages.chains(q, r) == want


def test_chains_of_a_batch_and_their_first_look():
    """all_chains() gives what chains() gives of each pair; promising() lets every chain through of which a passage comes."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for pair in range(300):
        a = rng.integers(0, 10**6, rng.integers(60, 160))
        b = np.concatenate([rng.integers(0, 10**6, rng.integers(0, 40)), a[rng.integers(0, 30) : rng.integers(31, len(a))], rng.integers(0, 10**6, rng.integers(0, 40))])
        b[rng.random(len(b)) < rng.choice([0, 0.05, 0.15])] = 7
        where = {tuple(b[j : j + 5]): j for j in range(len(b) - 4)}
        m = np.array([(i, where[tuple(a[i : i + 5])]) for i in range(len(a) - 4) if tuple(a[i : i + 5]) in where]).reshape(-1, 2)
        one, q, r = passages.thinned(np.zeros(len(m), int), m[:, 0], m[:, 1])
        found = [c for _, c in passages.all_chains(one, q, r)]
        assert [c.tolist() for c in found] == [np.column_stack([q, r])[c].tolist() for c in (passages.chains(q, r) if len(q) else [])]
        for c in found:
            a0, b0 = max(0, c[0, 0] - 24), max(0, c[0, 1] - 24)
            wa, wb = a[a0 : c[-1, 0] + 29], b[b0 : c[-1, 1] + 29]
            rows.append((a0, len(a), wa.astype("<u2").tobytes(), b0, len(b), wb.astype("<u2").tobytes(), c.astype("<u4").tobytes()))
            want.append(bool(passages.align(a, b, [tuple(x) for x in c.tolist()])))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["a0", "na", "wa", "b0", "nb", "wb", "chain"])
    got = passages.promising(batch.slice(1), 50)
    assert (got | ~np.array(want[1:])).all() and sum(want) > 50 and not passages.promising(batch.slice(0, 0), 50).size


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_subsequence_by_halves(a, b):
    a, b = np.array(a, int), np.array(b, int)
    whole = passages._subsequence(a, b)
    old, passages.CELLS = passages.CELLS, 8
    try:
        parts = passages._halves(a, b)
    finally:
        passages.CELLS = old
    assert len(parts) == len(whole) and all(a[i] == b[j] for i, j in parts) and all(x < y and v < w for (x, v), (y, w) in itertools.pairwise(parts))


def test_hash_of_a_long_word(monkeypatch):
    data = np.random.default_rng(1).integers(33, 127, 20_000).astype(np.uint8)
    starts, ends = np.array([0, 10, 3000, 3500, 9000]), np.array([5, 2500, 3400, 8000, 9100])
    whole = common.hashes(data, starts, ends)
    monkeypatch.setattr(common, "CHUNK", 1000)
    assert (common.hashes(data, starts, ends) == whole).all()


def test_ordinal_separates_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 1500)
    rows = [np.unique(np.concatenate([rng.integers(100, 400, 20), [g] if g < 2 else []])).astype(int) for g in grade]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    m = ordinal.fit(first, np.concatenate(rows), grade, [0, 1, 2])
    f = m.score(np.repeat(np.arange(1500), np.diff(first)), np.concatenate(rows), 1500)
    t = m.tails(f)
    assert (np.diff(m.thresholds) > 0).all() and ((t > 0.5).sum(1) == grade).mean() > 0.97


def test_forest_of_isolation():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = rules.grow(x).score(x)
    assert s[-1] == s.max() and s[-1] > 0.6
    assert rules.calibrate(np.array([0.9, 0.2, 0.3]), np.array([False, True, True])) == 0.9
    assert rules.calibrate(np.array([0.9]), np.array([True])) == 2.0


def test_crc_is_of_wide_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\2\0\0\0")

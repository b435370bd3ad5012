"""Benchmark decontamination (4): a prefix-filtered set join over item-sized windows.

Every window of an item is a set of shingles. Shingles are ordered by rarity,
counted over all documents; a document that holds the share `contain` of a
window's shingles must hold one of the first n - ceil(contain * n) + 1 of them,
so only these prefix shingles are joined with the documents' shingles. A hit at
some position implies where the window would lie in the document: candidates
that leave the document are dropped (length and position bounds), the rest are
verified there.

The windows are the smaller side. They are cut by hash of window and item into
blocks of about BLOCK rows, so a window that many items share is in some blocks
with some of its items each. A pass over the documents counts rarity for one block, another
looks for it; then the block goes and the next one comes, with the hits so far
in a written table. So neither the driver nor an executor ever holds more than
one block, however large the benchmark is.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, chunks, cut, drop_path, fresh, grams, hashes, mark, mix, new_path, prepare, runs, same_words, spark_ints, text_bytes

#: Words of a window and of a shingle; windows of a block.
WINDOW, SHINGLE, BLOCK = 10, 3, 200_000


class Words:
    """Words of lower-cased texts: their bytes, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.first = runs(self.data, offs, NOT_ALNUM)
        self.hash = hashes(self.data, self.starts, self.ends)


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, n (words), words (lower case, a space between): each distinct window of each item; an item shorter than a window is one."""

    def task(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            data, offs = text_bytes(batch.column(1))
            found = Words(data, offs)
            raw, spans = found.data.tobytes(), list(zip(found.starts.tolist(), found.ends.tolist(), strict=True))
            out: set = set()
            for i, item in enumerate(items):
                w = [raw[a:b] for a, b in spans[found.first[i] : found.first[i + 1]]]
                n = min(window, len(w))
                out |= {(item or "", n, b" ".join(w[j : j + n])) for j in range(len(w) - n + 1)} if n else set()
            cols = list(zip(*sorted(out), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["item", "n", "words"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(task, "item string, n int, words binary").distinct()


class Block:
    """Windows of one block, in arrays: words and their hashes (padded), sizes, items, and prefix shingles sorted by hash."""

    def __init__(self, rows, window: int):
        at: dict = {}
        for r in rows:
            at.setdefault((r["n"], bytes(r["words"])), []).append(r["item"])
        keys = sorted(at)
        self.n = np.array([n for n, _ in keys], np.int64)
        offs = np.concatenate([[0], np.cumsum([len(w) for _, w in keys])])
        self.text = Words(np.frombuffer(b"".join(w for _, w in keys), np.uint8), offs)
        self.words = np.zeros((len(keys), window), np.uint64)
        for j in range(window):
            own = np.flatnonzero(self.n > j)
            self.words[own, j] = self.text.hash[self.text.first[own] + j]
        self.items = [sorted(at[k]) for k in keys]
        #: (window, offset, shingle size, hash) of every shingle.
        parts = []
        for k in np.unique(np.minimum(self.n, SHINGLE)):
            for n in np.unique(self.n[np.minimum(self.n, SHINGLE) == k]):
                own = np.flatnonzero(self.n == n)
                for j in range(n - k + 1):
                    h = np.full(len(own), k, np.uint64)
                    for x in range(k):
                        h = _step(h, self.words[own, j + x])
                    parts.append((own, np.full(len(own), j), np.full(len(own), k), h))
        self.window, self.offset, self.size, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.shingles = np.unique(self.hash)
        self.sizes = [int(k) for k in np.unique(self.size)]

    def choose(self, seen: np.ndarray, contain: float) -> None:
        """Keep the prefix: each window's rarest shingles, as many as must be looked up."""
        rank = seen[np.searchsorted(self.shingles, self.hash)]
        order = np.lexsort((self.offset, self.hash, rank, self.window))
        w, h = self.window[order], self.hash[order]
        fresh = np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]))
        order = order[fresh]
        w = self.window[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        total = np.bincount(w, minlength=len(self.n))
        prefix = total - np.ceil(contain * total - 1e-9).astype(int) + 1
        order = order[nth < prefix[w]]
        order = order[np.argsort(self.hash[order], kind="stable")]
        self.window, self.offset, self.size, self.hash = (x[order] for x in (self.window, self.offset, self.size, self.hash))

    def find(self, some: Words, contain: float) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence in some texts, verified by the bytes of its words."""
        found, h, first = [], some.hash, some.first
        last = np.repeat(first[1:], np.diff(first))
        begin = np.repeat(first[:-1], np.diff(first))
        for k in self.sizes:
            mine = np.flatnonzero(self.size == k)
            table = self.hash[mine]
            g = grams(h, k)
            if not len(g):
                continue
            small = _filter(table)
            at = np.flatnonzero(small[(g >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(table, g[at]), np.searchsorted(table, g[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            reps = hi - lo
            pick = mine[np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
            at = np.repeat(at, reps)
            w, start = self.window[pick], at - self.offset[pick]
            ok = (start >= begin[at]) & (start + self.n[w] <= last[at])
            w, start = w[ok], start[ok]
            if contain >= 1:
                same = np.ones(len(w), bool)
                for j in range(self.words.shape[1]):
                    own = np.flatnonzero(same & (j < self.n[w]))
                    same[own] = h[start[own] + j] == self.words[w[own], j]
                for j in range(self.words.shape[1]):
                    own = np.flatnonzero(same & (j < self.n[w]))
                    x, y = start[own] + j, self.text.first[w[own]] + j
                    same[own] = same_words(some.data, some.starts[x], some.ends[x], self.text.data, self.text.starts[y], self.text.ends[y])
            else:
                same = np.fromiter((_overlap(h[s : s + self.n[x]], self.words[x, : self.n[x]]) >= contain - 1e-9 for s, x in zip(start, w, strict=True)), bool, len(w))
            found.append((start[same], w[same]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, w = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, w


def _step(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One word more of grams()."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + w)


def _filter(table: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(table >> np.uint64(44)).astype(np.int64)] = True
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    k = min(SHINGLE, len(b))
    want = np.unique(grams(b, k))
    return np.isin(want, grams(a, k)).mean()


def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of a block occurs in all of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((block.shingles, block.sizes))

    def count(batches):
        shingles, sizes = sent.value
        total, small = np.zeros(len(shingles), np.int64), _filter(shingles)
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            for i, j in chunks(offs):
                h = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).hash
                for k in sizes:
                    g = grams(h, k)
                    g = g[small[(g >> np.uint64(44)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(shingles, g), len(shingles) - 1)
                    total += np.bincount(at[shingles[at] == g], minlength=len(shingles))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([spark_ints(shingles[some]), pa.array(total[some])], ["shingle", "seen"])

    got = docs.select("text").mapInArrow(count, "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen")).toArrow()
    seen = np.zeros(len(block.shingles), np.int64)
    seen[np.searchsorted(block.shingles, got.column("shingle").to_numpy().view(np.uint64))] = got.column("seen").to_numpy()
    sent.destroy()
    return seen


HIT = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,items:array<string>,contaminated:boolean>"


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, contain: float = 1.0, into: str = "hit") -> DataFrame:
    """docs with a struct column `into`: words, words inside occurrences of benchmark windows, and the items they are of.

    docs needs text, benchmark needs item_id and text. Null and wordless texts
    have no words and no hits; a wordless item matches nothing; an item
    without id hits as the item "". Repeated items and rows count as
    themselves. Very long texts are searched whole. A column of docs that is
    called `into` is replaced (fresh() of .common gives a name that isn't), all
    others stay. Empty tables give no hits.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop(into)
    hits, found = fresh(docs.withColumn(into, F.lit(None)), 2)
    names, text = docs.columns, docs.columns.index("text")
    struct = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(HIT))])
    state = T.StructType([*docs.schema.fields, T.StructField(hits, T.BinaryType()), T.StructField(found, T.ArrayType(T.StringType()))])

    def look(sent, last: bool):
        """Add the hits of a block to those of the columns `hits` (a bit a word) and `found`, if there; the last pass makes the struct of them."""

        def task(batches):
            for batch in batches:
                data, offs = text_bytes(batch.column(text))
                old = [batch.column(k).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows for k in (len(names), len(names) + 1)]
                n_words, n_hit, items, bits = [], [], [], []
                for i, j in chunks(offs):
                    some = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    h, first = some.hash, some.first
                    sets: list[set] = [set(old[1][d] or ()) for d in range(i, j)]
                    hit = np.zeros(len(h), bool)
                    for d in range(i, j):
                        if old[0][d]:
                            hit[first[d - i] : first[d - i + 1]] = np.unpackbits(np.frombuffer(old[0][d], np.uint8), count=int(first[d - i + 1] - first[d - i]))
                    if sent is not None:
                        start, w = sent.value.find(some, contain)
                        hit |= mark(len(h), start, start + sent.value.n[w])
                        own = np.searchsorted(first, start, "right") - 1
                        for d, x in np.unique(np.column_stack([own, w]), axis=0) if len(w) else ():
                            sets[d].update(sent.value.items[x])
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    n_words += np.diff(first).tolist()
                    n_hit += np.diff(sums[first]).tolist()
                    items += [sorted(s) for s in sets]
                    if not last:
                        bits += [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(first[:-1], first[1:], strict=True)]
                listed = pa.array(items, pa.list_(pa.string()))
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(bits, pa.binary()), listed], [*names, hits, found])
                    continue
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), listed, pa.array([x > 0 for x in n_hit], pa.bool_())]
                out = pa.StructArray.from_arrays(cols, ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], out], [*names, into])

        return task

    wanted = cut(windows(benchmark, window))
    n, path = max(1, math.ceil(wanted.count() / BLOCK)), None
    for b in range(n):
        rows, sent = wanted.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == b).collect(), None
        if rows:
            block = Block(rows, window)
            block.choose(_rarity(docs.select("text"), block), contain)
            sent = spark.sparkContext.broadcast(block)
        if b == n - 1:
            return docs.mapInArrow(look(sent, True), struct)
        before, path = path, new_path(spark, "hits")
        docs.mapInArrow(look(sent, False), state).write.parquet(path)
        docs = spark.read.schema(state).parquet(path)
        if before:
            drop_path(spark, before)
        if sent is not None:
            sent.destroy()


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of flag() over documents: exact occurrences of windows of ten words."""
    return flag(docs.select("doc_id", "text"), benchmark).select("doc_id", "hit.n_words", "hit.n_hit", "hit.n_items", "hit.items_sha256", "hit.contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

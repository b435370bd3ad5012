"""Ranked lexical search (11): WAND over document shards, shard heaps merged.

Queries are taken in blocks of bounded size. One pass over the documents
writes an index of a block: for each document its length and how often it holds
each of the block's terms. Counts over the whole index give the terms' weights.

Each task of the search then holds one shard of the index at a time, as
postings by term in order of doc_id, with the score that each posting adds and
the greatest of each term. WAND walks the postings of a query by document: the
terms are sorted by the document they stand at, their greatest impacts are added
in that order, and the document where the sum reaches the heap's threshold is
the pivot; no document before it can enter the heap, so all terms skip to it.
Some queries are walked at once, a row of the arrays each. The k best of each
query and task meet in one window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, NOT_ALNUM, chunks, cut, distinct, drop_path, hashes, new_path, owners, prepare, runs, same_words, text_bytes

#: (item, term) pairs of a block of queries; postings of a shard; cells (query, term) that are walked at once.
BLOCK, SHARD, CELLS = 200_000, 4_000_000, 1 << 15
_END = np.int64(1) << np.int64(40)


def _words(part: np.ndarray, offs: np.ndarray):
    low = LOWER[part]
    starts, ends, first = runs(low, offs, NOT_ALNUM)
    return low, starts, ends, first


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """key, term: each distinct term (bytes) of each item once."""
    kind = to_arrow_type(items.schema[key].dataType)

    def task(batches):
        for batch in batches:
            ids, data_offs = batch.column(0), text_bytes(batch.column(1))
            data, offs = data_offs
            own, words = [], []
            for i, j in chunks(offs):
                low, starts, ends, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                raw = low.tobytes()
                found = dict.fromkeys((d, raw[a:b]) for d, a, b in zip((owners(first) + i).tolist(), starts.tolist(), ends.tolist(), strict=True))
                own += [d for d, _ in found]
                words += [w for _, w in found]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())).cast(kind), pa.array(words, pa.binary())], [key, "term"])

    rows = items.select(key, "text")
    return rows.mapInArrow(task, f"`{key}` {items.schema[key].dataType.simpleString()}, term binary").distinct()


class Terms:
    """Terms of a block by number, found in texts by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        h = hashes(self.data, self.starts, self.ends)
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]
        self.alike = int(np.unique(h, return_counts=True)[1].max())  # terms of one hash; 1 but for a miracle

    def find(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) for each word that is a term."""
        h = hashes(data, starts, ends)
        one, back = distinct(h)
        lo = np.searchsorted(self.hash, h[one])
        found = []
        for k in range(self.alike):
            at = np.minimum(lo + k, len(self.hash) - 1)
            hit = ((lo + k < len(self.hash)) & (self.hash[at] == h[one]))[back]
            word = np.flatnonzero(hit)
            term = self.order[at[back[word]]]
            same = same_words(data, starts[word], ends[word], self.data, self.starts[term], self.ends[term])
            found.append((word[same], term[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _index(docs: DataFrame, terms: list[bytes], path: str) -> None:
    """Write doc_id, n (words), terms and times (lists) of each document with a word."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    table: list = []

    def task(batches):
        if not table:
            table.append(Terms(sent.value))
        for batch in batches:
            ids, (data, offs) = batch.column(0), text_bytes(batch.column(1))
            for i, j in chunks(offs):
                low, starts, ends, first = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                word, term = table[0].find(low, starts, ends)
                key, times = np.unique(owners(first)[word] * len(sent.value) + term, return_counts=True)
                doc, term = key // len(sent.value), key % len(sent.value)
                at = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(first)), *lists], ["doc_id", "n", "terms", "times"])

    docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n long, terms array<int>, times array<int>").where("n > 0").write.parquet(path)
    sent.destroy()


def _document_counts(index: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of n terms is."""

    def task(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    got = index.select("terms").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def _ratio(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(90 * n * documents) div total, also where the product leaves 64 bits."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        return (90 * documents * n) // total
    return np.array([90 * documents * int(x) // total for x in n], np.int64)


class Shard:
    """Postings of some documents, by term and then by doc_id, each with the score it adds."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, first: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, documents: int, total: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 10 + _ratio(n, documents, total)
        doc = owners(first)
        times = times.astype(np.int64)
        gain = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        # each term's list ends with a document that is none
        key = np.concatenate([terms * _END + place[doc], np.arange(len(weight)) * _END + (_END - 1)])
        order = np.argsort(key)
        self.key, self.gain = key[order], np.append(gain, np.zeros(len(weight), np.int64))[order]
        self.doc = self.key & (_END - 1)
        self.start = np.searchsorted(self.key, np.arange(len(weight) + 1) * _END)
        self.most = np.maximum.reduceat(self.gain, self.start[:-1])

    def kth(self, term: int, k: int) -> int:
        """The k-th greatest gain of a term; 0 if it has fewer."""
        g = self.gain[self.start[term] : self.start[term + 1] - 1]
        return int(np.partition(g, len(g) - k)[len(g) - k]) if len(g) >= k else 0


class Heaps:
    """The k best (score, doc_id) of each query; equal scores by ascending doc_id."""

    def __init__(self, queries: int, k: int):
        self.score, self.doc = np.zeros((queries, k), np.int64), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """One document for each of some queries: it takes the last place, and moves up, where it is better."""
        s, d = np.column_stack([self.score[q], score]), np.column_stack([self.doc[q], doc])
        order = np.lexsort((d, -s), axis=1)[:, :-1]
        self.score[q], self.doc[q] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)


def wand(shard: Shard, queries: list[np.ndarray], heaps: Heaps, at: np.ndarray) -> int:
    """Offer all documents of a shard that can be among the k best of queries[i] to heap at[i]; returns how many were scored."""
    k, width = heaps.score.shape[1], max(map(len, queries))
    bits = np.int64(width).item().bit_length()
    term = np.zeros((len(queries), width), np.int64)
    used = np.zeros((len(queries), width), bool)
    floor = np.ones(len(queries), np.int64)
    kth: dict = {}
    for i, q in enumerate(queries):
        q = q[shard.most[q] > 0]
        term[i, : len(q)], used[i, : len(q)] = q, True
        for t in q.tolist():
            if t not in kth:
                kth[t] = shard.kth(t, k)
            floor[i] = max(floor[i], kth[t])  # k documents have that much by one term alone
    most = np.where(used, shard.most[term], 0)
    cur = np.where(used, shard.start[term], shard.start[term + 1] - 1)
    doc = shard.doc[cur]
    live, columns, scored = np.arange(len(queries)), np.arange(width), 0
    while len(live):
        ranked = np.sort(doc << bits | columns, axis=1)
        least = np.maximum(floor[live], heaps.score[at[live], -1])
        reach = np.cumsum(np.take_along_axis(most, ranked & ((1 << bits) - 1), 1), axis=1) >= least[:, None]
        pivot = ranked[np.arange(len(live)), reach.argmax(1)] >> bits
        more = reach[:, -1] & (pivot < _END - 1)
        if not more.all():
            live, term, most, cur, doc, pivot, least = (x[more] for x in (live, term, most, cur, doc, pivot, least))
            if not len(live):
                break
        r, c = np.nonzero(doc < pivot[:, None])
        to = np.searchsorted(shard.key, term[r, c] * _END + pivot[r])
        cur[r, c], doc[r, c] = to, shard.doc[to]
        here = doc == pivot[:, None]
        some = np.flatnonzero((most * here).sum(1) >= least)
        if len(some):
            score = (shard.gain[cur[some]] * here[some]).sum(1)
            better = score >= least[some]
            heaps.offer(at[live[some[better]]], score[better], shard.ids[pivot[some[better]]])
            scored += len(some)
        cur += here
        doc[here] = shard.doc[cur[here]]
    return scored


def _search(index: DataFrame, items: list, kind, queries: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item, score, doc_id: the k best of each query in each task."""
    sent = index.sparkSession.sparkContext.broadcast((queries, weight))
    arrow = to_arrow_type(kind)
    # queries of like length are walked together
    order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    order = [i for i in order if len(queries[i])]
    groups, rest = [], order
    while rest:
        n = max(1, next((x for x in range(len(rest), 0, -1) if x * len(queries[rest[x - 1]]) <= CELLS), 1))
        groups.append(np.array(rest[:n]))
        rest = rest[n:]

    def task(batches):
        queries, weight = sent.value
        heaps, held, size = Heaps(len(queries), k), [], 0

        def done(held):
            t = pa.Table.from_batches(held)
            lists = t.column("terms").combine_chunks()
            ids = pc.fill_null(t.column("doc_id"), np.iinfo(np.int64).max - 1).to_numpy()
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
            shard = Shard(ids, t.column("n").to_numpy(), first, lists.flatten().to_numpy().astype(np.int64), t.column("times").combine_chunks().flatten().to_numpy(), weight, documents, total)
            for g in groups:
                wand(shard, [queries[i] for i in g.tolist()], heaps, g)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD:
                done(held)
                held, size = [], 0
        if held:
            done(held)
        q, place = np.nonzero(heaps.score > 0)
        docs = heaps.doc[q, place]
        yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in q.tolist()], arrow), pa.array(heaps.score[q, place]), pa.array(docs, mask=docs == np.iinfo(np.int64).max - 1)], ["item", "score", "doc_id"])

    return index.mapInArrow(task, f"item {kind.simpleString()}, score long, doc_id long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id") -> DataFrame:
    """The k best documents of each item: key, rank, doc_id, score.

    docs: doc_id (long) and text; items: key and text. Terms, weights and
    scores are those of op11's contract. Null and wordless texts hold nothing
    and count nowhere; rows that repeat a doc_id are documents of their own, as
    are rows without doc_id, which come last among equal scores. Rows that
    repeat an item are one item with the terms of all; items without terms
    have no rows. Very long texts are read whole; other columns are ignored.
    Empty tables give no rows. A task holds a shard of SHARD postings and the
    terms of a block of queries, or of one item if it has more.
    """
    spark = prepare(docs.sparkSession)
    kind = items.schema[key].dataType
    wanted = cut(item_terms(items, key))
    n, out, paths = max(1, math.ceil(wanted.count() / BLOCK)), [], []
    for b in range(n):
        rows = wanted.where(F.pmod(F.xxhash64(F.col(key)), F.lit(n)) == b).collect()
        if not rows:
            continue
        number: dict = {}
        by: dict = {}
        for r in rows:
            by.setdefault(r[key], []).append(number.setdefault(bytes(r["term"]), len(number)))
        paths.append(path := new_path(spark, "index"))
        _index(docs, list(number), path)
        index = spark.read.schema("doc_id long, n long, terms array<int>, times array<int>").parquet(path)
        whole = index.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        if not whole["n"]:
            continue
        df = _document_counts(index, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        out.append(_search(index, list(by), kind, [np.array(x, np.int64) for x in by.values()], weight, whole["n"], whole["total"], k))
    if not out:
        return spark.createDataFrame([], f"`{key}` {kind.simpleString()}, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = cut(found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias(key), "rank", "doc_id", "score"))
    for path in paths:
        drop_path(spark, path)
    return best


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """ranked() of documents for each benchmark item, ten each."""
    return ranked(docs, benchmark, 10)

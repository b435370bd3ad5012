"""Packing (3): mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A window is filled queue by queue; in each
window a queue earns a quantum, its target share of the window, and gives as
many whole tokens as its deficit counter holds. What it could not give stays
as its deficit and is carried to the next queue and the next window. With
quanta in fixed point, the deficits before any window follow from the window's
number alone:

    given to queues 0..s in the first k windows = (Q[s] * k) >> 20,  Q the running sum of quanta

so a partition starts with the deficits that the windows before it left, in
whichever partition they are, and none waits for another. When a queue runs
dry, its share is dealt among the rest: the schedule is a short list of
phases, at most a few for each queue, found on the driver from the queues'
totals. Sources with less than 1/1024 of the tokens (or four tokens a window)
share one queue, so there are at most 1025 queues and every quantum is at least
four tokens.

Windows take exactly `window` tokens. What remains at the end goes to windows
of descending powers of two, so nothing is padded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, prepare
from .tokens import encoder, vocabulary

#: Fraction bits of a quantum.
FIX = 20
#: Sources below this share of all tokens go to a common queue.
LEAST = 1 / 1024
#: Windows of a phase; more are split, so that products fit 63 bits.
LONGEST = 1 << 30
#: Rows (of some 50 bytes) of the table of queue positions up to which it is broadcast.
SENT = 200_000


@dataclass
class Phases:
    """window: number of the first window; used[p][s]: tokens that queue s gave before; cum[p][s]: running sum of quanta up to queue s (from 0); count: windows."""

    window: list[int]
    count: list[int]
    used: np.ndarray
    cum: np.ndarray


def round_robin(size: int, left: list[int], weight: list[float]) -> list[int]:
    """What each queue gives to one window of `size` when some may run dry in it."""
    take, deficit, need = [0] * len(left), [0.0] * len(left), size
    while need:
        alive = [s for s in range(len(left)) if left[s] > take[s]]
        total = sum(weight[s] for s in alive)
        before = need
        for s in alive:
            deficit[s] += before * weight[s] / total
            n = min(int(deficit[s]), left[s] - take[s], need)
            take[s] += n
            deficit[s] -= n
            need -= n
        if need == before:
            s = max(alive, key=lambda s: deficit[s])
            take[s] += 1
            deficit[s] -= 1
            need -= 1
    return take


def schedule(totals: list[int], weight: list[float], window: int) -> Phases:
    """Phases that give all tokens of all queues."""
    left, used, at = list(totals), [0] * len(totals), 0
    number, count, given, sums = [], [], [], []

    def put(n: int, cum: list[int]) -> None:
        nonlocal at
        number.append(at)
        count.append(n)
        given.append(np.array(used, np.int64))
        sums.append(np.array(cum, np.int64))
        for s in range(len(left)):
            got = (cum[s + 1] * n >> FIX) - (cum[s] * n >> FIX)
            used[s] += got
            left[s] -= got
        at += n

    def explicit(size: int) -> None:
        put(1, [0, *(int(x) << FIX for x in np.cumsum(round_robin(size, left, weight)))])

    while (remains := sum(left)) >= window:
        alive = sum(w for w, n in zip(weight, left, strict=True) if n)
        cum, run = [0], 0.0
        for w, n in zip(weight, left, strict=True):
            run += w if n else 0
            cum.append(round((window << FIX) * min(1.0, run / alive)) if n else cum[-1])
        last = max(s for s, n in enumerate(left) if n)
        cum[last + 1 :] = [window << FIX] * (len(left) - last)
        n = min([LONGEST, remains // window, *((left[s] << FIX) // q + 1 for s in range(len(left)) if (q := cum[s + 1] - cum[s]))])
        while n and any((cum[s + 1] * n >> FIX) - (cum[s] * n >> FIX) > left[s] for s in range(len(left))):
            n -= 1
        put(n, cum) if n else explicit(window)
    for b in reversed(range(remains.bit_length())):
        if remains >> b & 1:
            explicit(1 << b)
    # 64-bit arrays: at some thousand phases of a thousand queues every worker holds them
    return Phases(number, count, np.array(given, np.int64).reshape(len(number), len(totals)), np.array(sums, np.int64).reshape(len(number), len(totals) + 1))


def locate(p: Phases, s: int, a: int, n: int):
    """(start in the document, length, window, offset) arrays for tokens a..a+n of queue s."""
    pos, end, found = a, a + n, []
    while pos < end:
        j = int(np.searchsorted(p.used[:, s], pos, "right")) - 1
        c0, c1, base = int(p.cum[j, s]), int(p.cum[j, s + 1]), int(p.used[j, s])
        give = lambda k: (c1 * k >> FIX) - (c0 * k >> FIX)  # noqa: E731, B023
        stop = min(end - base, give(p.count[j]))
        k = max(0, ((pos - base) << FIX) // (c1 - c0) - 2)
        while give(k + 1) <= pos - base:
            k += 1
        last = min(p.count[j], (stop << FIX) // (c1 - c0) + 3)
        ks = np.arange(k, last + 1, dtype=np.int64)
        low = c0 * ks >> FIX
        given = (c1 * ks >> FIX) - low
        lo, hi = np.maximum(given[:-1], pos - base), np.minimum(given[1:], stop)
        ok = hi > lo
        found.append((lo[ok] + base - a, (hi - lo)[ok], p.window[j] + ks[:-1][ok], (np.diff(low) + lo - given[:-1])[ok]))
        pos = base + stop
    return [np.concatenate(x) for x in zip(*found, strict=True)] if len(found) != 1 else found[0]


def tokenize(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """Documents as ids (binary), with each one's place behind those of its source in its task; written once."""

    def task(batches):
        enc, part, ahead = encoder(vocab), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids, n, at = [], [], []
            sources = batch.column(2).to_pylist()
            every, first = enc.batch(batch.column(1))
            for i, j, source in zip(first[:-1].tolist(), first[1:].tolist(), sources, strict=True):
                x = every[i:j].tobytes() + end
                ids.append(x)
                n.append(len(x) // enc.dtype.itemsize)
                at.append(ahead.get(source, 0))
                ahead[source] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "n", "at", "ids"])

    spark = prepare(docs.sparkSession)
    path = new_path(spark, "tokens")
    docs.select("doc_id", "text", "source").mapInArrow(task, "doc_id long, source string, part int, n long, at long, ids binary").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pack(docs: DataFrame, window: int = 4096, mixture: dict[str, float] | None = None, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """One row for each piece of a document in a window.

    doc_id, source, start and length (tokens of the document before and in the
    piece), ids (binary: the piece's ids, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. mixture: target token shares by source;
    the default is the corpus's own proportions, and a target below four tokens
    a window or 1/1024 is refused. Documents keep input order within their
    source. Very long texts are packed whole. Null text is a document of the end id alone; a null
    source is a source of its own; repeated rows are packed again; an empty
    table gives no row. Needs doc_id, text and source; other columns are
    ignored.
    """
    vocab = vocab or vocabulary()
    spark = docs.sparkSession
    tok = tokenize(docs, vocab, end_id)
    per = cut(tok.groupBy("part", "source").agg(F.sum("n").alias("n")))
    width = encoder(vocab).dtype.str
    small = max(LEAST, 4 / window)
    whole = per.agg(F.sum("n")).first()[0] or 0
    if low := sorted(k for k, v in (mixture or {}).items() if v < small):
        raise ValueError(f"a source's target must be {small:.6f} of a window of {window} or more, which is not so for {', '.join(low)}")
    named = [F.col("source").isin(list(mixture))] if mixture else [F.col("t") >= whole * small]
    big = per.groupBy("source").agg(F.sum("n").alias("t")).where(named[0]).collect()
    big = sorted(big, key=lambda r: (-r["t"], r["source"] is not None, r["source"] or ""))
    rest = whole - sum(r["t"] for r in big)
    if big and 0 < rest < whole * small and not mixture:
        rest += big.pop()["t"]
    totals, weight = [r["t"] for r in big], [float(r["t"]) for r in big]
    if mixture:
        weight = [float(mixture[r["source"]]) for r in big]
    if rest:
        totals.append(rest)
        weight.append(max(small, 1 - sum(weight)) if mixture else float(rest))
    # at most 1024 rows, as each has 1/1024 of the tokens or of the target
    own = spark.createDataFrame([(r["source"], i) for i, r in enumerate(big)], "_s string, _q int")
    queues = per.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("_s")), "left").select("part", "source", "n", F.coalesce("_q", F.lit(len(big))).alias("queue"))
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = queues.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("part").alias("_p"), F.col("source").alias("_s"), "queue", "base")
    if per.count() <= SENT:  # one row for each task and source; beyond it the join shuffles
        bases = F.broadcast(bases)
    placed = tok.join(bases, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "queue", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    plan = spark.sparkContext.broadcast(schedule(totals, weight, window))

    def task(batches):
        p = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cols: tuple[list, ...] = ([], [], [], [], [])
            counts = []
            for q, at, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                start, length, seq, off = locate(p, q, at, n)
                for c, v in zip(cols, (start, length, seq, off, np.full(len(start), n)), strict=True):
                    c.append(v)
                counts.append(len(start))
            pick = pa.array(np.repeat(np.arange(len(counts)), counts))
            start, length, seq, off, n = (np.concatenate(c).astype(np.int64) for c in cols)
            # a document's pieces lie side by side, as its ids do: one buffer holds those of the whole batch
            wide = np.frombuffer(b"".join(batch.column(5).to_pylist()), width).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int64)
            ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(wide)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start), pa.array(length), ids, pa.array(n), pa.array(seq), pa.array(off)], ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(task, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op3(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """The digest of pack() over documents, a row for each piece."""
    return pack(docs, vocab=vocab).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")

"""Suffix-array dedup (10): a distributed merge sort that never compares a known prefix again.

Every byte that a string of `least` bytes covers goes, if that string also
starts anywhere else. Which strings are repeated is read off sorted suffixes:

1. Anchors. Among each `WINDOW` consecutive byte k-grams the leftmost of least
   hash is an anchor, so a string of `least` bytes holds one at a place that
   the string alone decides, and equal strings hold it at the same offset. An
   anchor answers for the strings that begin `a` bytes before it, a in a range,
   which is cut into cells of CELL offsets; a cell's suffix begins at its least
   offset, so all its strings share its first least - CELL + 1 bytes. Only
   these suffixes are sorted (about one in WINDOW / 4).
2. Suffixes whose first least - CELL + 1 bytes, by hash, occur once in all
   documents cannot begin a repeat; they are left out before any text moves.
3. Each task sorts its suffixes into runs of bounded size, front-codes them
   (length shared with the suffix before, the rest), joins equal contexts, and
   deals them to buckets by the hash of that first part.
4. A bucket merges its runs with a loser tree. A run's front code gives a
   suffix's common prefix with the last winner; the longer one wins, and only
   equal ones are compared, from there on. The merge yields each suffix with
   its common prefix with the one before.
5. Suffixes i and j with common prefix R and common left context L share the
   strings that begin a bytes before them for 400 - R <= a <= L, so each pair
   of neighbours in a group gives an interval. In large groups all members are
   told apart at each offset by the runs of equal prefixes in the order of
   suffixes and in the order of left contexts. Bytes decide, never hashes.

A bucket's memory is that of the distinct contexts of its largest group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, _pow, cut, drop_path, mark, mix, new_path, prepare, text_bytes

LEAST, WINDOW, GRAM = 400, 300, 24
#: Offsets of a cell; those before an anchor are cut into WINDOW / CELL cells.
CELL = 150
#: Suffix bytes after which a task closes a run; suffixes that a bucket is meant to hold.
RUN, BUCKET = 24 << 20, 40_000
#: Distinct contexts in a group up to which pairs are compared one by one; either way gives the same.
FEW = 12


def anchors(data: np.ndarray, offs: np.ndarray, least: int = LEAST, window: int = WINDOW, cell: int = CELL) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, hash of the first least - cell + 1 bytes) of each cell's suffix, by place.

    A segment of bytes at a time, so scratch memory does not grow with a text.
    """
    sure, found = least - cell + 1, []
    ends = np.repeat(offs[1:], np.diff(offs)) if len(data) < CHUNK else None
    for i in range(0, max(0, len(data) - least + 1), CHUNK):
        seg = data[i : i + CHUNK + least - 1]
        n = len(seg)
        up, down = _pow(n + 1, 1), _pow(n + 1, -1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        m = n - GRAM + 1
        v = mix((sums[GRAM:] - sums[:-GRAM]) * down[:m])
        v = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        v = np.concatenate([v, np.full(-m % window, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - least + 1
        at = (np.minimum(behind[:count], ahead[window - 1 : window - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(count)
        end = ends[i : i + count] if ends is not None else offs[np.searchsorted(offs, start + i, "right")]
        start = np.flatnonzero(start + i + least <= end)
        if not len(start):
            continue
        at = at[start]
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        p, lo, hi = at[edge], start[edge], start[np.append(edge[1:], len(at)) - 1]
        for before in range(0, window, cell):
            q = p - before
            a, b = np.maximum(lo, q - cell + 1), np.minimum(hi, q)
            some = np.flatnonzero(a <= b)
            q, a, b = q[some], a[some], b[some]
            h = mix((sums[q + sure] - sums[q]) * down[q])
            found.append((q + i, np.full(len(q), before), a + i, b + i, h))
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    p, before, lo, hi, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lo, before, p))
    p, before, lo, hi, h = (x[order] for x in (p, before, lo, hi, h))
    new = np.append(True, (p[1:] != p[:-1]) | (before[1:] != before[:-1]))  # a segment's end can halve a cell's starts
    last = np.append(np.flatnonzero(new)[1:], len(p)) - 1
    return p[new], lo[new], hi[last], h[new]


def lcp(a: bytes, b: bytes, i: int) -> int:
    """The common prefix of a and b, which agree in the first i bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[i:n]) ^ int.from_bytes(b[i:n])
    return n - (x.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> list[int]:
    return [0, *(lcp(a, b, 0) for a, b in zip(suffixes, suffixes[1:], strict=False))]


class LoserTree:
    """Merges sorted runs of (suffix, common prefix with the one before in its run, payload)."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        n = 1
        while n < len(runs):
            n *= 2
        self.n = n
        #: By run: the suffix that stands in line, and its common prefix with the last winner.
        self.head: list = [None] * n
        self.known = [0] * n
        for i in range(len(runs)):
            self._pull(i)
            self.known[i] = 0
        self.loser = [0] * n
        self.top = self._build(1) if n > 1 else 0

    def _pull(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        if self.head[i] is not None:
            self.known[i] = self.head[i][1]

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        a, b = self.head[i], self.head[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = self.known[i], self.known[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        a, b = a[0], b[0]
        k = lcp(a, b, x)
        if k == len(a) or (k < len(b) and a[k] < b[k]):
            self.known[j] = k
            return i, j
        self.known[i] = k
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        w, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def __iter__(self):
        """(suffix, common prefix with the one before, payload) in order."""
        while True:
            i = self.top
            if self.head[i] is None:
                return
            suffix, _, payload = self.head[i]
            yield suffix, self.known[i], payload
            self._pull(i)
            node = (i + self.n) >> 1
            while node:
                i, self.loser[node] = self._play(i, self.loser[node])
                node >>= 1
            self.top = i


def intervals(group: list, least: int) -> list:
    """(member, a0, a1) of repeated starts in a group of (suffix, lcp with the one before, entry); entry is (copies, near, far, left, member)."""
    out = []
    if len(group) <= FEW:
        for i in range(len(group)):
            shared = 1 << 30
            _, _, (ci, ni, fi, li, mi) = group[i]
            for j in range(i + 1, len(group)):
                shared = min(shared, group[j][1])
                _, _, (cj, nj, fj, lj, mj) = group[j]
                left = lcp(li[::-1], lj[::-1], 0)
                a0, a1 = max(ni, nj, least - shared), min(fi, fj, left)
                if a0 <= a1:
                    out += [(m, a0, a1) for c, m in ((ci, mi), (cj, mj)) if c == 1]
        return out
    size = len(group)
    entries = [g[2] for g in group]
    near, far = np.array([e[1] for e in entries]), np.array([e[2] for e in entries])
    shared = np.array([g[1] for g in group])  # the suffixes are sorted: those with equal prefixes stand together
    shared[0] = 0
    lefts = [e[3][::-1] for e in entries]
    order = sorted(range(size), key=lefts.__getitem__)
    same_left = np.array([0, *(lcp(lefts[i], lefts[j], 0) for i, j in zip(order, order[1:], strict=False))])
    order = np.array(order)
    single = np.array([e[0] == 1 for e in entries])
    hit = np.zeros((size, int(far.max()) + 2), bool)
    left = np.empty(size, np.int64)
    for a in range(int(near.min()), int(far.max()) + 1):
        some = np.flatnonzero((near <= a) & (a <= far))
        left[order] = np.cumsum(same_left < a)
        key = (np.cumsum(shared < least - a) * (size + 1) + left)[some]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        hit[some[by[1:][same]], a] = True
        hit[some[by[:-1][same]], a] = True
    hit &= single[:, None]
    for i in np.flatnonzero(hit.any(1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[i]]).astype(np.int8)))
        out += [(entries[i][4], int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]
    return out


_ROW = "bucket long, run binary, id long, hash long, start long, stop long"


def _spans(ids, hashes, starts, stops, bucket=0) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket) if np.isscalar(bucket) else bucket, pa.int64()), pa.nulls(n, pa.binary()), *(pa.array(x, pa.int64()) for x in (ids, hashes, starts, stops))], ["bucket", "run", "id", "hash", "start", "stop"])


def _encode_run(suffixes: list[bytes], entries: list) -> bytes:
    """A sorted run: front-coded suffixes, then near, far, copies, member (id, hash, place) and left contexts, compressed."""
    known = front_code(suffixes)
    rest = [s[k:] for s, k in zip(suffixes, known, strict=True)]
    nums = np.array([(k, len(r), c, n, f, *m) for k, r, (c, n, f, _, m) in zip(known, rest, entries, strict=True)], "<i8")
    raw = len(suffixes).to_bytes(8, "little") + nums.tobytes() + b"".join(rest) + b"".join(e[3] for e in entries)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decode_run(blob: bytes):
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    nums = np.frombuffer(raw, "<i8", 8 * n, 8).reshape(n, 8).tolist()
    at = 8 + 64 * n
    left_at = at + sum(x[1] for x in nums)
    suffix = b""
    for k, m, copies, near, far, *member in nums:
        suffix = suffix[:k] + raw[at : at + m]
        at += m
        yield suffix, k, (copies, near, far, raw[left_at : left_at + far], tuple(member))
        left_at += far


def _keyed(docs: DataFrame) -> DataFrame:
    """id and hash stand for a document; rows that repeat both are copies."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """_id, _hash, spans (start, stop in bytes; they may overlap) of documents in which a string of `least` bytes is repeated."""
    window = WINDOW * least // LEAST
    cell = max(1, window * CELL // WINDOW)
    sure = least - cell + 1
    prepare(docs.sparkSession)
    keyed = _keyed(docs).select("_id", "_hash", "text")

    def find(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            p, _, _, h = anchors(data, offs, least, window, cell)
            own = np.searchsorted(offs, p, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(p - offs[own])], ["h", "_i", "_h", "p"])

    path = new_path(docs.sparkSession, "places")
    keyed.mapInArrow(find, "h long, _i long, _h long, p long").write.parquet(path)
    places = docs.sparkSession.read.parquet(path)
    # computed apart, so that the join below has a plain exchange on either side and a hot hash can be split
    twice = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    flagged = cut(places.join(twice, "h").groupBy("_i", "_h").agg(F.collect_set("p").alias("places")))
    drop_path(docs.sparkSession, path)
    total = flagged.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if total > BUCKET else 1)

    def sort(batches):
        held: dict = {}
        size = 0

        def close():
            by: dict = {}
            done: list = []
            for (h, right, left, near, far), members in held.items():
                if len(members) > 1:
                    done += [(i, x, p - far, p - near + least) for i, x, p in members]
                by.setdefault(h % buckets, []).append((right, (len(members), near, far, left, members[0])))
            held.clear()
            done.sort()
            merged: list = []
            for i, x, a, b in done:
                if merged and merged[-1][:2] == [i, x] and a <= merged[-1][3]:
                    merged[-1][3] = max(b, merged[-1][3])
                else:
                    merged.append([i, x, a, b])
            if merged:
                cols = [np.array(c, np.int64) for c in zip(*merged, strict=True)]
                yield _spans(*cols, bucket=(mix(cols[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
            for b, run in by.items():
                run.sort(key=lambda e: e[0])
                blob = _encode_run([r for r, _ in run], [e for _, e in run])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], ["bucket", "run", "id", "hash", "start", "stop"])

        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            raw = data.tobytes()
            p, lo, hi, h = anchors(data, offs, least, window, cell)
            own = np.searchsorted(offs, p, "right") - 1
            flags = batch.column(3)
            begin = np.array(flags.offsets) - flags.offsets[0].as_py()
            wanted = flags.flatten().to_numpy() + np.repeat(offs[:-1], np.diff(begin))
            keep = np.flatnonzero(np.isin(p, wanted))
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for q, d, a, b, x in zip(*(y[keep].tolist() for y in (p, own, lo, hi, h)), strict=True):
                near, far = q - b, q - a
                key = (x, raw[q : q + least - near], raw[a:q], near, far)
                got = held.setdefault(key, [])
                got.append((ids[d], hashes[d], q - int(offs[d])))
                size += 700 if len(got) == 1 else 100
                if size > RUN:
                    yield from close()
                    size = 0
        yield from close()

    def merge(group: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        spans = group.filter(group.column("run").is_null()).select(["id", "hash", "start", "stop"])
        runs = [_decode_run(x) for x in group.column("run").to_pylist() if x is not None]
        line: list = []

        def settle():
            if len(line) > 1:
                for (i, x, p), a0, a1 in intervals(line, least):
                    for c, v in zip(found, (i, x, p - a1, p - a0 + least), strict=True):
                        c.append(v)
            line.clear()

        for item in LoserTree(runs) if runs else ():
            if item[1] < sure:
                settle()
            line.append(item)
        settle()
        return pa.concat_tables([spans, pa.table({n: pa.array(c, pa.int64()) for n, c in zip(spans.column_names, found, strict=True)})])

    with_places = keyed.join(flagged, (F.col("_id") == F.col("_i")) & (keyed["_hash"] == flagged["_h"])).select(keyed["_id"], keyed["_hash"], "text", "places")
    rows = with_places.mapInArrow(sort, _ROW)
    spans = rows.groupBy("bucket").applyInArrow(merge, "id long, hash long, start long, stop long")
    return spans.groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, stop), kept (binary: the bytes that stay), for each row of docs.

    Strings are judged on the input and never cross documents. Null text is
    empty; texts shorter than `least` stay whole; rows that repeat another row
    repeat its strings, so both lose them. Needs doc_id (may be null) and
    text; other columns are ignored. An empty table gives no rows.
    """
    found = repeated(docs, least).withColumnRenamed("_id", "_i").withColumnRenamed("_hash", "_h")
    keyed = _keyed(docs)
    both = keyed.join(found, (keyed["_id"] == found["_i"]) & (keyed["_hash"] == found["_h"]), "left").select("doc_id", "text", "spans.start", "spans.stop")

    def task(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            cols: tuple[list, ...] = ([], [], [], [])
            for d, (s, e) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[offs[d] : offs[d + 1]]
                gone = mark(len(text), np.array(s), np.array(e)) if s else np.zeros(len(text), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                for c, v in zip(cols, (len(text), int(gone.sum()), [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)], text[~gone].tobytes()), strict=True):
                    c.append(v)
            n, removed, spans, kept = cols
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return both.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary")


def op10(docs: DataFrame) -> DataFrame:
    """The digest of remove() over documents at 400 bytes."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""MinHash near-dedup (1): circulant MinHash, banding, exact verification.

A document's set of word shingles is hashed into a universe of 2**20. One
permutation (sigma) spreads the set over the universe; a second (pi), shifted
circularly by k, gives the k-th signature coordinate: the least pi value of the
set at shift k. The shifted values of an element lie side by side in pi, so all
coordinates come from one contiguous read.

Equal sets are collapsed first: a class has one representative, the least
doc_id. Representatives that share a band are joined into candidate clusters
(a star around the least member of each bucket, then connected components), so
each is in one cluster and no bucket is expanded into pairs. Clusters are
verified on full sets by products of 0/1 matrices of two blocks of members,
which hold all intersection sizes exactly; a task returns a spanning forest of
its links, never the pairs. First the members of a cluster's first block meet
all others. In a large cluster most are then one component, and among these no
link can add to it: only the rest meet all others. So a large group of copies
costs a few times its size, while every link between different components is
found. Components of these links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, chunks, cut, grams, hashes, mix, prepare, runs, spark_ints, text_bytes
from .graph import SENT, beside, components

#: Signature coordinates: BANDS bands of ROWS. A pair at 0.85 misses all bands with probability 2e-8.
BANDS, ROWS = 24, 4
K = BANDS * ROWS
UNIVERSE = 1 << 20
#: Members of a cluster in a block; shingles that a matrix product takes at once.
BLOCK, COLUMNS = 512, 8192
#: Members of clusters of one block that one task compares, on the average, at most.
SHARE = 2048


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    sigma, pi = rng.permutation(UNIVERSE).astype(np.uint32), rng.permutation(UNIVERSE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: K - 1]]), K)


_tables: list = []


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K coordinates of a non-empty set of shingle hashes."""
    if not _tables:
        _tables.extend(_permutations())
    sigma, shifted = _tables
    at = sigma[(shingles >> np.uint64(44)).astype(np.int64)]
    out = shifted[at[:2048]].min(0)
    for i in range(2048, len(at), 2048):
        np.minimum(out, shifted[at[i : i + 2048]].min(0), out=out)
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int):
    """The sorted distinct shingle hashes of each text: n words; all words if a text has fewer; none without words."""
    low = LOWER[data]
    starts, ends, first = runs(low, offs, SPACES)
    h = hashes(low, starts, ends)
    g = grams(h, n)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= n:
            yield np.unique(g[i : j - n + 1])
        else:
            yield grams(h[i:j], j - i) if j > i else np.empty(0, np.uint64)


def sign(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set (16 bytes that name the set), bands (hashes)."""

    def task(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            size, name, bands = [], [], []
            for i, j in chunks(offs):
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n):
                    size.append(len(s))
                    if not len(s):
                        name.append(None)
                        bands.append([])
                        continue
                    sig = signature(s)
                    name.append(mix(s).sum().tobytes() + mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().tobytes())
                    h = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[r::ROWS].astype(np.uint64))
                    bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set", "bands"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_shingles long, set binary, bands array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The intersection size of each set of a with each of b."""
    values = np.concatenate([*a, *b])
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column = rows[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    out = np.zeros((len(a), len(b)), np.float32)  # counts below 2**24 are exact
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[rows[i:j], column[i:j] - c] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links of a matrix connect; same: rows and columns are the same nodes."""
    behind = 0 if same else linked.shape[0]
    root = np.arange(behind + linked.shape[1])
    out = []
    for i in range(linked.shape[0]):
        js = np.flatnonzero(linked[i])
        for r, k in zip(*np.unique(root[behind + js], return_index=True), strict=True):
            if r != root[i]:
                out.append((i, int(js[k])))
                root[root == r] = root[i]
    return out


def _compared(docs: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that span those found.

    dealt: id, cluster, pair, side, share. Members of one cluster and pair meet,
    those of side 0 with those of side 1; where pair is 0, those of side 0 with
    each other. share: what is done in one task, some pairs at a time.
    """

    def sets(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(5))
            out: list = []
            for i, j in chunks(offs):
                out += [s.tobytes() for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], ["id", "cluster", "pairs", "side", "blocks", "s"])

    def compare(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        by: dict = {}
        for k, key in enumerate(zip(*(group.column(c).to_pylist() for c in ("cluster", "pair")), strict=True)):
            by.setdefault(key, []).append(k)
        ids, side, raw = group.column("id").to_numpy(), group.column("side").to_pylist(), group.column("s")
        for (_, pair), rows in by.items():
            a = [k for k in rows if side[k] == 0]
            b = a if pair == 0 else [k for k in rows if side[k] == 1]
            if not a or not b:
                continue
            x = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in a]
            y = x if pair == 0 else [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in b]
            both = overlaps(x, y)
            total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
            linked = (100 * both >= percent * (total - both)) & (ids[a][:, None] != ids[b][None, :])
            out += [(int(ids[a[i]]), int(ids[b[j]])) for i, j in forest(linked, pair == 0)]
        cols = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b"), cols, strict=True)})

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(dealt, "id").select("id", "cluster", "pairs", "side", "blocks", "text")
    rows = texts.mapInArrow(sets, "id long, cluster long, pairs array<long>, side int, blocks int, s binary").withColumn("pair", F.explode("pairs"))
    buckets = max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // SHARE))
    share = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(buckets))).otherwise(F.xxhash64("cluster", "pair"))
    return rows.select("id", "cluster", "pair", "side", "s", share.alias("share")).groupBy("share").applyInArrow(compare, "a long, b long")


def verify(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what all links within clusters connect. members: id, cluster."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = cut(members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    first = members.select("id", "cluster", F.when(F.col("block") == 0, every).otherwise(F.array("block")).alias("pairs"), (F.col("block") > 0).cast("int").alias("side"), "blocks")
    found = cut(_compared(docs, first, n, percent))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return found
    # the largest component of each large cluster, and who is outside of it and has not met all others
    roots = components(found.join(large.select(F.col("id").alias("a")), "a", "left_semi"))
    placed = cut(large.join(roots, F.col("id") == F.col("node"), "left").select("id", "cluster", "blocks", "block", F.coalesce("root", "id").alias("root")))
    main = placed.groupBy("cluster", "root").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("root", F.struct("m", -F.col("root"))).alias("main"))
    rest = cut(placed.join(beside(main, large.count()), "cluster").where((F.col("root") != F.col("main")) & (F.col("block") > 0)).select("id", "cluster", "blocks"))
    if rest.isEmpty():
        return found
    parts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    parts = beside(parts, large.count())
    # pairs of a block (from 1) and a part, numbered block * 2**32 + part
    pair = lambda block, part: block * F.lit(1 << 32) + part
    some = large.where("block > 0").join(parts, "cluster")
    one = some.select("id", "cluster", F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: pair(F.col("block"), k)).alias("pairs"), F.lit(0).alias("side"), "blocks")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    two = rest.join(parts, "cluster").select("id", "cluster", F.transform(F.sequence(F.lit(1).cast("long"), F.col("blocks").cast("long") - 1), lambda k: pair(k, own)).alias("pairs"), F.lit(1).alias("side"), "blocks")
    dealt = cut(one.union(two))
    size = dealt.agg(F.sum(F.size("pairs"))).first()[0]
    # some rows of a large cluster each: as long as they are few, the texts stay where they are
    return found.union(cut(_compared(docs, F.broadcast(dealt) if size <= SENT else dealt, n, percent)))


def link(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept, class_id.

    component_id is the least doc_id that is reachable over links (100 *
    intersection >= percent * union of shingle sets), kept whether it is the
    row's own. class_id is the least doc_id with the same set.
    Null, empty and wordless texts have an empty set and are linked with
    nothing. A row without doc_id is linked with nothing, has no component and
    is kept. Rows that repeat a doc_id are the same document and get the same
    row, so a row that is kept is kept as often as it stands there. Ties go to
    the least doc_id. Very long texts are shingled whole; other columns are
    ignored. An empty table gives no rows.
    """
    sig = cut(sign(docs, shingle))
    named = sig.where(F.col("set").isNotNull() & F.col("doc_id").isNotNull())
    reps = cut(named.groupBy("set", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select(F.col("r.doc_id").alias("id"), "set", "n_shingles", "r.bands"))
    rows = reps.select(F.explode("bands").alias("bucket"), "id")
    buckets = cut(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 1"))
    crowded = rows.join(buckets.where("n > 2").select("bucket", "least"), "bucket")
    stars = buckets.where("n = 2").select("least", "most").union(crowded.where("id > least").select("least", "id"))
    clusters = components(stars, "least", "most")
    members = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).union(clusters.select("root", "root").distinct())
    roots = components(verify(docs, members, shingle, percent))
    classes = reps.select("set", F.col("n_shingles").alias("_n"), "id").join(roots, F.col("id") == F.col("node"), "left")
    classes = classes.select(F.col("set").alias("_set"), "_n", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("_root"))
    out = sig.select("doc_id", "n_shingles", "set").join(classes, (F.col("set") == F.col("_set")) & (F.col("n_shingles") == F.col("_n")) & F.col("doc_id").isNotNull(), "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def op1(docs: DataFrame) -> DataFrame:
    """link() on shingles of three words at 85 of 100."""
    return link(docs, 3, 85)

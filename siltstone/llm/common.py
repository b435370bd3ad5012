"""What the operators share: session settings, shared storage, text kernels.

Text kernels work on the bytes of an Arrow batch at once with numpy; no loop
visits single words. A text's words are runs of bytes outside a separator
table, so multi-byte characters never need decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; whole texts travel, so batches are kept small.
BATCH_ROWS = 1024
#: Bytes that a numpy kernel works on at once (8 bytes of scratch for each).
CHUNK = 1 << 20

with contextlib.suppress(OSError, AttributeError):
    # glibc: arrays from 1 MB on go back to the system when they are freed, so a worker that lives long doesn't grow
    ctypes.CDLL(None).mallopt(-3, 1 << 20)


def release() -> None:
    """Give memory that Arrow holds and doesn't use back to the system; for workers between large pieces of work."""
    pa.default_memory_pool().release_unused()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that carry texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage; the copy is in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"


def least_hashed(df: DataFrame, key: str, most: int) -> DataFrame:
    """`most` rows of df at most, those of the least xxhash64 of column `key`, in that order; about as many are sorted, however large df is."""
    n = df.count()
    if n > most:
        share = (most + 8 * most**0.5) / n
        df = df.where(F.xxhash64(key) <= F.lit(int(min(1.0, share) * (2**64 - 2048)) - 2**63))
    return df.orderBy(F.xxhash64(key), key).limit(most)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written to a new_path() and is read no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have."""
    taken = {c.lower() for c in df.columns}
    names = (f"_c{i}" for i in itertools.count())
    return list(itertools.islice((c for c in names if c not in taken), n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than cores (a file of one row group) is dealt to all cores, larger ones are not moved."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- bytes, words

_ASCII = np.arange(256)
#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower case.
NOT_ALNUM = (_ASCII < 128) & ~(((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 97) & (_ASCII <= 122)))
#: A-Z to a-z.
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _pow(n: int, sign: int) -> np.ndarray:
    """_BASE ** (sign * i) mod 2**64 for i < n at least, for sums over windows of values that are hashes already or are compared by bytes later."""
    have = _powers[sign]
    if len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), _BASE if sign > 0 else _BASE_INV, np.uint64)
        steps[0] = 1
        _powers[sign] = have = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK):
    """Ranges of texts with about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (one more entry than texts)."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    b = offs[:-1][offs[:-1] < len(data)]
    first[b] = inside[b]
    b = offs[1:][offs[1:] > 0] - 1
    last[b] = inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Words of more bytes are hashed by a cryptographic function, one at a time.
LONG = 256
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F)
#: _KEEP[k]: the low k bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray):
    """A function of places: the eight bytes from each on, as one number; those beyond the end are zero."""
    whole = np.zeros(len(data) + 8, np.uint8)
    whole[: len(data)] = data
    from_each = np.ndarray((len(data) + 1,), "<u8", whole.data, 0, (1,))
    return from_each.__getitem__


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time through mix(), chained, the length last; a chunk of bytes at a time; starts ascend.

    Every lane is mixed before the next one is added, so sums over letters
    that are equal in two words don't make their hashes equal.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
        size, origin = ends[i:j] - starts[i:j], starts[i]
        n = np.minimum(size, LONG)
        place = starts[i:j] - origin
        at = lanes(data[origin : min(len(data), int(starts[j - 1]) + LONG)])
        h = mix(at(place) & _KEEP[np.minimum(n, 8)])
        some, step = np.flatnonzero(n > 8), 8
        while len(some):
            h[some] = mix(h[some] * _STEP + (at(place[some] + step) & _KEEP[np.minimum(n[some] - step, 8)]))
            step += 8
            some = some[n[some] > step]
        out[i:j] = mix(h + n.astype(np.uint64) * _LENGTH)
        for k in np.flatnonzero(size > LONG).tolist():
            word = data[starts[i + k] : ends[i + k]].tobytes()
            out[i + k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        i = j
    return out


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether data[start:end] is other[start:end], byte by byte, for each pair of places."""
    ok = ends - starts == other_ends - other_starts
    some, step = np.flatnonzero(ok), 0
    x, y = lanes(data), lanes(other)
    while len(some):
        left = ends[some] - starts[some] - step
        some, left = some[left > 0], left[left > 0]
        same = ((x(starts[some] + step) ^ y(other_starts[some] + step)) & _KEEP[np.minimum(left, 8)]) == 0
        ok[some[~same]] = False
        some = some[same]
        step += 8
    return ok


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, by first word; those that leave a text are the caller's to skip."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m])
    return h


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct hash, and for each place which of these it equals; far faster than np.unique.

    One sort of hash prefixes with the place in the low bits. A hash may be
    listed more than once if another shares its prefix.
    """
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    ranked = h[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(h)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return order[fresh], back


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spark_ints(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's long."""
    return pa.array(x.view(np.int64))


def mark(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0

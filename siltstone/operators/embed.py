"""Embedding providers and the batched embedding operator.

A provider turns texts into float64 rows. HashProvider is a deterministic
signed bag of words: lexical, not semantic. OnnxProvider runs a sentence model
from files (none is shipped): truncation, masked mean pooling, L2.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 32
DIMENSION = 384


#: By dimension, what HashProvider knows of words; it outlives a task, as Spark uses a worker again.
_places: dict[int, dict[str, int]] = {}


class HashProvider:
    """Words at ASCII spaces, lower-cased; md5 gives bucket (first 8 hex digits) and sign (the next digit)."""

    #: Words whose place a worker keeps: the first, as words that recur come early.
    KEPT = 200_000

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        #: Twice the bucket, and 1 more where the sign is negative.
        self._known = _places.setdefault(dimension, {})

    def __getstate__(self):
        return {"dimension": self.dimension}

    def __setstate__(self, state):
        self.__init__(**state)

    def _place(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        return int.from_bytes(h[:4]) % self.dimension * 2 + (h[4] >= 128)

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [[w for w in t.lower().split(" ") if w] for t in texts]
        known = self._known
        new = {w: self._place(w) for w in {w for ws in words for w in ws if w not in known}}
        if len(known) + len(new) <= self.KEPT:
            known.update(new)
        n, places = self.dimension, [known[w] if w in known else new[w] for ws in words for w in ws]
        at, sign = np.divmod(np.array(places, np.int64), 2)
        cells = at + np.repeat(np.arange(len(texts)) * n, [len(ws) for ws in words])
        out = np.bincount(cells, 1.0 - 2 * sign, len(texts) * n).reshape(len(texts), n)
        return l2(out)


class OnnxProvider:
    """A sentence model by paths of an ONNX file and a tokenizers JSON file; loaded on first use, once in a worker."""

    def __init__(self, model: str, tokenizer: str, max_length: int = 512):
        self.model, self.tokenizer, self.max_length = model, tokenizer, max_length

    def _load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        self._tok = Tokenizer.from_file(self.tokenizer)
        self._tok.enable_truncation(self.max_length)
        self._tok.enable_padding()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_session", "_tok")}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not hasattr(self, "_session"):
            self._load()
        enc = self._tok.encode_batch(texts)
        feed = {"input_ids": np.array([e.ids for e in enc], np.int64), "attention_mask": np.array([e.attention_mask for e in enc], np.int64), "token_type_ids": np.array([e.type_ids for e in enc], np.int64)}
        names = {i.name for i in self._session.get_inputs()}
        hidden = self._session.run(None, {k: v for k, v in feed.items() if k in names})[0]
        return l2(mean_pool(hidden, feed["attention_mask"]))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token vectors that the mask lets through."""
    m = mask[:, :, None].astype(np.float64)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def l2(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, provider=None, batch: int = BATCH) -> DataFrame:
    """df with embedding (binary half precision), dimension, norm (of the half values), batch_ms and batch_size.

    Texts go to the provider in slices of `batch`; null is the empty text. The
    provider is loaded before the clock starts.
    """
    provider = provider or HashProvider()
    names = [c for c in df.columns if c not in ("embedding", "dimension", "norm", "batch_ms", "batch_size")]
    df = df.select(names)

    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider([""])
        for rows in batches:
            texts = [t or "" for t in rows.column(at).to_pylist()]
            vectors, ms, size = [], [], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                began = time.perf_counter()
                with np.errstate(over="ignore"):
                    vectors.append(np.asarray(provider(part)).astype("<f2"))
                ms += [(time.perf_counter() - began) * 1000] * len(part)
                size += [len(part)] * len(part)
            if not texts:
                continue
            v = np.concatenate(vectors)
            width = v.shape[1] * 2
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.arange(len(v) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(v))])
            cols = [packed, pa.array(np.full(len(v), v.shape[1], np.int32)), pa.array(np.linalg.norm(v.astype(np.float64), axis=1)), pa.array(ms), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *cols], [*names, "embedding", "dimension", "norm", "batch_ms", "batch_size"])

    schema = T.StructType(list(df.schema.fields)).add("embedding", "binary").add("dimension", "integer").add("norm", "double").add("batch_ms", "double").add("batch_size", "integer")
    return df.mapInArrow(run, schema)


def counters(df: DataFrame) -> DataFrame:
    """What a run of embed() did: total_embeddings, dimension (null without any), batches and latency_ms. A new run counts anew, so there is nothing to reset."""
    per = 1 / F.col("batch_size")
    return df.agg(F.count("embedding").alias("total_embeddings"), F.max("dimension").alias("dimension"), F.coalesce(F.round(F.sum(per)).cast("long"), F.lit(0)).alias("batches"), F.coalesce(F.sum(F.col("batch_ms") * per) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("latency_ms"))


def latency(df: DataFrame) -> DataFrame:
    """latency_ms: mean milliseconds a text over all batches; 0 without any. Each row carries its batch's time, so it weighs 1 / batch_size."""
    return df.agg(F.coalesce(F.sum(F.col("batch_ms") / F.col("batch_size")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("latency_ms"))


def pooled(tokens: DataFrame, by: list[str], vector: str, mask: Column) -> DataFrame:
    """Masked mean of `vector` over the rows of each group, as columns by + pooled (array<double>); native."""
    m = mask.cast("double")
    long = tokens.select(*by, m.alias("_m"), F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(*by, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_v"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("pooled"))

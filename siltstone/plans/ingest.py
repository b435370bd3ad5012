"""From files to stored chunks: extract, split, embed, store, and a result row for each file."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import native
from siltstone.functions.token_count import TokenLength, token_length
from siltstone.operators.embed import HashProvider, embed
from siltstone.operators.splitter import Splitter
from siltstone.operators.store import VectorStore
from siltstone.sources import records


log = logging.getLogger("siltstone")


@dataclass
class Config:
    chunk_size: int = 512
    chunk_overlap: int = 51
    tokens: str = "byte_bpe_50k"
    #: What chunk_size and chunk_overlap count; tokens by default.
    length: Callable[[str], int] | None = None
    provider: object = field(default_factory=HashProvider)
    #: Ids are stem_0000, as two files of one stem overwrite each other; True puts a hash of the path before the index.
    unique_ids: bool = False
    #: Whether a file's old chunks go before its new ones are stored.
    replace_source: bool = False

    def splitter(self) -> Splitter:
        return Splitter(self.chunk_size, self.chunk_overlap, length=self.length or TokenLength(self.tokens))


def failures(extracted: DataFrame) -> DataFrame:
    """extracted with `failure`: why a file yields no chunks; null if it does."""
    blank = ~F.coalesce("text", F.lit("")).rlike(native.INK)
    return extracted.withColumn("failure", F.when(F.col("error").isNotNull(), F.concat(F.lit("Extraction error: "), F.col("error"))).when(blank, "No text content extracted from document"))


def chunk_rows(good: DataFrame, config: Config) -> DataFrame:
    """A row for each chunk of files (path, filename, stem, text, page_count, seq): id, text, metadata, seq."""
    rows = config.splitter().documents(good, metadata=F.lit(None))
    name = F.concat_ws("_", "stem", F.substring(F.sha2("path", 256), 1, 16)) if config.unique_ids else F.col("stem")
    # a chunk's size is its count of tokens, unless the caller counts something else
    tokens = F.col("chunk_size") if config.length is None else token_length("content", config.tokens)
    meta = F.struct(F.col("path").alias("source"), "filename", "chunk_index", "total_chunks", tokens.alias("token_count"), "page_count")
    return rows.select("path", native.chunk_id(name, F.col("chunk_index")).alias("id"), F.col("content").alias("text"), meta.alias("metadata"), (F.col("seq").cast("long") * F.lit(1 << 24).cast("long") + F.col("chunk_index")).alias("seq"))


def results(files: DataFrame, embedded: DataFrame, seconds: float, memory_mb: float) -> DataFrame:
    """Result rows (see schemas.RESULT) in input order, with seq. Times are the run's, dealt to files that have chunks."""
    # dealt by file first: lists gathered before that would be as many as there are chunks, as these lie spread
    own = embedded.select(F.col("path").alias("_p"), "seq", "id", F.col("embedding").isNotNull().alias("there"), (F.col("batch_ms") / F.col("batch_size")).alias("ms")).repartition("_p")
    per = own.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("ids"), F.count_if("there").alias("stored"), F.avg("ms").alias("ms"))
    done = files.join(per, F.col("path") == F.col("_p"), "left")
    n, ok = F.coalesce(F.size("ids"), F.lit(0)), F.col("failure").isNull() & F.col("_p").isNotNull()
    error = F.coalesce("failure", F.when(F.col("_p").isNull(), F.lit("No chunks created from text")))
    number = lambda x, d: F.when(ok, F.round(x, d)).otherwise(0.0).cast("double")
    rate = F.lit(seconds).cast("double")
    return done.select(
        F.col("path").alias("file"), F.when(ok, n).otherwise(0).alias("total_chunks"), F.coalesce("stored", F.lit(0)).cast("int").alias("vectors_stored"),
        number(rate, 3).alias("processing_time_sec"), number(F.when(rate > 0, F.col("page_count") / rate).otherwise(0.0), 2).alias("pages_per_sec"),
        number(F.lit(memory_mb), 2).alias("memory_mb"), number(F.col("ms"), 2).alias("embedding_latency_ms"),
        F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<string>")).alias("chunk_ids"), F.filter(F.array(error), lambda e: e.isNotNull()).alias("errors"), "seq",
    )


def processed_count(results: DataFrame) -> DataFrame:
    """processed: the files of result rows that were ingested without an error."""
    return results.agg(F.count(F.when(F.size("errors") == 0, True)).alias("processed"))


def ingest_files(files: DataFrame, store: VectorStore, config: Config | None = None) -> DataFrame:
    """Ingest files (path, content, seq) and store their chunks; returns result rows, ordered by seq, computed.

    Files with an error don't stop others. The chunks of a batch become one
    generation. Chunks are spread anew before they are embedded, as one file
    can have most of them. Results, which name every chunk, stay beside the
    store and never come to the driver.
    """
    import resource

    config = config or Config()
    began = time.perf_counter()
    log.info("extracting and splitting")
    extracted = failures(records.extract(files)).persist()
    chunks = chunk_rows(extracted.where(F.col("failure").isNull()), config)
    embedded = embed(chunks.repartition(F.col("id")), "text", config.provider).persist()
    try:
        if config.replace_source and store.exists():
            store.delete_sources(extracted.where(F.col("failure").isNull()).select("path"))
        if embedded.count():
            log.info("storing chunks in %s", store.path)
            log.info("stored %d vectors", store.store(embedded))
        memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        out = results(extracted, embedded, time.perf_counter() - began, memory)
        at = f"{store.path}/_results/{uuid.uuid4().hex}"
        out.write.parquet(at)
        log.info("results are in %s", at)
        return files.sparkSession.read.schema(f"{schemas.RESULT}, seq bigint").parquet(at).orderBy("seq").drop("seq")
    finally:
        extracted.unpersist()
        embedded.unpersist()


def ingest_paths(spark: SparkSession, paths: list[str], store: VectorStore, config: Config | None = None) -> DataFrame:
    """Result rows for paths in order. A path that can't be read is an error row."""
    listed = spark.createDataFrame([(str(Path(p).absolute()), i) for i, p in enumerate(paths)], "path string, seq bigint")
    there = sorted({str(Path(p).absolute()) for p in paths if Path(p).is_file()})
    if there:
        read = records.read_files(spark, *there)
        files = listed.join(read, "path", "left")
    else:
        files = listed.withColumn("content", F.lit(None).cast("binary"))
    return ingest_files(files, store, config)


def search_text(store: VectorStore, query: str, k: int = 5, provider=None) -> DataFrame:
    """The k chunks nearest to a text."""
    provider = provider or HashProvider()
    return store.search([float(x) for x in provider([query])[0]], k)

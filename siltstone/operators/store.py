"""The store: chunks and vectors in Parquet segments under a log of commits.

A write adds a segment with its own rows only (or with the ids that go) and
publishes it by one entry of the log, so an upsert costs what it brings, and of
two writers at once both get in, the later entry winning for ids they share. A
reader takes the state of the log when it asks and merges: rows of the base
segments, which lie in folders by hash bucket, but for the ids that newer
segments hold, and of these the newest. Compaction merges buckets that have
newer rows into new base folders and touches no others; writes that come
meanwhile stay newer. Nothing that a reader may be reading is changed; vacuum()
deletes what the current state doesn't use.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators.commits import Folder, Log

#: Hash buckets of base segments; newer segments from which on a write compacts.
BUCKETS, NEWER = 32, 16
#: The entry's number is above these bits of ingest_seq, a row's place in its write below.
PLACE = 44


def last_wins(incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: that of the highest seq. The aggregate combines on the map side, so a hot key costs one row a task."""
    rest = [c for c in incoming.columns if c != key]
    best = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(*(F.col(f"_r.{c}").alias(c) if c != key else F.col(key) for c in incoming.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """existing with the rows of incoming in place of those of the same key; last wins within incoming too."""
    new = last_wins(incoming, key, seq)
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def without(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """existing but for the keys in ids (column id)."""
    return existing.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(existing.columns)


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class State:
    """What the log's entries up to `version` lead to.

    base: the segment of each bucket. through: up to which entry it is merged.
    newer: (entry, segment, kind, buckets) of what is not merged everywhere.
    """

    version: int = 0
    base: dict[int, str] = field(default_factory=dict)
    through: dict[int, int] = field(default_factory=dict)
    newer: list[tuple[int, str, str, list[int]]] = field(default_factory=list)
    cleared: int = 0

    def add(self, n: int, entry: dict) -> None:
        kind = entry["kind"]
        if kind == "clear":
            self.base, self.through, self.newer, self.cleared = {}, {}, [], n
        elif kind in ("upsert", "delete"):
            self.newer.append((n, entry["segment"], kind, entry["buckets"]))
        elif entry["through"] >= self.cleared:  # a merge of what was cleared meanwhile is void
            for b in entry["buckets"]:
                if entry["through"] > self.through.get(b, -1):
                    self.base[b], self.through[b] = entry["segment"], entry["through"]
            self.newer = [x for x in self.newer if any(self.through.get(b, -1) < x[0] for b in x[3])]
        self.version = n

    def dump(self) -> dict:
        return {"version": self.version, "base": list(self.base.items()), "through": list(self.through.items()), "newer": self.newer, "cleared": self.cleared}

    @staticmethod
    def of(saved: dict | None) -> State:
        if not saved:
            return State()
        return State(saved["version"], dict(saved["base"]), dict(saved["through"]), [tuple(x) for x in saved["newer"]], saved["cleared"])


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    # ------------------------------------------------------------ states

    def generation(self) -> int:
        """The number of the last commit; 0 if the store is new."""
        return self.log.latest()

    def exists(self) -> bool:
        return self.generation() > 0

    def state(self, version: int | None = None) -> State:
        """The state now, or after commit `version`, as long as vacuum() has not forgotten it."""
        saved, entries = self.log.entries(version)
        state = State.of(saved)
        for n, entry in entries:
            state.add(n, entry)
        return state

    def _segment(self) -> str:
        return f"s-{uuid.uuid4().hex}"

    def _at(self, segment: str, name: str) -> str:
        return f"{self.path}/data/{segment}/{name}"

    def _base(self, state: State, name: str, schema: str, buckets: list[int] | None) -> DataFrame | None:
        out = None
        for segment in sorted(set(state.base.values())):
            own = [b for b, s in state.base.items() if s == segment and (buckets is None or b in buckets)]
            if own:
                rows = self.spark.read.schema(f"{schema}, bucket int").parquet(self._at(segment, name)).where(F.col("bucket").isin(own)).drop("bucket")
                out = rows if out is None else out.union(rows)
        return out

    def _newer(self, state: State, name: str, key: str, schema: str, buckets: list[int] | None) -> DataFrame | None:
        """key, row (null: gone): the newest of each key in the newer segments."""
        out = None
        for n, segment, kind, own in state.newer:
            if buckets is not None and not set(own) & set(buckets):
                continue
            row = F.struct(*(F.col(c).alias(c) if c != "ingest_seq" else (F.lit(n << PLACE) + F.col(c)).alias(c) for c in self.spark.createDataFrame([], schema).columns))
            if kind == "upsert":
                rows = self.spark.read.schema(f"{schema}, bucket int").parquet(self._at(segment, name)).select(F.col(key).alias("_key"), "bucket", row.alias("row"))
            else:
                none = F.lit(None).cast(f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in self.spark.createDataFrame([], schema).schema)}>")
                rows = self.spark.read.schema("id string, bucket int").parquet(self._at(segment, "gone")).select(F.col("id").alias("_key"), "bucket", none.alias("row"))
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
            if merged := [b for b in own if state.through.get(b, -1) >= n]:
                rows = rows.where(~F.col("bucket").isin(merged))
            rows = rows.select("_key", "row", F.lit(n).alias("n"))
            out = rows if out is None else out.union(rows)
        if out is None:
            return None
        # the struct is never null itself, so a row that is gone wins, too
        return out.groupBy("_key").agg(F.max_by(F.struct("row"), "n").alias("r")).select("_key", F.col("r.row").alias("row"))

    def _merged(self, state: State, name: str, key: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        base, newer = self._base(state, name, schema, buckets), self._newer(state, name, key, schema, buckets)
        empty = self.spark.createDataFrame([], schema)
        if newer is None:
            return empty if base is None else base
        there = newer.where(F.col("row").isNotNull()).select("row.*")
        if base is None:
            return there
        return base.join(newer.select("_key"), F.col(key) == F.col("_key"), "left_anti").select(empty.columns).union(there)

    def chunks(self, version: int | None = None) -> DataFrame:
        return self._merged(self.state(version), "chunks", "id", schemas.CHUNKS)

    def vectors(self, version: int | None = None) -> DataFrame:
        return self._merged(self.state(version), "vectors", "chunk_id", schemas.VECTORS)

    # ------------------------------------------------------------ changes

    def open(self) -> VectorStore:
        """Create an empty store if there is none."""
        if not self.exists():
            self.clear()
        return self

    def store(self, records: DataFrame) -> int:
        """Upsert records (id, text, metadata, embedding, dimension, norm, seq); returns how many were stored whole.

        seq orders records: the last of an id wins. A record without id or
        text is left out; one without embedding stores its chunk only and is
        not counted. created_at is that of this call.
        """
        rows = records.where(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("bucket", bucket("id")).withColumn("ingest_seq", F.col("seq").cast("long"))
        if not (held := records.is_cached):
            rows = rows.persist()  # both datasets and the count come of them
        whole = rows.where(F.col("embedding").isNotNull())
        vectors = whole.select(F.col("id").alias("chunk_id"), "embedding", "dimension", F.lit("float16").alias("dtype"), "norm", "ingest_seq", "bucket")
        chunks = rows.select("id", "text", "metadata", F.current_timestamp().alias("created_at"), "ingest_seq", "bucket")
        try:
            stored, touched = rows.agg(F.count("embedding"), F.collect_set("bucket")).first()
            if touched:
                segment = self._segment()
                last_wins(chunks, "id", "ingest_seq").write.parquet(self._at(segment, "chunks"))
                last_wins(vectors, "chunk_id", "ingest_seq").write.parquet(self._at(segment, "vectors"))
                self._commit({"kind": "upsert", "segment": segment, "buckets": sorted(touched)})
            else:
                self.open()
        finally:
            if not held:
                rows.unpersist()
        return stored

    def _commit(self, entry: dict) -> int:
        n = self.log.append(entry)
        if len(self.state().newer) >= NEWER:
            self.compact()
        return n

    def _gone(self, ids: DataFrame) -> bool:
        ids = ids.where(F.col("id").isNotNull()).distinct().withColumn("bucket", bucket("id"))
        segment = self._segment()
        ids.write.parquet(self._at(segment, "gone"))
        touched = [r[0] for r in self.spark.read.schema("id string, bucket int").parquet(self._at(segment, "gone")).select("bucket").distinct().collect()]
        if touched:
            self._commit({"kind": "delete", "segment": segment, "buckets": sorted(touched)})
        return True

    def delete(self, *ids: str) -> bool:
        """Remove ids from both datasets; true also if they were not there."""
        return self._gone(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_source(self, source: str) -> bool:
        """Remove the chunks of one source file, for use before it is ingested anew."""
        return self.delete_sources(self.spark.createDataFrame([(source,)], "path string"))

    def delete_sources(self, sources: DataFrame) -> bool:
        """Remove the chunks of all source files in `sources` (path) in one write."""
        return self._gone(self.chunks().join(sources.select("path").distinct(), F.col("metadata.source") == F.col("path"), "left_semi").select("id"))

    def clear(self) -> None:
        self.log.append({"kind": "clear"})

    def compact(self) -> list[int]:
        """Merge the buckets that newer segments touch into a new base segment; returns these buckets. What is written meanwhile stays newer."""
        state = self.state()
        touched = sorted({b for n, _, _, own in state.newer for b in own if state.through.get(b, -1) < n})
        if touched:
            segment = self._segment()
            for name, key, schema in (("chunks", "id", schemas.CHUNKS), ("vectors", "chunk_id", schemas.VECTORS)):
                rows = self._merged(state, name, key, schema, touched).withColumn("bucket", bucket(key))
                rows.repartition(min(len(touched), BUCKETS), "bucket").write.partitionBy("bucket").parquet(self._at(segment, name))
            n = self.log.append({"kind": "compact", "segment": segment, "buckets": touched, "through": state.version})
            self.log.save(n, self.state(n).dump())
        return touched

    def vacuum(self, grace: float = 86_400.0) -> None:
        """Delete segments and log entries that the current state doesn't need; no reader of an older state may be left. Segments younger than `grace` seconds stay, as their writer may not have published them yet."""
        state = self.state()
        used = {*state.base.values(), *(x[1] for x in state.newer)}
        data = Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            if name not in used and data.age(name) >= grace:
                data.delete(name)
        self.log.save(state.version, state.dump())
        self.log.forget(state.version)

    # ------------------------------------------------------------ reading

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """id, change (added, removed, changed), text and metadata after it: what commits after `since` did to chunks; what came and went again is left out.

        Reads the segments of these commits, and of the states only ids in them.
        """
        old, new = self.state(since), self.state(until)
        if new.cleared > since or any(n > since for n in new.through.values()):
            touched = None  # merged or cleared since: any id may have changed
        else:
            touched = self._newer(State(new.version, newer=[x for x in new.newer if x[0] > since]), "chunks", "id", schemas.CHUNKS, None)
            if touched is None:
                return self.chunks(until).limit(0).select("id", F.lit("").alias("change"), "text", "metadata")

        def side(state, name):
            rows = self._merged(state, "chunks", "id", schemas.CHUNKS)
            if touched is not None:
                rows = rows.join(touched.select(F.col("_key").alias("id")), "id", "left_semi")
            return rows.select("id", F.struct("text", "metadata", F.xxhash64("text", F.to_json("metadata")).alias("h")).alias(name))

        both = side(old, "a").join(side(new, "b"), "id", "full_outer")
        differs = F.col("a").isNull() | F.col("b").isNull() | (F.col("a.h") != F.col("b.h")) | (F.col("a.text") != F.col("b.text"))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        return both.where(differs).select("id", change.alias("change"), F.col("b.text").alias("text"), F.col("b.metadata").alias("metadata"))

    def stats(self) -> dict:
        return {"chunk_count": self.chunks().count(), "vector_count": self.vectors().count(), "db_path": self.path}

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        """id, text, score, metadata of the k nearest, best first; metadata that is null becomes an empty struct."""
        from siltstone.operators import search

        hits = search.topk_packed(self.vectors(), query, k).select("chunk_id", "score", F.col("ingest_seq").alias("_seq"))
        found = search.lookup(hits, self.chunks())
        return found.orderBy(F.desc("score"), "_seq").select("id", "text", "score", "metadata")

"""Fixed schemas of the document store."""

from __future__ import annotations

from pyspark.sql import types as T

#: Format-specific facts; one nullable struct for all formats keeps list and integer types.
EXTRACT_META = (
    T.StructType()
    .add("format", "string")
    .add("tables_found", "integer")
    .add("sheets", T.ArrayType(T.StringType()))
    .add("total_rows", "long")
    .add("record_count", "long")
    .add("record_types", T.ArrayType(T.StringType()))
    .add("partial", "boolean")
)
EXTRACTED = T.StructType().add("text", "string").add("page_count", "integer").add("error", "string").add("metadata", EXTRACT_META)
CHUNK_META = "struct<source:string,filename:string,chunk_index:int,total_chunks:int,token_count:int,page_count:int>"
CHUNKS = f"id string, text string, metadata {CHUNK_META}, created_at timestamp, ingest_seq bigint"
#: norm is that of the half-precision values, stored so that a search need not compute it again.
VECTORS = "chunk_id string, embedding binary, dimension int, dtype string, norm double, ingest_seq bigint"
RESULT = "file string, total_chunks int, vectors_stored int, processing_time_sec double, pages_per_sec double, memory_mb double, embedding_latency_ms double, chunk_ids array<string>, errors array<string>"

"""Command line: ingest, search, stats."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import native
from siltstone.operators.store import VectorStore
from siltstone.plans import ingest


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siltstone").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_ingest(args) -> int:
    store = VectorStore(session(), str(Path(args.output).absolute() / "vectors"))
    if args.verbose:
        logging.basicConfig(stream=sys.stderr, format="%(message)s")
        logging.getLogger("siltstone").setLevel(logging.INFO)
    rows = [r.asDict() for r in ingest.ingest_paths(store.spark, args.input, store).collect()]
    Path(args.output).mkdir(parents=True, exist_ok=True)
    out = Path(args.output) / "ingestion_result.json"
    out.write_text(json.dumps(rows[0] if len(rows) == 1 else rows, indent=2))
    for r in rows:
        for name, value in (("File", r["file"]), ("Total Chunks", r["total_chunks"]), ("Vectors Stored", r["vectors_stored"]), ("Processing Time", f"{r['processing_time_sec']:.2f} seconds"), ("Pages/Second", f"{r['pages_per_sec']:.2f}"), ("Peak Memory", f"{r['memory_mb']:.1f} MB"), ("Avg Embedding Latency", f"{r['embedding_latency_ms']:.1f} ms"), ("Errors", r["errors"] or "-")):
            print(f"{name:<22} {value}")
    print(f"Results saved to: {out}")
    return int(any(r["errors"] for r in rows))


def run_search(args) -> int:
    store = VectorStore(session(), str(Path(args.db).absolute()))
    if not store.exists():
        print(f"no store at {store.path}", file=sys.stderr)
        return 2
    hits = ingest.search_text(store, args.query, args.top_k).select("id", "score", native.preview("text").alias("text"), native.badge("score").alias("badge"), F.monotonically_increasing_id().alias("n"))
    rows = hits.collect()
    for i, r in enumerate(rows, 1):
        print(f"Result {i} (Score: {r['score']:.3f}) [{r['badge']}]\n{r['text']}\nID: {r['id']}\n")
    if not rows:
        print("No results found.")
    return 0


def run_stats(args) -> int:
    store = VectorStore(session(), str(Path(args.db).absolute()))
    if not store.exists():
        print(f"no store at {store.path}", file=sys.stderr)
        return 2
    s = store.stats()
    for name, key in (("Total Chunks", "chunk_count"), ("Total Vectors", "vector_count"), ("Database Path", "db_path")):
        print(f"{name:<16} {s[key]}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    sub = p.add_subparsers(required=True)
    q = sub.add_parser("ingest", help="extract, split, embed and store files (PDF, DOCX, XLSX, XML)")
    q.add_argument("-i", "--input", nargs="+", required=True)
    q.add_argument("-o", "--output", default="./output")
    q.add_argument("-v", "--verbose", action="store_true")
    q.set_defaults(run=run_ingest)
    q = sub.add_parser("search", help="nearest chunks to a text")
    q.add_argument("-q", "--query", required=True)
    q.add_argument("-k", "--top-k", type=int, default=5)
    q.add_argument("-d", "--db", default="./output/vectors")
    q.set_defaults(run=run_search)
    q = sub.add_parser("stats", help="counts of a store")
    q.add_argument("-d", "--db", default="./output/vectors")
    q.set_defaults(run=run_stats)
    args = p.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

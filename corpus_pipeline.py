"""The corpus pipeline: five stages from documents to packed sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, minhash, ordinal, packing, passages
from siltstone.llm.common import drop_path, fresh, new_path, prepare, table

#: SQL can express neither the classifier nor the tokenizer; tests/llm/ compares stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier (8), learned from labels, keeps.

    Null, empty and very long texts are graded like others; repeated rows and
    ties stay or go together; without labels of two grades all stay. Columns
    stay as they are, whatever their names. An empty table gives no rows.
    """
    (verdict,) = fresh(docs, 1)
    model = ordinal.learn(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return ordinal.grade(docs, model, verdict).where(F.col(f"{verdict}.kept")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (1): five-word shingles, similarity of 0.8 or more; the least doc_id stays.

    Null and wordless texts and rows without doc_id have no duplicates and
    stay; rows that repeat a doc_id stay or go together. Very long texts are
    compared whole. Columns stay as they are; an empty table gives no rows.
    """
    (gone,) = fresh(docs, 1)
    left = minhash.link(docs, 5, 80).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(left, F.col("doc_id") == F.col(gone), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents (5) are cut from all but the first.

    Null, empty and short texts stay; a document that loses all its words goes.
    Repeated rows are cut alike; rows of one doc_id with other texts are
    documents of their own. Columns but text and n_chars stay as they are.
    """
    return passages.remove(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item (4).

    Null and wordless texts stay; repeated rows stay or go together; very long
    texts are searched whole. Without items all stay. Columns stay as they are.
    """
    (hit,) = fresh(docs, 1)
    return decontam.flag(docs, table(spark, sf_dir, "benchmark"), into=hit).where(~F.col(f"{hit}.contaminated")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, mixed by source (3), with their ids.

    A null or empty text is a document of the end id alone; see packing.pack().
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is in the shared folder, and goes once the next stage is there."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` applies them one after the other, each on what the one before
kept, written to the shared folder in between. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import discard, materialize, scope, table
from veilspark.llm.op2_quality_rules import keep_good
from veilspark.llm.op3_suffix_dedup import remove_repeats
from veilspark.llm.op5_exact_dedup import keep_one
from veilspark.llm.op6_minhash import near_duplicates
from veilspark.llm.op10_packing import pack

#: Percent of common word shingles from which two documents are near-duplicates here; the query op6_minhash has its own, 85.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return keep_one(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), that of the smallest id."""
    gone = near_duplicates(docs, percent=NEAR).where("NOT kept").select(F.col("doc_id").alias("gone"))
    gone = materialize(gone, "gone")  # plain ids of known size: a few are sent to the texts, many meet them in a sorted join
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")  # a row with a null id stays


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; n_chars follows the new text, an emptied document stays."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicate_groups),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: Label estimation, near-duplicate components, byte spans and packing have no SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():
            kept = materialize(stage(spark, docs, sf_dir), name, outer=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication with DataFrame operations only.

Three combining stages, each of which groups by the full content and not by a digest alone:

1. *local*: Spark's partial aggregation combines the copies inside each input partition;
2. *salted*: the survivors meet by (digest, salt, content), so that a text that makes up a third of
   all rows is spread over ``salts`` groups;
3. *global*: the salt winners of each content, at most ``salts`` rows of it, are combined.

The verdicts go back to the rows by a join of plain (id, digest, salt) rows on the 256-bit digest and the salt: the combining
stages note which salts of a digest have rows, and its verdict is there once for each of them, so a hot digest is spread
over ``salts`` parts, and adaptive execution can split a part further. Two contents with one digest would make that join
wrong, so such a collision stops the job.

Defined results: null text counts as empty; empty texts are copies of one another; a repeated row with
the same id shares the verdict of its id; a null id never wins over another id; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, content, each_salt, salt_of, salts_met, table


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("content"))
    return base.withColumn("digest", F.unhex(F.sha2("content", 256))).withColumn("salt", salt_of("doc_id", salts=salts))


def combine(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, met), one row for each distinct content of ``keyed`` rows; met: the salts that have rows of it."""
    winners = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = winners.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), salts_met(F.col("salt")).alias("met"))
    by_digest = whole.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.bit_or("met").alias("met"))
    clash = F.raise_error(F.lit("two contents share one digest")).cast("bigint")
    return by_digest.select("digest", F.when(F.col("contents") > 1, clash).otherwise(F.col("keep_id")).alias("keep_id"), F.col("n").alias("group_size"), "met")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row; the largest id of equal texts stays."""
    rows = keyed(docs, id_col, text_col, salts)
    verdicts = combine(rows).select("digest", "keep_id", "group_size", each_salt(F.col("met"), salts).alias("salt"))
    out = rows.select("doc_id", "digest", "salt").join(verdicts, ["digest", "salt"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns, straight from the same three stages: no row goes back to a join. Of repeated rows
    with one id and text one stays."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").isNull().alias("none"))
    rows = docs.select(row.alias("row"), content(f"`{text_col}`").alias("content"), salt_of(id_col, salts=salts).alias("salt"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    last = F.struct(f"row.c{others.index(id_col)}")  # a struct, so that a null id is the least
    winners = rows.groupBy("digest", "salt", "content").agg(F.max_by("row", last).alias("row"))
    whole = winners.groupBy("digest", "content").agg(F.max_by("row", last).alias("row"))
    text = F.when(~F.col("row.none"), F.col("content")).alias(text_col)
    return whole.select(*[text if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

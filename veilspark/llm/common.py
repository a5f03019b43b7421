"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, materialize, scope, shared_dir, workspace

__all__ = ["WORD", "SALTS", "content", "crc_fold", "discard", "each_salt", "materialize", "salt_of", "salts_met", "scope", "shared_dir", "spread", "table", "workspace"]

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a hot key; at most 63, since they are noted in the bits of a long.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(id_col: str = "doc_id") -> Column:
    """crc32 of the decimal id, mod 5; 0 marks the held-out fold, in which a null id lies too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)), F.lit(0))


# Verdicts on groups go back to rows by a join on (key, salt): the rows of a key lie in SALTS parts, and the verdict is there
# once for each part that has rows. Both sides then have an exchange of their own, so that adaptive execution can split a part further.


def salt_of(*by: Column | str, salts: int = SALTS) -> Column:
    """The part of its key that a row lies in."""
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def _bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), salt)


def salts_met(salt: Column) -> Column:
    """An aggregate: the parts that have rows, as bits."""
    return F.bit_or(_bit(salt))


def each_salt(met: Column, salts: int = SALTS) -> Column:
    """One row for each part noted by ``salts_met``."""
    several = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: met.bitwiseAND(_bit(s)) != 0)
    return F.explode(F.when(F.bit_count(met) == 1, F.array(F.round(F.log2(met)).cast("int"))).otherwise(several))


def spread(rows: DataFrame, verdicts: DataFrame, key: str, *by: str) -> DataFrame:
    """rows joined with verdicts, unique by key, that are no aggregate of the rows; ``by`` tells the rows of one key apart. The join is
    the same at every size."""
    salted = rows.withColumn("_salt", salt_of(*by))
    met = salted.groupBy(key).agg(salts_met(F.col("_salt")).alias("_met"))
    each = verdicts.join(met, key).withColumn("_salt", each_salt(F.col("_met"))).drop("_met")
    return salted.join(each.hint("merge"), [key, "_salt"]).drop("_salt")

"""Writers of pairs, series, reports and attribute-relation files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnonymizerConfig
from ..functions.scalar import record_text
from ..schema import NUMERIC, Attribute, StreamSchema


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, sep: str = ",", header: bool = True) -> None:
    """Part files in global order if ``order`` is given; readers that take them by name see that order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder. Rows with other fields than those before go to a folder of their own, named by their fields, so that no
    row is longer than its header."""
    name = hashlib.md5("\n".join(sorted(df.columns)).encode()).hexdigest()[:16]
    df.select(*sorted(df.columns)).write.mode("append").option("header", True).csv(f"{path}/{name}")


def write_pairs(pairs: DataFrame, schema: StreamSchema, path: str) -> None:
    """Originals and anonymized records in publication order, without the sequence."""
    write_csv(pairs.select("pub_seq", *[a.name for a in schema.quasi], "sensitive"), f"{path}/original", ["pub_seq"])
    write_csv(pairs.select("pub_seq", *[F.col(f"anon_{a.name}").alias(a.name) for a in schema.quasi], "sensitive"), f"{path}/anonymized", ["pub_seq"])


def write_record_pairs(pairs: DataFrame, schema: StreamSchema, path: str) -> None:
    """One line for each pair, both records as text, in publication order."""
    anon = record_text(schema, lambda n: F.col(f"anon_{n}") if n != schema.sensitive.name else F.col("sensitive"))
    own = record_text(schema, lambda n: F.col(n) if n != schema.sensitive.name else F.col("sensitive"))
    write_csv(pairs.select("pub_seq", own.alias("original"), anon.alias("anonymized")), path, ["pub_seq"])


def append_text(df: DataFrame, column: str, path: str) -> None:
    """Adds lines to a text folder; also fits ``foreachBatch``."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def write_series(series: DataFrame, path: str) -> None:
    """(run, time, metric): one folder for each run."""
    series.write.mode("append").partitionBy("run").option("header", True).csv(path)


def series_name(dataset: str, cfg: AnonymizerConfig, estimator: str) -> str:
    """The run under which a series is kept: data set, k, eps, l and estimator."""
    return f"{dataset}@{cfg.k}_{cfg.eps:g}_{cfg.l}_{estimator}"


def append_report(row: DataFrame, path: str) -> None:
    """One row for each run, all of one wide schema."""
    row.write.mode("append").parquet(path)


#: Distinct values of a numeric attribute that is declared as nominal.
MAX_NOMINAL = 1000


def nominal_values(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The sorted values of numeric attributes that are to be nominal; at most MAX_NOMINAL of each."""
    out = {}
    for n in names:
        found = [r[0] for r in df.select(n).where(F.col(n).isNotNull()).distinct().limit(MAX_NOMINAL + 1).collect()]
        if len(found) > MAX_NOMINAL:
            raise ValueError(f"{n} has over {MAX_NOMINAL} values; it stays numeric")
        out[n] = [str(v) for v in sorted(found)]
    return out


def arff_header(schema: StreamSchema, relation: str, nominal: dict[str, list[str]] | None = None) -> list[str]:
    def kind(a: Attribute) -> str:
        if a.kind == NUMERIC and a.name not in (nominal or {}):
            return "numeric"
        return "{" + ",".join(v.replace(" ", "") for v in (nominal or {}).get(a.name, a.values)) + "}"

    return [f"@relation {relation}", "", *(f"@attribute {a.name} {kind(a)}" for a in (*schema.quasi, schema.sensitive)), "", "@data"]


def write_arff(df: DataFrame, schema: StreamSchema, path: str, relation: str, order: str, nominal: list[str] = []) -> None:  # noqa: B006
    """A folder whose first part is the header and whose others are the records in order; concatenated by name they are one file.
    nominal: numeric attributes to declare by their values."""
    lines = df.select(F.col(order).alias("o"), record_text(schema).alias("value"))
    header = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("o"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(arff_header(schema, relation, nominal_values(df, nominal)))])).alias("h"))
    whole = header.select("o", F.col("h.i").alias("i"), F.col("h.v").alias("value")).unionByName(lines.select("o", F.lit(0).alias("i"), "value"))
    whole.orderBy(F.col("o").asc_nulls_first(), "i").select("value").write.mode("overwrite").text(path)

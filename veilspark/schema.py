"""Stream schemas: attribute kinds, weights and domains, from a side-car CSV or given in code."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, ORDINAL, NOMINAL = "numeric", "ordinal", "nominal"


@dataclass(frozen=True)
class Attribute:
    """One column: numeric (with a domain), ordinal (text ranks 1..max_rank) or nominal (with a value list)."""

    name: str
    kind: str = NUMERIC
    discrete: bool = False
    weight: float = 1.0
    lo: float | None = None
    hi: float | None = None
    max_rank: int | None = None
    values: tuple[str, ...] = ()
    mean: float | None = None
    std: float | None = None
    mad: float | None = None

    @property
    def span(self) -> float:
        return (self.hi or 0.0) - (self.lo or 0.0)

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == NUMERIC:
            return T.LongType() if self.discrete else T.DoubleType()
        return T.StringType()


@dataclass(frozen=True)
class StreamSchema:
    """The sequence column, the quasi-identifiers in order, and the sensitive attribute."""

    seq: str
    quasi: tuple[Attribute, ...]
    sensitive: Attribute

    @property
    def all_numeric(self) -> bool:
        return all(a.kind == NUMERIC for a in self.quasi)

    @property
    def all_nominal(self) -> bool:
        return all(a.kind == NOMINAL for a in self.quasi)

    def __getitem__(self, name: str) -> Attribute:
        return next(a for a in (*self.quasi, self.sensitive) if a.name == name)

    def counts(self) -> dict[str, int]:
        """How many quasi-identifiers are numeric and how many are not."""
        n = sum(a.kind == NUMERIC for a in self.quasi)
        return {"numeric": n, "categorical": len(self.quasi) - n}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(self.seq, T.LongType()), *(T.StructField(a.name, a.spark_type) for a in (*self.quasi, self.sensitive))])

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> StreamSchema:
        """Reads a side-car file with the columns Feature, Type, Val_Type, Weight, Max_Rank, Min_Val, Max_Val, Distinct_Val.

        The first row is the sequence, the last the sensitive attribute. The file has one row for each column of the stream."""
        kinds = "Feature string, Type string, Val_Type string, Weight double, Max_Rank int, Min_Val double, Max_Val double, Distinct_Val string"
        rows = spark.read.schema(kinds).option("header", True).csv(path).coalesce(1).collect()
        found = []
        for r in rows:
            kind = NUMERIC if r["Type"] == NUMERIC else r["Val_Type"]
            if kind not in (NUMERIC, ORDINAL, NOMINAL):
                raise ValueError(f"{r['Feature']}: {r['Type']} / {r['Val_Type']} is no attribute type")
            values = tuple(v.strip() for v in r["Distinct_Val"].strip()[1:-1].split(",")) if r["Distinct_Val"] else ()
            found.append(Attribute(r["Feature"], kind, r["Val_Type"] == "discrete", r["Weight"] if r["Weight"] is not None else 1.0, r["Min_Val"], r["Max_Val"], r["Max_Rank"], values))
        if len(found) < 3 or found[-1].kind == NUMERIC:
            raise ValueError("a stream needs a sequence, a quasi-identifier and a categorical sensitive attribute")
        return cls(found[0].name, tuple(found[1:-1]), found[-1])

    def enriched(self, df: DataFrame) -> StreamSchema:
        """With the mean, standard deviation, mean absolute deviation and, where not declared, the domain of the numeric attributes."""
        names = [a.name for a in self.quasi if a.kind == NUMERIC]
        if not names:
            return self
        stats = numeric_stats(df, names)
        rows = {r["attr"]: r for r in stats.collect()}  # one row for each attribute
        new = [
            replace(a, mean=rows[a.name]["mean"], std=rows[a.name]["std"], mad=rows[a.name]["mad"], lo=rows[a.name]["lo"] if a.lo is None else a.lo, hi=rows[a.name]["hi"] if a.hi is None else a.hi)
            if a.name in rows
            else a
            for a in self.quasi
        ]
        return replace(self, quasi=tuple(new))


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """attr, lo, hi, mean, std (sample), mad (mean absolute deviation from the mean): two passes over the columns."""
    col = lambda n: F.col(f"`{n}`").cast("double")
    first = df.agg(*[f(col(n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_samp))])
    # the one row of means meets every row for the second pass
    second = df.select(*[col(n).alias(f"x_{i}") for i, n in enumerate(names)]).join(F.broadcast(first), how="cross")
    mads = second.agg(*[F.avg(F.abs(F.col(f"x_{i}") - F.col(f"mean_{i}"))).alias(f"mad_{i}") for i in range(len(names))])
    one = F.broadcast(first).join(F.broadcast(mads), how="cross")
    parts = [F.struct(F.lit(n).alias("attr"), *[(F.col(f"{k}_{i}") + 0.0).alias(k) for k in ("lo", "hi", "mean", "std", "mad")]) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*parts)))

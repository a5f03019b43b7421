"""Centroids, frequencies and diversity of groups of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NUMERIC, Attribute


def mode_of(df: DataFrame, group: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equals the smallest. Counted by value first, so a big group is small by then."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    top = F.max("_n").alias("_top")
    best = counts.join(counts.groupBy(*group).agg(top), group).where("_n = _top") if group else counts.join(F.broadcast(counts.agg(top)), F.col("_n") == F.col("_top"))
    return best.groupBy(*group).agg(F.min(value).alias(name))


def centroids(df: DataFrame, group: list[str], attrs: list[Attribute]) -> DataFrame:
    """Mean of each numeric attribute and mode of each other one."""
    out = df.groupBy(*group).agg(F.count("*").alias("size"), *[F.avg(a.name).alias(a.name) for a in attrs if a.kind == NUMERIC])
    for a in attrs:
        if a.kind != NUMERIC:
            out = out.join(mode_of(df, group, a.name, a.name), group)
    return out


def running_centroid(x: str, group: list[str], order: str, true_mean: bool = False) -> Column:
    """The centroid after each record. In the incremental form the first record counts twice."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    total = F.sum(x).over(w)
    return total / n if true_mean else (F.first(x).over(w) + total) / (n + 1)


def floored_centroid(df: DataFrame, group: str, order: str, x: str) -> DataFrame:
    """The incremental centroid of whole numbers, each step cut down: a fold over the group's records in order, which holds one number."""
    from .drift import fold_shards

    def step():
        state = [0, 0]

        def act(v: int) -> list[tuple]:
            c, n = state
            state[:] = (v if not n else (c * (n + 1) + v) // (n + 2)), n + 1
            return [(state[0],)]

        return act

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return fold_shards(df, group, order, [x], step, f"{group} {kinds[group]}, at bigint, centroid bigint", last=True).select(group, "centroid")


def frequencies(df: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """(group, attr, value, n) of the categorical columns."""
    stacked = df.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("attr"), F.col(n).cast("string").alias("value")) for n in names])).alias("p"))
    return stacked.groupBy(*group, "p.attr", "p.value").agg(F.count("*").alias("n"))


def running_counts(value: str, domain: list[str], group: list[str], order: str) -> Column:
    """How often each domain value has come so far in the group, as an array in domain order."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.array(*[F.sum(F.when(F.col(value) == v, 1).otherwise(0)).over(w) for v in domain])


def most_frequent(counts: Column, domain: list[str]) -> Column:
    """The value of the greatest count; of equals the first of the domain."""
    return F.element_at(F.array(*[F.lit(v) for v in domain]), F.array_position(counts, F.array_max(counts)).cast("int"))


def recursive_diversity(counts: Column, l: int, c: float) -> Column:  # noqa: E741
    """(c, l)-diversity of counts: the greatest is under c times the sum from the l-th greatest on."""
    desc = F.sort_array(F.filter(counts, lambda n: n > 0), asc=False)
    tail = F.aggregate(F.slice(desc, l, F.greatest(F.size(desc) - l + 1, F.lit(0))), F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint"))
    return F.when(F.size(desc) < l, F.lit(False)).otherwise(F.element_at(desc, 1).cast("double") < F.lit(float(c)) * tail)


def entropy(counts: Column) -> Column:
    """In bits."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda s, n: s - n / total * F.log2(n / total))


def diversity(df: DataFrame, group: list[str], value: str, l: int, c: float) -> DataFrame:  # noqa: E741
    """Distinct, recursive and entropy l-diversity of each group, from its value counts."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n")).groupBy(*group).agg(F.collect_list("n").alias("counts"))
    return counts.select(
        *group,
        F.size("counts").cast("bigint").alias("n_distinct"),
        (F.size("counts") >= l).alias("distinct_ok"),
        recursive_diversity(F.col("counts"), l, c).alias("recursive_ok"),
        F.round(entropy(F.col("counts")), 6).alias("entropy"),
        (F.round(entropy(F.col("counts")), 9) > F.round(F.log2(F.lit(float(l))), 9)).alias("entropy_ok"),
    )


def activity(df: DataFrame, group: list[str], ts: Column) -> DataFrame:
    """(size - 1) / (sum of the seconds since the group's first record + 1)."""
    seconds = F.unix_micros(ts.cast("timestamp"))
    first = df.groupBy(*group).agg(F.count("*").alias("size"), F.min(seconds).alias("first"), F.sum(seconds.cast("decimal(38,0)")).alias("total"))
    elapsed = (F.col("total") - F.col("first") * F.col("size")).cast("double") / 1e6
    return first.select(*group, "size", F.round((F.col("size") - 1) / (elapsed + 1), 9).alias("activity"))

"""Scaling, clamping, typing and formatting of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NUMERIC, Attribute, StreamSchema


def minmax(a: Attribute, v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return (v - F.lit(float(a.lo))) / F.lit(float(a.span)) * F.lit(hi - lo) + F.lit(lo)


def zscore(v: Column, mean: Column, spread: Column) -> Column:
    """Standardized by a standard deviation or by a mean absolute deviation."""
    return (v - mean) / spread


def typed(a: Attribute, v: Column) -> Column:
    """As the attribute is published: whole numbers are cut towards 0."""
    if a.kind != NUMERIC:
        return v.cast("string")
    return v.cast("bigint") if a.discrete else v.cast("double")


def valid(a: Attribute, v: Column) -> Column:
    """Whether a value may be published: a number that is finite, whole if the attribute is discrete, and within the domain; else one of the
    declared values, if any are."""
    if a.kind != NUMERIC:
        return F.coalesce(v.isin(*a.values) if a.values else v.isNotNull(), F.lit(False))
    x = v.cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    if a.discrete:
        ok &= x == F.floor(x)
    if a.lo is not None and a.hi is not None:
        ok &= x.between(float(a.lo), float(a.hi))
    return F.coalesce(ok, F.lit(False))


def published(a: Attribute, v: Column) -> Column:
    """The value as published; one that is not valid stops the job."""
    return F.when(valid(a, v), typed(a, v)).otherwise(F.raise_error(F.concat(F.lit(f"{a.name}: not to be published: "), F.coalesce(v.cast("string"), F.lit("null")))).cast(a.spark_type))


def clamp(a: Attribute, v: Column) -> Column:
    return typed(a, F.least(F.greatest(v, F.lit(a.lo)), F.lit(a.hi)))


def one_hot(a: Attribute, v: Column) -> list[Column]:
    """One 0/1 column for each declared value."""
    return [F.when(v == x, 1).otherwise(0).alias(f"{a.name}_{x}") for x in a.values]


def record_text(schema: StreamSchema, col=F.col) -> Column:
    """The record as a line: whole numbers and text as they are, other numbers with 4 decimals, blanks removed."""
    parts = [F.format_string("%.4f", col(a.name)) if a.kind == NUMERIC and not a.discrete else F.coalesce(col(a.name).cast("string"), F.lit("")) for a in (*schema.quasi, schema.sensitive)]
    return F.replace(F.concat_ws(",", *parts), F.lit(" "), F.lit(""))


def duration(seconds: Column) -> Column:
    """HH:MM:SS and the greatest unit that is not 0."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    unit = F.when(h > 0, "hours").when(m > 0, "minutes").otherwise("seconds")
    return F.format_string("%02d:%02d:%02d %s", h, m, r, unit)

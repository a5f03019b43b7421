"""Distances between records, as column expressions. Attribute facts become literals when the plan is built.

x and y map an attribute name to a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NUMERIC, ORDINAL, Attribute, StreamSchema

Side = Callable[[str], Column]


def side(prefix: str = "") -> Side:
    return lambda name: F.col(f"`{prefix}{name}`")


def _total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0.0)


def interval(a: Attribute, x: Column, y: Column) -> Column:
    """Weighted share of the domain; 0 where the domain's greater bound is 0."""
    if max(a.lo or 0, a.hi or 0) == 0 or not a.span:
        return F.lit(0.0)
    return F.lit(a.weight) * F.abs(x - y) / F.lit(float(a.span))


def ordinal(a: Attribute, x: Column, y: Column, corrected: bool = False) -> Column:
    """Ranks scaled to 0..1, their difference weighted; uncorrected it is weighted and scaled by the rank range once more."""
    m = a.max_rank - 1
    z = lambda r: (r.cast("int") - 1) / F.lit(float(m))
    d = F.lit(a.weight) * F.abs(z(x) - z(y))
    return d if corrected else F.lit(a.weight) * d / F.lit(float(m))


def nominal(a: Attribute, x: Column, y: Column) -> Column:
    return F.when(x == y, F.lit(0.0)).otherwise(F.lit(float(a.weight)))


def feature(a: Attribute, x: Column, y: Column, corrected: bool = False) -> Column:
    if a.kind == NUMERIC:
        return interval(a, x, y)
    return ordinal(a, x, y, corrected) if a.kind == ORDINAL else nominal(a, x, y)


def scaled_euclidean(attrs: Sequence[Attribute], x: Side, y: Side) -> Column:
    return F.sqrt(_total([F.pow(interval(a, x(a.name), y(a.name)), 2) for a in attrs]) / F.lit(float(len(attrs))))


def mismatch_share(attrs: Sequence[Attribute], x: Side, y: Side) -> Column:
    return _total([F.when(x(a.name) == y(a.name), 0.0).otherwise(1.0) for a in attrs]) / F.lit(float(len(attrs)))


def weighted_mean(attrs: Sequence[Attribute], x: Side, y: Side, corrected: bool = False) -> Column:
    return _total([feature(a, x(a.name), y(a.name), corrected) for a in attrs]) / F.lit(float(sum(a.weight for a in attrs)))


def distance(schema: StreamSchema, x: Side, y: Side, corrected: bool = False) -> Column:
    """The distance for the schema's mix of kinds, chosen when the plan is built."""
    if schema.all_nominal:
        return mismatch_share(schema.quasi, x, y)
    if schema.all_numeric:
        return scaled_euclidean(schema.quasi, x, y)
    return weighted_mean(schema.quasi, x, y, corrected)


def unbounded(attrs: Sequence[Attribute], x: Side, y: Side) -> Column:
    """Euclidean in raw units, a mismatch of categories counting 1."""
    parts = [F.pow(x(a.name) - y(a.name), 2) if a.kind == NUMERIC else F.when(x(a.name) == y(a.name), 0.0).otherwise(1.0) for a in attrs]
    return F.sqrt(_total(parts))


def minmax_euclidean(attrs: Sequence[Attribute], x: Side, y: Side) -> Column:
    from .scalar import minmax

    return F.sqrt(_total([F.pow(minmax(a, x(a.name)) - minmax(a, y(a.name)), 2) for a in attrs]))


def cosine(x: Column, y: Column) -> Column:
    """1 - cosine of two arrays."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def relative_error(attrs: Sequence[Attribute], x: Side, y: Side, corrected: bool = False) -> Column:
    m, parts = F.lit(float(len(attrs))), []
    for a in attrs:
        p, q = x(a.name), y(a.name)
        if a.kind == NUMERIC:
            parts.append(F.when((p == 0) & (q == 0), 0.0).otherwise(F.abs(p - q) / F.lit(float(a.span))))
        else:
            parts.append(feature(a, p, q, corrected) / m)
    return _total(parts)

"""Noise and suppression. Draws are hashes of (seed, keys), so a repeated task or another partitioning draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..schema import Attribute


def uniform(seed: int, *keys: Column) -> Column:
    """In the open interval (0, 1): 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("r")))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("a")))


def laplace(scale: Column, seed: int, *keys: Column, one_sided: bool = False) -> Column:
    u = uniform(seed, *keys) - 0.5
    draw = -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))
    return F.abs(draw) if one_sided else draw


def laplace_scale(m: int, sensitivity: Column, k: int, eps: float) -> Column:
    return F.lit(0.5 * m) * sensitivity / F.lit(k * eps)


def observed_sensitivity(value: Column, k: int, order: str, group: list[str]) -> Column:
    """Range of the values seen so far; after floor(sqrt(k)) + 1 of them the average of so many earlier ranges is for the caller
    to take with ``moving_average``."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(value).over(w) - F.min(value).over(w)


def moving_average(value: Column, k: int, order: str, group: list[str]) -> Column:
    n = int(math.sqrt(k)) + 1
    w = Window.partitionBy(*group).orderBy(order)
    return F.when(F.row_number().over(w) > n, F.avg(value).over(w.rowsBetween(-n, -1))).otherwise(value)


def replace_category(v: Column, observed: Column, threshold: float, weight: float, seed: int, *keys: Column) -> Column:
    """With a standard normal draw under threshold * weight another observed value, uniformly; else the value."""
    others = F.filter(observed, lambda o: o != v)
    pick = F.element_at(others, (1 + F.floor(uniform(seed, *keys, F.lit("pick")) * F.size(others))).cast("int"))
    return F.when((F.size(others) > 0) & (normal(seed, *keys, F.lit("go")) < threshold * weight), pick).otherwise(v)


def uniform_in_domain(a: Attribute, seed: int, *keys: Column) -> Column:
    v = F.lit(a.lo) + uniform(seed, *keys, F.lit(a.name)) * F.lit(a.span)
    return v.cast("bigint") if a.discrete else v


def uniform_category(a: Attribute, seed: int, *keys: Column) -> Column:
    values = F.array(*[F.lit(v) for v in a.values])
    return F.element_at(values, (1 + F.floor(uniform(seed, *keys, F.lit(a.name)) * len(a.values))).cast("int"))


def kernel_place(n: Column, seed: int, *keys: Column) -> Column:
    """Which of n buffered values, from 1, a kernel draw starts from."""
    return (1 + F.floor(uniform(seed, *keys, F.lit("at")) * n)).cast("int")


def kernel_step(center: Column, n: Column, spread: Column, a: Attribute, seed: int, *keys: Column) -> Column:
    """That value plus a normal step of Scott's width, clamped to the domain."""
    step = spread * F.pow(n.cast("double"), F.lit(-0.2)) * normal(seed, *keys, F.lit("step"))
    v = F.least(F.greatest(center + step, F.lit(a.lo)), F.lit(a.hi))
    return v.cast("bigint") if a.discrete else v


def kernel_sample(buffered: Column, spread: Column, a: Attribute, seed: int, *keys: Column) -> Column:
    """A kernel draw from an array of values."""
    n = F.size(buffered)
    return kernel_step(F.element_at(buffered, kernel_place(n, seed, *keys)), n, spread, a, seed, *keys)

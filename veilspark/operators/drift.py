"""Drift between consecutive count windows: batch forms over a stream with positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..schema import NUMERIC, StreamSchema
from ..streaming.detectors import PageHinkley
from .aggregates import centroids

#: c(alpha) of the two-sample Kolmogorov-Smirnov test.
KS_CRITICAL = {0.10: 1.22, 0.05: 1.36, 0.025: 1.48, 0.01: 1.63, 0.005: 1.73, 0.001: 1.95}


def ks_threshold(confidence: float, n: int, m: int) -> float:
    return KS_CRITICAL[confidence] * ((n + m) / (n * m)) ** 0.5


def windows(df: DataFrame, pos: str, size: int) -> DataFrame:
    """Tumbling count windows; the last one may be short."""
    return df.withColumn("win", F.floor((F.col(pos) - 1) / size))


def paired(df: DataFrame, win: str = "win") -> DataFrame:
    """Each window as the current (tag 1) of its own pair and as the previous (tag 0) of the next; only whole pairs stay."""
    both = df.withColumn("p", F.explode(F.array(F.struct(F.col(win).alias("pair"), F.lit(1).alias("tag")), F.struct((F.col(win) + 1).alias("pair"), F.lit(0).alias("tag")))))
    return both.select(*df.columns, "p.pair", "p.tag")


def ks_statistic(df: DataFrame, pair: str, tag: str, value: str) -> DataFrame:
    """Greatest distance between the distribution functions of the two samples of each pair."""
    counts = df.groupBy(pair, value).agg(F.sum(F.when(F.col(tag) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(tag) == 1, 1).otherwise(0)).alias("b"))
    upto = Window.partitionBy(pair).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(pair)
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(every) - F.sum("b").over(upto) / F.sum("b").over(every))
    held = counts.select(pair, gap.alias("gap"), F.sum("a").over(every).alias("n"), F.sum("b").over(every).alias("m"))
    return held.where("n > 0 AND m > 0").groupBy(pair).agg(F.round(F.max("gap"), 9).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def centroid_shift(df: DataFrame, pos: str, size: int, schema: StreamSchema, factor: float, confidence: float) -> DataFrame:
    """Window, weighted distance of its centroid from that of the window before, and whether it exceeds the threshold. The series is
    one row for each window, paired by an equi-join on the window number."""
    held = windows(df, pos, size)
    whole = centroids(held, ["win"], list(schema.quasi)).where(F.col("size") == size)
    before = whole.select((F.col("win") + 1).alias("win"), *[F.col(a.name).alias(f"p_{a.name}") for a in schema.quasi])
    change = F.lit(factor) * D.distance(schema, D.side("p_"), D.side())
    return whole.join(before, "win").select("win", F.round(change, 9).alias("change"), (F.round(change, 9) > ks_threshold(confidence, size, size)).alias("drift"))


def page_hinkley(df: DataFrame, group: str, order: str, value: str, delta: float = 0.005, threshold: float = 50.0, alpha: float = 0.9999) -> DataFrame:
    """The changes found in each group's series, which starts anew after each; a task holds the sums of one group, not its rows."""

    def step():
        detector = PageHinkley(delta, threshold, alpha)
        return lambda x: [()] if detector.detect(x) else []

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    hits = fold_shards(df.withColumn("_x", F.col(value).cast("double")), group, order, ["_x"], step, f"{group} {kinds[group]}, at bigint")
    found = hits.groupBy(group).agg(F.count("*").alias("changes"), F.min("at").alias("first_change"))
    return df.select(group).distinct().join(found, group, "left").select(group, F.coalesce("changes", F.lit(0).cast("bigint")).alias("changes"), F.coalesce("first_change", F.lit(-1).cast("bigint")).alias("first_change"))


def quadrant_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Greatest difference between the quadrant shares of two planar samples, the quadrants lying at the points of the first; a point is counted
    in the quadrant that makes the difference greatest."""
    at = a[:, None, :]
    share = lambda s: np.stack([((s[None, :, 0] <= at[..., 0]) == u) & ((s[None, :, 1] <= at[..., 1]) == v) for u, v in ((True, True), (True, False), (False, True), (False, False))]).mean(axis=2)
    gap = share(a) - share(b)
    gap[0] -= 1 / len(a)
    return float(max(-gap.min(), gap.max() + 1 / len(a)))


def kolmogorov_tail(d: float, terms: int = 100) -> float:
    if d <= 0:
        return 1.0
    j = np.arange(1, terms + 1)
    return float(np.clip(2 * ((-1.0) ** (j - 1) * np.exp(-2 * j**2 * d**2)).sum(), 0, 1))


def ks2d(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Planar two-sample statistic and its approximate tail probability."""
    d = (quadrant_gap(a, b) + quadrant_gap(b, a)) / 2
    n = (len(a) * len(b) / (len(a) + len(b))) ** 0.5
    r = [np.corrcoef(s.T)[0, 1] if len(s) > 1 and (s.std(axis=0) > 0).all() else 0.0 for s in (a, b)]
    spread = max(0.0, 1 - 0.5 * (r[0] ** 2 + r[1] ** 2)) ** 0.5
    return d, kolmogorov_tail(d * n / (1 + spread * (0.25 - 0.75 / n)))


def energy(a: np.ndarray, b: np.ndarray, log: bool = False) -> float:
    """Energy distance of two samples; pairs inside a sample are counted once."""
    far = lambda s, t: np.sqrt(((s[:, None, :] - t[None, :, :]) ** 2).sum(axis=2))
    f = np.log if log else (lambda x: x)
    inner = lambda s: f(far(s, s)[np.triu_indices(len(s), 1)]).sum() / len(s) ** 2
    return float(f(far(a, b)).sum() / (len(a) * len(b)) - inner(a) - inner(b))


def standardized(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.vstack([a, b])
    spread = both.std(axis=0)
    both = (both - both.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    return both[: len(a)], both[len(a) :]


def energy_test(a: np.ndarray, b: np.ndarray, rounds: int = 200, seed: int = 7, log: bool = False) -> tuple[float, float]:
    """Energy statistic of the standardized samples and its permutation p-value."""
    a, b = standardized(a, b)
    both, n, m = np.vstack([a, b]), len(a), len(b)
    far = np.sqrt(((both[:, None, :] - both[None, :, :]) ** 2).sum(axis=2))
    if log:
        far = np.log(far + np.eye(n + m))
    random = np.random.default_rng(seed)
    order = np.arange(n + m)
    first = np.array([order < n, *(random.permutation(n + m) < n for _ in range(rounds))], float)
    near = first @ far
    cross, inner = (near * (1 - first)).sum(axis=1), (near * first).sum(axis=1) / 2
    z = cross / (n * m) - inner / n**2 - (far.sum() / 2 - cross - inner) / m**2
    return float(z[0]), float(np.mean(z[1:] >= z[0])) if rounds else float("nan")


def pca_ks(a: np.ndarray, b: np.ndarray, pooled: bool = True) -> float:
    """KS statistic of the samples' first principal components; pooled: one scale and one axis for both."""

    def axis(s: np.ndarray) -> np.ndarray:
        return np.linalg.svd(s - s.mean(axis=0), full_matrices=False)[2][0]

    def scale(s: np.ndarray) -> np.ndarray:
        spread = s.std(axis=0)
        return (s - s.mean(axis=0)) / np.where(spread > 0, spread, 1.0)

    if pooled:
        x, y = standardized(a, b)
        v = axis(np.vstack([x, y]))
        p, q = x @ v, y @ v
    else:
        x, y = scale(a), scale(b)
        p, q = x @ axis(x), y @ axis(y)
    return ks_of(p, q)


def ks_of(p: np.ndarray, q: np.ndarray) -> float:
    at = np.sort(np.concatenate([p, q]))
    return float(np.abs(np.searchsorted(np.sort(p), at, side="right") / len(p) - np.searchsorted(np.sort(q), at, side="right") / len(q)).max())


def per_pair(df: DataFrame, columns: list[str], statistics: dict[str, str]) -> DataFrame:
    """For each pair of windows (columns pair, tag; at most two windows of rows each) the named statistics of ``columns``."""
    wanted = list(statistics)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows.loc[rows["tag"] == t, columns].to_numpy(float) for t in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"pair": [], **{k: [] for k in wanted}})
        made = {}
        for name in wanted:
            kind = statistics[name]
            if kind == "ks2d":
                made[name] = ks2d(a, b)[0]
            elif kind == "ks2d_p":
                made[name] = ks2d(a, b)[1]
            elif kind == "energy":
                made[name] = energy(*standardized(a, b))
            elif kind == "energy_p":
                made[name] = energy_test(a, b)[1]
            else:
                made[name] = pca_ks(a, b, kind == "pca_ks")
        return pd.DataFrame({"pair": [int(rows["pair"].iloc[0])], **{k: [v] for k, v in made.items()}})

    return df.select("pair", "tag", *columns).groupBy("pair").applyInPandas(run, "pair bigint, " + ", ".join(f"{k} double" for k in wanted))


def fold_shards(df: DataFrame, shard: str, order: str, columns: list[str], step, schema: str, last: bool = False) -> DataFrame:
    """Runs an order-dependent detector along each shard: rows arrive sorted, so a task holds one state and one batch.

    ``step()`` makes a function from a row's values to a list of output tuples; its rows begin with the shard and the order column.
    last: only what the last row of each shard gives is returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, act, held = object(), None, []
        for rows in batches:
            out = []
            for values in rows.itertuples(index=False, name=None):
                if values[0] != current:
                    out += held
                    current, act, held = values[0], step(), []
                made = [(values[0], values[1], *x) for x in act(*values[2:])]
                if last:
                    held = made
                else:
                    out += made
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(held, columns=names)

    names = [f.split()[0] for f in schema.split(",")]
    dealt = df.select(shard, order, *columns).repartition(shard).sortWithinPartitions(shard, order)
    return dealt.mapInPandas(run, schema)


def numeric_columns(schema: StreamSchema) -> list[str]:
    return [a.name for a in schema.quasi if a.kind == NUMERIC]

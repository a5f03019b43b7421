"""A buffered baseline: each block of records of a shard is cut in groups of k nearest neighbours, and each group publishes its
centroid with Laplace noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import StreamSchema


def nearest_groups(x: np.ndarray, k: int) -> np.ndarray:
    """Group numbers: again and again the record farthest from the mean takes its k - 1 nearest; what is left, under 2k, is one group."""
    group, left, number = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left) >= 2 * k:
        rest = x[left]
        seed = ((rest - rest.mean(axis=0)) ** 2).sum(axis=1).argmax()
        near = np.argsort(((rest - rest[seed]) ** 2).sum(axis=1), kind="stable")[:k]
        group[left[near]] = number
        number += 1
        left = np.delete(left, near)
    group[left] = number
    return group


def knn_anonymize(df: DataFrame, schema: StreamSchema, k: int, buffer: int, eps: float, shard: str, seed: int = 7) -> DataFrame:
    """shard, seq, block, grp, status (1 if the last block of a shard has under k records) and the published numeric values. A block has at
    most ``buffer`` rows, so each group call is small and all blocks run in parallel."""
    names = [a.name for a in schema.quasi]
    lo, span = np.array([a.lo for a in schema.quasi]), np.array([a.span for a in schema.quasi])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        x = (rows[names].to_numpy(float) - lo) / span
        group = nearest_groups(x, k) if len(x) else np.zeros(0, int)
        out = rows[[shard, "seq", "block"]].assign(grp=group, status=int(len(x) < k))
        centre = np.array([x[group == g].mean(axis=0) for g in range(group.max() + 1)])
        random = np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, rows[shard].iloc[0], int(rows["block"].iloc[0]))).encode()))
        noisy = np.clip(centre + random.laplace(0, 0.5 * len(names) / (k * eps), centre.shape), 0, 1) * span + lo
        for i, n in enumerate(names):
            out[f"anon_{n}"] = noisy[group, i]
        return out

    nth = F.row_number().over(Window.partitionBy(shard).orderBy(schema.seq))
    held = df.select(F.col(shard).cast("string").alias(shard), F.col(schema.seq).alias("seq"), *names, F.floor((nth - 1) / buffer).alias("block"))
    return held.groupBy(shard, "block").applyInPandas(run, f"{shard} string, seq bigint, block bigint, grp int, status int, " + ", ".join(f"anon_{n} double" for n in names))

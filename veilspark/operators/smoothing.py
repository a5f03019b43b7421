"""Locally weighted smoothing of metric series, and timing of a run."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import duration


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.3) -> np.ndarray:
    """At each x a line through its nearest points, weighted by the tri-cube of their distance."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    k = min(n, max(2, int(np.ceil(share * n))))
    out = np.empty(n)
    left = 0
    for i in range(n):
        while left + k < n and x[left + k] - x[i] < x[i] - x[left]:
            left += 1
        px, py = x[left : left + k], y[left : left + k]
        reach = max(abs(x[i] - px[0]), abs(px[-1] - x[i])) or 1.0
        w = (1 - np.minimum(np.abs(px - x[i]) / reach, 1) ** 3) ** 3
        w = w if w.sum() > 0 else np.ones(k)
        mx, my = np.average(px, weights=w), np.average(py, weights=w)
        spread = np.average((px - mx) ** 2, weights=w)
        slope = np.average((px - mx) * (py - my), weights=w) / spread if spread > 0 else 0.0
        out[i] = my + slope * (x[i] - mx)
    back = np.empty(n)
    back[order] = out
    return back


def smoothed(series: DataFrame, run: str, metric: str, share: float = 0.3) -> DataFrame:
    """(run, time, metric) with its smoothed value. A series holds one sample of every hundred records of one run."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time")
        return rows.assign(smooth=lowess(rows["time"].to_numpy(float), rows[metric].to_numpy(float), share))

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.select(run, "time", F.col(metric).cast("double").alias(metric)).groupBy(run).applyInPandas(fit, f"{run} {kinds[run]}, time bigint, {metric} double, smooth double")


def timed(spark: SparkSession, run: Callable[[], object]) -> DataFrame:
    """Runs an action; one row with its seconds and their text."""
    began = time.monotonic()
    run()
    took = time.monotonic() - began
    return spark.range(1).select(F.lit(took).alias("seconds")).select("seconds", duration(F.col("seconds")).alias("took"))

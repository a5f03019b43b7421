"""Nearest-neighbour search against a small set of centroids or anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..schema import StreamSchema

#: Rows of the small side that are broadcast; more are refused, since each record is compared with all of them.
MAX_CENTROIDS = 10_000


def _bounded(df: DataFrame, most: int) -> DataFrame:
    if len(df.select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"over {most} rows on the broadcast side")
    return F.broadcast(df)


def candidates(df: DataFrame, centroids: DataFrame, schema: StreamSchema, threshold: float, cluster: str = "cluster") -> DataFrame:
    """Each record with every centroid within the threshold: columns of df, cluster, dist (bounded) and dist_raw (unbounded)."""
    small = _bounded(centroids.select(F.col(cluster).alias("cluster"), *[F.col(a.name).alias(f"c_{a.name}") for a in schema.quasi]), MAX_CENTROIDS)
    x, y = D.side(), D.side("c_")
    met = df.join(small, D.distance(schema, x, y) <= threshold)
    return met.select(*df.columns, "cluster", D.distance(schema, x, y).alias("dist"), D.unbounded(schema.quasi, x, y).alias("dist_raw"))


def nearest(df: DataFrame, centroids: DataFrame, schema: StreamSchema, threshold: float, cluster: str = "cluster") -> DataFrame:
    """seq and its best cluster: of those within the threshold the one of least unbounded distance, then of least id; null if none."""
    small = _bounded(centroids.select(F.col(cluster).alias("cluster"), *[F.col(a.name) for a in schema.quasi]), MAX_CENTROIDS)
    whole = F.broadcast(small.agg(F.collect_list(F.struct("cluster", *[a.name for a in schema.quasi])).alias("all")))  # one row, bounded above
    x = D.side()

    def scored(c):
        y = lambda name: c[name]
        return F.struct(F.round(D.unbounded(schema.quasi, x, y), 9).alias("d"), c["cluster"].alias("cluster"), (D.distance(schema, x, y) <= threshold).alias("near"))

    met = df.join(whole, how="cross")
    best = F.array_min(F.transform(F.filter(F.transform("all", scored), lambda s: s["near"]), lambda s: F.struct(s["d"], s["cluster"])))
    return met.select(schema.seq, best["cluster"].alias("cluster"), best["d"].alias("dist_raw"))

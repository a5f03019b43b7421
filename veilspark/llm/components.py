"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, each_salt, materialize, salt_of, salts_met


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least v of its u. A hub's edges lie in SALTS parts, each of which the least is sent to."""
    salted = edges.withColumn("salt", salt_of("v"))
    least = salted.groupBy("u").agg(F.min("v").alias("m"), salts_met(F.col("salt")).alias("met"))
    return salted.join(least.select("u", "m", each_salt(F.col("met")).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge and is not itself the smallest.

    edges are undirected and may repeat; loops and edges with a null end are ignored. A node's neighbours are
    never gathered: each star step is an aggregated minimum joined back to the salted edges, so a hub's edges stay spread over
    partitions. Each round is written to the shared folder."""
    x, y = F.col(a), F.col(b)
    current = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # the least neighbour itself takes the node
        small = with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = materialize(small, "edges")
        discard(current)
        before, state, current = state, _state(after), after
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))

"""Positions and running totals over a whole stream without gathering it in one task."""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Positions in one block of a running sum; a block is what one task sorts at a time.
BLOCK = 1 << 16
#: Up to so many shards each get a part of their own, and the parts of more are at least so many.
OWN = 32
#: So many of the largest shards are dealt by their sizes; all others, which are smaller, by hash.
SIZED = 4096


def few_parts(df: DataFrame) -> int:
    """Parts for few long shards, four to a core: merged by size, several would meet in one task; each empty part costs a task."""
    spark = df.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, shard: str, order: str) -> DataFrame:
    """df with every shard whole in one part and in order there. The largest shard goes first, each to the part that has least so far, and
    parts begin in that order: by hash, several long shards meet in one task while cores stand idle. Counts the rows of each shard first."""
    sizes = df.groupBy(shard).agg(F.count("*").alias("n")).orderBy(F.desc("n"), shard).limit(SIZED).collect()  # at most SIZED rows
    parts = max(1, len(sizes)) if len(sizes) <= OWN else max(OWN, few_parts(df))
    loads, places = [(0, p) for p in range(parts)], []
    heapify(loads)
    for s, n in sizes:
        load, p = loads[0]
        heapreplace(loads, (load + n, p))
        places.append((s, p))
    known = df.sparkSession.createDataFrame(places, f"_shard {df.schema[shard].dataType.simpleString()}, _part int")
    put = df.join(F.broadcast(known), F.col(shard).eqNullSafe(F.col("_shard")), "left")  # at most SIZED rows
    put = put.repartitionById(parts, F.coalesce("_part", F.pmod(F.hash(shard), F.lit(parts))))
    # where every shard has a part of its own, the order leads: a sort by a shard that is the same in all rows must compare whole rows
    return put.select(*[F.col(f"`{c}`") for c in df.columns]).sortWithinPartitions(*((order, shard) if len(sizes) <= OWN else (shard, order)))


def sorted_blocks(df: DataFrame, *order: str) -> DataFrame:
    """df in a global order, written once: ``_block`` is the range of the order that one task sorted, ``_nth`` the place in it, from 1. Ranges
    are cut by samples of the rows, so sparse and clustered keys make blocks as even as dense ones."""
    held = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    return held.withColumns({"_block": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND((1 << 33) - 1) + 1}).drop("_id")


def before_block(blocks: DataFrame, **sums: Column) -> DataFrame:
    """(_block, sums over all earlier blocks): one row for each task that sorted, to be broadcast."""
    totals = blocks.groupBy("_block").agg(*[v.alias(k) for k, v in sums.items()])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_block", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums]))


def with_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """df with the position 1..n of each row by a key that is unique: the rows of earlier blocks plus the place inside the block."""
    return with_rank(df, key, name=name)


def with_rank(df: DataFrame, *order: str, name: str) -> DataFrame:
    """The same by several columns, which together are unique."""
    blocks = sorted_blocks(df, *order)
    return blocks.join(before_block(blocks, _skip=F.count("*")), "_block").withColumn(name, F.col("_skip") + F.col("_nth")).drop("_block", "_skip", "_nth")


def with_running_sums(df: DataFrame, pos: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with running totals by position: totals of earlier blocks plus the running total inside the block."""
    held = df.withColumn("_block", F.floor((F.col(pos) - 1) / F.lit(block))).withColumns({f"_{k}": v for k, v in sums.items()})
    totals = held.groupBy("_block").agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    skips = totals.select("_block", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in sums])
    inside = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    run = held.join(skips, "_block").withColumns({k: F.col(f"_s{k}") + F.sum(f"_{k}").over(inside) for k in sums})
    return run.drop("_block", *[f"_{k}" for k in sums], *[f"_s{k}" for k in sums])


def sample_every(df: DataFrame, pos: str, n: int = 100) -> DataFrame:
    return df.where(F.col(pos) % n == 0)


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a random but repeatable order, by the MD5 of seed and key. The sequence column keeps its sorted values: the i-th row of the
    new order gets the i-th key, in column ``new_key``."""
    ranked = with_rank(df.withColumn("_h", _draw(key, seed)), "_h", key, name="_pos")
    keys = with_position(df.select(F.col(key).alias("new_key")), "new_key", "_pos")
    return ranked.join(keys, "_pos").drop("_pos", "_h")


def reinsert_duplicates(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """df and a repeatable sample of floor(n * fraction) of its rows again, with new keys after the last one."""
    size = df.agg(F.floor(F.count("*") * F.lit(fraction)).alias("_take"), F.max(key).alias("_last"))
    ranked = with_rank(df.withColumn("_h", _draw(key, seed)), "_h", key, name="_r")
    again = ranked.join(F.broadcast(size), F.col("_r") <= F.col("_take"))  # one row of totals
    return df.unionByName(again.withColumn(key, F.col("_last") + F.col("_r")).select(df.columns))

"""The anonymizer where one group is open at a time, as plain DataFrame operations.

If the distance threshold is never exceeded, records fill groups of 4k in order, so group, release time, centroid, diversity and
status of every record have a closed form over windows of at most 4k rows, and all groups are worked on in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnonymizerConfig
from ..operators.aggregates import most_frequent, recursive_diversity, running_counts
from ..operators.ordering import with_position
from ..schema import StreamSchema


def single_cluster(df: DataFrame, schema: StreamSchema, cfg: AnonymizerConfig) -> DataFrame:
    """The pair frame of a stream: see ``operators.metrics``. Every quasi-identifier must be numeric, and the sensitive attribute have
    a declared domain. Suppressed records get the middle of the domain."""
    k, full, domain = cfg.k, cfg.retire, list(schema.sensitive.values)
    names = [a.name for a in schema.quasi]
    rows = with_position(df.select(F.col(schema.seq).alias("seq"), *names, F.col(schema.sensitive.name).alias("sensitive")), "seq")
    total = F.broadcast(rows.agg(F.max("pos").alias("n")))  # one row
    rows = rows.withColumn("cluster", F.floor((F.col("pos") - 1) / full)).withColumn("j", (F.col("pos") - 1) % full + 1).join(total, how="cross")
    group = Window.partitionBy("cluster")
    upto = group.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)

    def centre(x: str) -> Column:
        run = F.sum(x).over(upto)
        return run / F.col("j") if cfg.true_mean else (F.first(x).over(upto) + run) / (F.col("j") + 1)

    state = rows.withColumn("counts", running_counts("sensitive", domain, ["cluster"], "j"))
    now = F.struct(*[centre(x).alias(x) for x in names], recursive_diversity(F.col("counts"), cfg.l, cfg.c).alias("diverse"), most_frequent(F.col("counts"), domain).alias("majority"))
    state = state.withColumn("now", now).withColumn("size", F.count("*").over(group)).drop("counts")
    at = lambda j: F.max(F.when(F.col("j") == j, F.col("now"))).over(group)
    small = F.col("size") < k
    held = state.withColumn("first", at(k)).withColumn("last", at(F.col("size")))
    seen = F.when(small, F.col("last")).when(F.col("j") <= k, F.col("first")).otherwise(F.col("now"))
    held = held.withColumn("seen", seen)
    start = F.col("cluster") * full
    status = F.when(small, 1).when(F.col("seen.diverse"), 0).otherwise(2)
    pub_seq = F.when(small, start + F.col("size") - F.col("j") + 1).when(F.col("j") <= k, start + k - F.col("j") + 1).otherwise(F.col("pos"))
    time = F.when(small, F.col("n")).when(F.col("j") <= k, start + k).otherwise(F.col("pos"))
    return held.select(
        pub_seq.alias("pub_seq"), "seq", "pos", time.alias("publish_time"), status.alias("status"), "cluster", F.col("seen.majority").alias("majority"), "sensitive", *names,
        *[F.when(status == 0, F.floor(F.col(f"seen.{a.name}") * 10000 + 0.5) / 10000).otherwise(F.lit((a.lo + a.hi) / 2)).alias(f"anon_{a.name}") for a in schema.quasi],
    )

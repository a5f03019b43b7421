"""Information loss, disclosure risk and delay of (original, anonymized) pairs.

A pair frame has: pub_seq, seq, pos, publish_time, status, cluster, majority, sensitive, x (original) and anon for each numeric
quasi-identifier. status: 0 published, 1 suppressed for size, 2 suppressed for diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import sample_every, with_running_sums

#: Blocks of a series that one task carries a value through.
SPAN = 1 << 16


def mse(pairs: DataFrame, dist: Column) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(dist * dist), 9).alias("mse"))


def sse(pairs: DataFrame, raw: Column) -> DataFrame:
    """The sum of raw distances."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum(raw), 4).alias("sse"))


def relative_error(pairs: DataFrame, error: Column, m: int) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(error / m) * 100, 6).alias("relative_error"))


def homogeneity(pairs: DataFrame, dist: Column, x: str, span: float) -> DataFrame:
    """Squared distance to the published value over squared distance to the mean of all."""
    mean = F.broadcast(pairs.agg(F.avg(x).alias("_mean")))
    far = F.abs(F.col(x) - F.col("_mean")) / span
    return pairs.join(mean, how="cross").agg(F.round(F.sum(dist * dist), 6).alias("sse"), F.round(F.sum(far * far), 6).alias("sst"), F.round(F.sum(dist * dist) / F.sum(far * far), 9).alias("homogeneity"))


def classification_penalty() -> Column:
    return F.when((F.col("status") != 0) | (F.col("sensitive") != F.col("majority")), 1).otherwise(0)


def classification(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.sum(classification_penalty()).alias("penalties"), F.round(F.avg(classification_penalty()), 9).alias("classification_metric"))


def delay(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg(F.col("publish_time") - F.col("pos")), 3).alias("avg_delay"))


def counters(pairs: DataFrame) -> DataFrame:
    flag = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return pairs.agg(F.count("*").alias("n"), flag(0).alias("published"), flag(1).alias("suppressed_size"), flag(2).alias("suppressed_diversity"), F.countDistinct("cluster").alias("opened_clusters"))


def _risk(met: DataFrame, others: Column) -> DataFrame:
    """The share 1 / ties of the records that are among the nearest originals to their own anonymized value: met has pub_seq, x, anon;
    others is an array of (pub_seq, x)."""
    far = F.transform(others, lambda a: F.abs(F.col("anon") - a["x"]))
    met = met.select("pub_seq", far.alias("far"), F.abs(F.col("anon") - F.col("x")).alias("own"))
    met = met.withColumn("best", F.least(F.array_min("far"), "own"))
    ties = F.size(F.filter("far", lambda v: v == F.col("best"))) + (F.col("own") == F.col("best")).cast("int")
    return met.select("pub_seq", ties.cast("bigint").alias("ties"), F.when(F.col("own") == F.col("best"), 1 / ties).otherwise(0.0).alias("risk"))


def disclosure_anchor(pairs: DataFrame, x: str, anon: str, anchors: int = 99) -> DataFrame:
    """Risk of each record against the first ``anchors`` published originals and its own."""
    first = pairs.where(F.col("pub_seq") <= anchors).agg(F.collect_list(F.struct("pub_seq", F.col(x).alias("x"))).alias("first"))
    every = pairs.select("pub_seq", F.col(x).alias("x"), F.col(anon).alias("anon"))
    met = every.join(F.broadcast(first), how="cross")  # one row of at most ``anchors`` values: no record is copied or moved
    return _risk(met, F.filter("first", lambda a: a["pub_seq"] < F.col("pub_seq")))


def disclosure_sliding(pairs: DataFrame, x: str, anon: str, width: int = 100) -> DataFrame:
    """Risk of each record against the last ``width`` published originals, its own included: each block of ``width`` places is one array,
    and a record meets its own block's and the one before."""
    every = pairs.select("pub_seq", F.col(x).alias("x"), F.col(anon).alias("anon"), F.floor(F.col("pub_seq") / width).alias("block"))
    held = every.groupBy("block").agg(F.collect_list(F.struct("pub_seq", "x")).alias("now"))
    before = held.select((F.col("block") + 1).alias("block"), F.col("now").alias("before"))
    met = every.join(held.join(before, "block", "left"), "block")
    near = lambda a: (a["pub_seq"] < F.col("pub_seq")) & (a["pub_seq"] > F.col("pub_seq") - width)
    return _risk(met, F.filter(F.concat("now", F.coalesce("before", F.filter("now", lambda a: F.lit(False)))), near))


def series(pairs: DataFrame, values: dict[str, Column], every: int = 100) -> DataFrame:
    """Running means of the values, by publication, at every n-th record: time and one column each."""
    run = with_running_sums(pairs, "pub_seq", values)
    return sample_every(run, "pub_seq", every).select(F.col("pub_seq").alias("time"), *[F.round(F.col(k) / F.col("pub_seq"), 6).alias(k) for k in values])


def stale_series(risks: DataFrame, every: int = 100) -> DataFrame:
    """The risk series that is refreshed at hits only: at each sample the ratio as of the last record with a hit. One row for each block of
    records is carried on, so the running part is small."""
    run = with_running_sums(risks, "pub_seq", {"total": F.col("risk")})
    block = F.floor((F.col("pub_seq") - 1) / every)
    last = run.groupBy(block.alias("block")).agg(F.max(F.when(F.col("risk") > 0, F.struct("pub_seq", "total"))).alias("hit"), F.count("*").alias("n"))
    # carried inside spans of SPAN blocks, and from span to span by one row of each
    span = last.withColumn("span", F.floor(F.col("block") / SPAN))
    upto = F.last("hit", ignorenulls=True)
    ends = span.groupBy("span").agg(F.max("hit").alias("end"))
    ends = ends.select("span", F.last("end", ignorenulls=True).over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    last = span.join(ends, "span")
    carried = F.coalesce(upto.over(Window.partitionBy("span").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)), "before")
    return last.withColumn("hit", carried).where(F.col("n") == every).select(((F.col("block") + 1) * every).alias("time"), F.round(F.coalesce(F.col("hit.total") / F.col("hit.pub_seq"), F.lit(0.0)), 6).alias("risk"))


def compare(series_by_run: DataFrame, run: str, runs: list[str], metric: str) -> DataFrame:
    """One row for each time, one column for each run."""
    return series_by_run.groupBy("time").pivot(run, runs).agg(F.first(metric))

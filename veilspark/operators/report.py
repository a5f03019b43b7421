"""One row for a run: its parameters and all its metrics, in one pass over the pairs; and the evaluation of classifiers on both sides."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnonymizerConfig
from .agreement import auc, auc_by, kappa
from .metrics import classification_penalty


def run_report(pairs: DataFrame, cfg: AnonymizerConfig, dist: Column, raw: Column, m: int, run_id: str = "run") -> DataFrame:
    """The run's id, k, l, c, eps, delta, buffer and threshold beside its counters, losses and delay."""
    known = asdict(cfg)
    names = ("k", "l", "c", "eps", "delta", "buffer", "threshold")
    flag = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    row = pairs.agg(
        F.count("*").alias("n"),
        F.countDistinct("cluster").alias("opened_clusters"),
        flag(1).alias("suppressed_size"),
        flag(2).alias("suppressed_diversity"),
        F.round(F.avg(F.col("publish_time") - F.col("pos")), 3).alias("avg_delay"),
        F.round(F.avg(dist * dist), 9).alias("mse"),
        F.round(F.sum(raw) / 1000, 3).alias("sse_thousands"),
        F.round(F.avg(dist / m) * 100, 6).alias("relative_error"),
        F.round(F.avg(classification_penalty()), 9).alias("classification_metric"),
    )
    return row.select(F.lit(run_id).alias("run_id"), *[F.lit(known[x]).cast("double").alias(x) for x in names], "*")


def classifier_report(original: DataFrame, anonymized: DataFrame, key: list[str], positive: str, learner: str) -> DataFrame:
    """AUC of a learner's predictions on the original and on the anonymized stream, and the agreement of the two; predictions
    (key..., actual, pred, score) are aligned by key."""
    both = original.select(*key, F.col("pred").alias("a")).join(anonymized.select(*key, F.col("pred").alias("b")), key)
    return _classifier_row(original, anonymized, both, positive, learner)


def paired_report(sums: DataFrame, learners: list[str]) -> DataFrame:
    """The same for many learners at once, a row for each, from the sums over both sides' predictions (``streaming.native.prequential_sums``);
    side 0 is the original."""
    place = F.coalesce(*[F.when(F.col("learner") == x, F.lit(2 * i)) for i, x in enumerate(learners)]) + F.col("side")
    ranked = F.broadcast(auc_by(sums.where("n IS NULL").withColumn("place", place), "place", "score", "p", "q"))  # two rows for each learner
    one = lambda i, name: ranked.select(F.col("place").alias(f"place_{i}"), F.col("auc").alias(name))
    agreed = F.broadcast(kappa(sums.where("n IS NOT NULL"), "a", "b", ["learner"], "n"))
    named = sums.sparkSession.createDataFrame([(x, 2 * i, 2 * i + 1) for i, x in enumerate(learners)], "learner string, place_0 int, place_1 int")
    rows = named.join(one(0, "auc_original"), "place_0", "left").join(one(1, "auc_anonymized"), "place_1", "left").join(agreed, "learner", "left")
    return rows.select("learner", "auc_original", "auc_anonymized", "kappa")


def _classifier_row(original: DataFrame, anonymized: DataFrame, both: DataFrame, positive: str, learner: str) -> DataFrame:
    side = lambda df: auc(df.select("score", (F.col("actual") == positive).cast("int").alias("y")), "score", "y")
    row = F.broadcast(side(original).withColumnRenamed("auc", f"auc_original_{learner}"))  # one row each
    row = row.join(F.broadcast(side(anonymized).withColumnRenamed("auc", f"auc_anonymized_{learner}")), how="cross")
    return row.join(F.broadcast(kappa(both, "a", "b").withColumnRenamed("kappa", f"kappa_{learner}")), how="cross")


def aligned(original: DataFrame, anonymized: DataFrame, seq: str) -> DataFrame:
    """Original and anonymized records side by side, by sequence; the anonymized columns begin with anon_."""
    return original.join(anonymized.select(seq, *[F.col(f"`{c}`").alias(f"anon_{c}") for c in anonymized.columns if c != seq]), seq)

"""Agreement of predictions, ranking quality and prequential learners that need counts only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import before_block, sorted_blocks


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Cohen's kappa in percent, from the contingency table; ``by``: one for each group, in one pass; ``n``: how many rows a row stands for."""
    by, rows = by or [], F.sum(n) if n else F.count("*")
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(rows.cast("double").alias("n"))
    rows, columns = cells.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("ra")), cells.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("rb"))
    chance = F.broadcast(rows.join(columns, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("chance")))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("same"))
    both = seen.join(chance, by, "left") if by else F.broadcast(seen).join(chance, how="cross")
    p0, pe = F.col("same") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return both.select(*by, F.round(F.when(pe == 1, F.lit(float("nan"))).otherwise((p0 - pe) / (1 - pe) * 100), 6).alias("kappa"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from counts by score: ties count half. Only the distinct scores are put in order."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    blocks = sorted_blocks(counts, "s")
    inside = Window.partitionBy("_block").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_below") + F.coalesce(F.sum("q").over(inside), F.lit(0))
    held = blocks.join(before_block(blocks, _below=F.sum("q")), "_block").withColumn("below", below)
    won = held.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return won.select(F.round(F.col("won") / (F.col("p").cast("double") * F.col("q")), 9).alias("auc"))


def auc_by(df: DataFrame, by: str, score: str, p: str, q: str) -> DataFrame:
    """The same for each group of an int column, of few groups: (by, auc), null where a class is missing. Rows are counts of the class (p) and of the
    others (q) by score, which may come again. All groups are put in one order, by score alone; of each range of it only sums are kept."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, Ranks] = {}
        for b in batches:
            g, s, p, q = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            order = np.argsort(g, kind="stable")
            found, starts = np.unique(g[order], return_index=True)
            for x, at in zip(found.tolist(), np.split(order, starts[1:])):
                groups.setdefault(x, Ranks()).add(s[at], p[at], q[at])
        block = TaskContext.get().partitionId()
        rows = [{"block": block, "g": x, **r.sums()} for x, r in groups.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int32()), ("g", pa.int32()), ("p", pa.int64()), ("q", pa.int64()), ("won", pa.float64())]))

    rows = df.select(F.col(by).cast("int").alias("g"), F.col(score).cast("double").alias("s"), F.col(p).cast("bigint").alias("p"), F.col(q).cast("bigint").alias("q"))
    ranges = rows.orderBy("s").mapInArrow(summed, "block int, g int, p bigint, q bigint, won double")
    below = F.coalesce(F.sum("q").over(Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranges.withColumn("won", F.col("won") + F.col("p").cast("double") * below).groupBy("g").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q")
    return won.select(F.col("g").alias(by), F.round(F.when(pairs > 0, F.col("won") / pairs), 9).alias("auc"))


class Ranks:
    """A group's pairs won within a range of rising scores, batch after batch; the last score may go on in the next batch."""

    def __init__(self):
        self.p, self.q, self.won, self.held = 0, 0, 0.0, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, s: np.ndarray, p: np.ndarray, q: np.ndarray, last: bool = False) -> None:
        s, p, q = (np.concatenate(x) for x in zip(self.held, (s, p, q)))
        if not len(s):
            return
        new = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        p, q, s = np.add.reduceat(p, starts), np.add.reduceat(q, starts), s[starts]
        self.held = (s[-1:], p[-1:], q[-1:])
        if not last:
            p, q = p[:-1], q[:-1]
        self.won += float(np.dot(p.astype(float), self.q + np.cumsum(q) - q / 2))
        self.p, self.q = self.p + int(p.sum()), self.q + int(q.sum())

    def sums(self) -> dict:
        self.add(*(x[:0] for x in self.held), last=True)
        return {"p": self.p, "q": self.q, "won": self.won}


def prequential_majority(df: DataFrame, shard: str, order: str, label: str, classes: list[str]) -> DataFrame:
    """For each record the class that was the most frequent before it (of equals the first; the first class at the start). Each
    shard is a stream of its own."""
    before = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = [F.struct(F.coalesce(F.sum(F.when(F.col(label) == c, 1).otherwise(0)).over(before), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]
    return df.select(shard, order, F.col(label).alias("actual"), F.greatest(*counts)["c"].alias("pred"))


def prequential_naive_bayes(df: DataFrame, shard: str, order: str, label: str, classes: list[str], features: list[str]) -> DataFrame:
    """Test-then-train naive Bayes on categorical features with add-one counts: running counts of (class) and (class, value)."""
    every = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scores = []
    for i, c in enumerate(classes):
        is_c = F.when(F.col(label) == c, 1).otherwise(0)
        n_c = F.coalesce(F.sum(is_c).over(every), F.lit(0))
        s = F.log(n_c + 1)
        for f in features:
            same = Window.partitionBy(shard, f).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            s = s + F.log((F.coalesce(F.sum(is_c).over(same), F.lit(0)) + 1) / (n_c + 2))
        scores.append(F.struct(F.round(s, 9).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")))
    return df.select(shard, order, F.col(label).alias("actual"), F.greatest(*scores)["c"].alias("pred"))


def accuracy(predictions: DataFrame, shard: str) -> DataFrame:
    return predictions.groupBy(shard).agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("actual")).cast("int")).alias("correct"))

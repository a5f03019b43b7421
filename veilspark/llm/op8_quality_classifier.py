"""A quality classifier: a second-order factorisation machine.

Inputs of a text: its words, hashed to WORDS places with damped counts and unit length; its structure statistics (those of the
quality rules) as shares in BINS steps, one place each; its size in words and characters in powers of two. The machine
adds a weight for each input and, for each pair, the product of two low-rank factors, which the identity
``sum_{i<j} <v_i, v_j> x_i x_j = ((sum v x)^2 - sum (v x)^2) / 2`` gives in time linear in the inputs.

It is fitted here, with logistic loss and adaptive steps, on at most TRAINING labelled rows (those of least id hash). Labels,
language, source and id are never inputs.

Defined results: null and empty texts are scored as texts without words; without labels the score is 0.5; rows with a null id
are never learned from and are held out; of several labels of one id the greatest counts, of several texts the least; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import content, crc_fold, table
from .op2_quality_rules import STATS, _words, text_stats

WORDS, BINS, RANK = 4096, 16, 8
SHARES = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_distinct_words", "n_words"), ("n_shouted", "n_words"), ("n_short", "n_words"), ("n_bangs", "n_words"), ("word_chars", "n_words")]
SIZES = ["n_words", "word_chars", "n_lines"]
DIM = WORDS + BINS * (len(SHARES) + len(SIZES)) + 24
#: The bound of the fitting sample.
TRAINING = 4000


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's inputs."""
    count = Counter(_words(text))
    at = np.fromiter((zlib.crc32(w.encode("utf-8")) % WORDS for w in count), np.int64, len(count))
    value = np.bincount(at, np.log1p(np.fromiter(count.values(), np.float64, len(count))), WORDS) if count else np.zeros(WORDS)
    places = np.flatnonzero(value)
    value = value[places] / max(np.sqrt(value @ value), 1e-12)
    s = dict(zip(STATS, text_stats(text)))
    rest, base = [], WORDS
    for a, b in SHARES:
        share = s[a] / max(s[b], 1)
        if a == "word_chars":
            share /= 16
        # finer steps near 0, where most shares lie
        rest.append(base + min(BINS - 1, int(BINS * min(share, 1.0) ** 0.5)))
        base += BINS
    for a in SIZES:
        rest.append(base + min(BINS - 1, int(s[a]).bit_length()))
        base += BINS
    rest.append(base + min(23, len(text).bit_length()))
    return np.concatenate([places, rest]).astype(np.int64), np.concatenate([value, np.full(len(rest), 0.3)]).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, text: str) -> float:
        at, x = inputs(text)
        v = self.factors[at] * x[:, None]
        sums = v.sum(axis=0)
        z = self.bias + float(self.weight[at] @ x) + 0.5 * float(sums @ sums - (v * v).sum())
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 15, batch: int = 64, rate: float = 0.08, shrink: float = 1e-5) -> FactorisationMachine:
    """Logistic loss, mini-batches in a fixed random order, adaptive steps."""
    random = np.random.default_rng(8)
    w, v = np.zeros(DIM, np.float32), random.normal(0, 0.02, (DIM, RANK)).astype(np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    bias, gb, gw, gv = float(np.log(share / (1 - share))) if len(y) else 0.0, 1e-6, np.full(DIM, 1e-6, np.float32), np.full((DIM, RANK), 1e-6, np.float32)
    for _ in range(rounds if len(rows) else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = np.zeros((len(some), DIM), np.float32)
            for i, r in enumerate(some):
                x[i, rows[r][0]] = rows[r][1]
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            vu = v[used]
            sums = x @ vu
            z = bias + x @ w[used] + 0.5 * ((sums**2).sum(axis=1) - ((x**2) @ (vu**2)).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            dw = x.T @ err + shrink * w[used]
            dv = x.T @ (err[:, None] * sums) - ((x**2).T @ err)[:, None] * vu + shrink * vu
            db = float(err.sum())
            gb, gw[used], gv[used] = gb + db * db, gw[used] + dw * dw, gv[used] + dv * dv
            bias -= rate * db / gb**0.5
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return FactorisationMachine(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING) -> FactorisationMachine:
    """docs: doc_id, text, all of which may be learned from; labels: doc_id, quality. At most ``rows`` reach the driver."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id").distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(F.broadcast(ids), "doc_id")  # at most ``rows`` ids
    chosen = chosen.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(content()).alias("text")).select("label", "text")  # and as many rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, x = inputs(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([x.astype("<f4").tobytes()])], names=["label", "places", "inputs"])

    found = [(np.frombuffer(r["places"], "<u2").astype(np.int64), np.frombuffer(r["inputs"], "<f4"), r["label"]) for r in chosen.mapInArrow(run, "label int, places binary, inputs binary").collect()]
    return fit_rows(sorted(found, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())))


def score(text: Column, model: FactorisationMachine) -> Column:
    @arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([model.score(x.as_py()) for x in batch], pa.float64())

    return run(text)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(crc_fold() != 0), table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_fold() == 0).alias("held_out"), score(content(), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))

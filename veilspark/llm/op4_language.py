"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its letter n-grams (1 to 3 letters of the lower-cased text, anything else counting as one
blank), hashed to DIM places, with damped counts and unit length. Each language has up to CLUSTERS centroids, found by spherical
k-means, and a text takes the language of the centroid of greatest cosine. It is rejected if its distance from that centroid
exceeds the centroid's own bound: RADIUS times the distance that 99 % of its training texts keep to.

Document frequencies come from all training rows, in one aggregation of DIM counts. Every language of the
training rows gets centroids, fitted in a task of its own on at most SAMPLE of its rows, those of least id hash.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without training rows all are;
rows with a null id are held out of training; of several texts with one id and language the least may be learned from; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from .common import crc_fold, materialize, table

DIM = 4096
#: The bound of the fitting sample of one language.
SAMPLE = 300
#: Parts of a language in which its sample is looked for before they meet.
GROUPS = 64
CLUSTERS, RADIUS, SHARPNESS = 3, 1.5, 25.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    out = np.zeros(DIM, np.int64)
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(16))
        h = (h * np.uint32(0x7FEB352D)) >> np.uint32(20)
        out += np.bincount(h, minlength=DIM)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of all rows of ``texts`` (column text): how many hold each hashed n-gram, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid and (g := grams(x.as_py())) is not None:
                    total += g > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, n))], names=["place", "n"])

    found = {r["place"]: r["n"] for r in texts.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(DIM)]), found.get(DIM, 0)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids; the first start is the row nearest the mean, each next one the row farthest from those chosen."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    chosen = [int((x @ unit(x.mean(axis=0))).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centroids = x[chosen]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        after = np.array([unit(x[own == j].mean(axis=0)) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        if np.allclose(after, centroids, atol=1e-6):
            break
        centroids = after
    return centroids.astype(np.float32)


@dataclass
class LanguageModel:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    bound: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, distance to its centroid, and whether that distance rejects it."""
        counts = grams(text) if text else None
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, 1.0, True
        near = self.centroids @ vector(counts, self.idf)
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, near)
        at = int(near.argmax())
        score = 1 / np.exp(SHARPNESS * (best - best.max())).sum()
        return self.langs[self.owner[at]], float(score), float(1 - near[at]), bool(1 - near[at] > self.bound[at])


def sampled(texts: DataFrame) -> DataFrame:
    """(lang, doc_id): the SAMPLE ids of least hash of each language, found in GROUPS parts of a language first."""
    rows = texts.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id"))
    for key in (["lang", F.pmod("h", F.lit(GROUPS))], ["lang"]):
        order = Window.partitionBy(*key).orderBy("h", "doc_id")
        rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)
    return rows.select("lang", "doc_id")


def centroids_of(texts: DataFrame, idf: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, centroids, bounds) of every language, by lang; only these reach the driver, the sample of a language meets in one task."""
    ids = materialize(sampled(texts), "sample")  # a table of known size: Spark sends it to the texts if it is small, as it is for some hundred languages

    def fitted(lang: str, counts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.array([vector(c, idf) for c in sorted(counts, key=lambda c: c.tobytes())])
        found = spherical_kmeans(x, CLUSTERS)
        near = x @ found.T
        far = [1 - near[near.argmax(axis=1) == j, j] for j in range(len(found))]
        bound = np.array([min(1.0, RADIUS * float(np.quantile(f, 0.99))) if len(f) else 0.0 for f in far])
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found.tobytes()]), pa.array([bound.tobytes()])], names=["lang", "centroids", "bounds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = None, []
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if lang.as_py() != own:
                    if counts:
                        yield fitted(own, counts)
                    own, counts = lang.as_py(), []
                if (g := grams(text.as_py())) is not None:
                    counts.append(g)
        if counts:
            yield fitted(own, counts)

    chosen = texts.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    dealt = chosen.select("lang", "text").repartition("lang").sortWithinPartitions("lang")
    rows = dealt.mapInArrow(run, "lang string, centroids binary, bounds binary").collect()
    return sorted(((r["lang"], np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM), np.frombuffer(r["bounds"])) for r in rows), key=lambda x: x[0])


def fit(training: DataFrame) -> LanguageModel:
    """A model from rows with doc_id, text and lang, all of which may be learned from."""
    texts = training.where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(texts)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    found = centroids_of(texts, idf)
    owner = np.repeat(np.arange(len(found)), [len(c) for _, c, _ in found])
    centroids = np.concatenate([np.empty((0, DIM), np.float32), *(c for _, c, _ in found)])
    return LanguageModel(idf, [lang for lang, _, _ in found], centroids, owner, np.concatenate([np.empty(0), *(b for _, _, b in found)]))


def predict(text: str, model: LanguageModel) -> Column:
    """struct(lang, score, distance, rejected) of each text."""

    @arrow_udf("struct<lang:string,score:double,distance:double,rejected:boolean>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            columns = list(zip(*(model.predict(x.as_py()) for x in batch))) or [()] * 4
            kinds = pa.string(), pa.float64(), pa.float64(), pa.bool_()
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "score", "distance", "rejected"])

    return run(F.col(text))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_fold() != 0).select("doc_id", "text", "lang"))
    out = docs.select("doc_id", (crc_fold() == 0).alias("held_out"), predict("text", model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.distance").alias("distance"), F.col("p.rejected").alias("rejected"))

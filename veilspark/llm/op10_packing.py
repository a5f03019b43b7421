"""Best-fit packing of documents into token sequences, by length patterns and non-negative least squares.

1. Each document's ids, closed by the id 0, are cut into pieces of at most CAPACITY tokens; the histogram of piece lengths has at
   most CAPACITY rows whatever the input, and all planning is done on it.
2. *Patterns*: all ways to fill a sequence with at most PARTS pieces, in units of GRAIN tokens, are enumerated; non-negative
   least squares finds how often to use each so that together they use up the histogram; the counts are rounded down.
3. A pattern is carried out with exact lengths: its slots take the longest pieces left in their bins, its last slot the longest
   piece that still fits.
4. *Residuals*, and the gaps left by patterns, are packed by best fit, longest first, many equal pieces at a time.
5. Every piece gets its rank among the pieces of its length, counted in hash buckets so that a length that a third of all pieces have
   spreads over tasks, and looks its sequence and offset up in the plan (a few thousand runs).

Defined results: null text counts as empty; an empty document is one piece of one token; repeated rows are packed each by
itself; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from .common import content, materialize, table
from .op1_bpe import WordBPE, byte_symbols, vocabulary_path

CAPACITY, GRAIN, PARTS = 2048, 32, 4
END = (0).to_bytes(4, "little")


class LibraryBPE(WordBPE):
    """The same text rules and word cache, with new words merged by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.symbol = {b: ord(c) for b, c in enumerate(byte_symbols())}

    def merge(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.symbol))]


@lru_cache(maxsize=4)
def load(path: str) -> LibraryBPE:
    return LibraryBPE(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: where each document's ids are cut."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = bpe.encode(text.as_py()) + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                numbers = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), content(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(units: int, parts: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of 1 to ``parts`` positive numbers that add up to ``units``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < parts:
            for x in range(min(left, most), 0, -1):
                extend((*head, x), left - x, x)

    extend((), units, units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-10 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        if slope.max() <= small:
            break
        active[slope.argmax()] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            under = active & (trial <= 0)
            if not under.any():
                break
            move = np.where(under, x / np.where(under, np.maximum(x - trial, 1e-300), 1), np.inf)
            x += min(1.0, move.min()) * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
        x = trial
    return x


class Stock:
    """Pieces left by length."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.left)

    def longest(self, most: int, least: int = 1) -> int | None:
        """The greatest length left from least to most."""
        i = bisect.bisect_right(self.lengths, most) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] >= least else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, parts: int = PARTS) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences: ([(length, pieces of it in a sequence)], number of sequences)."""
    stock, done = Stock(histogram), []
    open_by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []

    def put(slots: list[tuple[int, int]], n: int) -> None:
        gap = capacity - sum(length * t for length, t in slots)
        if not gap:
            done.append((slots, n))
            return
        if gap not in open_by_gap:
            bisect.insort(gaps, gap)
        open_by_gap.setdefault(gap, []).append((slots, n))

    units = capacity // grain
    bins = np.zeros(units)
    for length, n in histogram.items():
        bins[-(-length // grain) - 1] += n
    shapes = patterns(units, parts)
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for x in shape:
            a[x - 1, j] += 1
    total = max(bins.sum(), 1.0)
    uses = np.floor(nnls(a, bins / total) * total + 1e-6).astype(np.int64)
    for j in sorted(range(len(shapes)), key=lambda j: -shapes[j][0]):
        need = int(uses[j])
        while need:
            slots: list[tuple[int, int]] = []
            room = capacity
            for k, x in enumerate(shapes[j]):
                last = k == len(shapes[j]) - 1
                length = stock.longest(room if last else min(room, x * grain), 1 if last else (x - 1) * grain + 1)
                if length is None:
                    break
                slots.append((length, 1))
                room -= length
                # the same length may serve several slots
                if sum(y == length for y, _ in slots) > stock.left[length]:
                    slots.pop()
                    room += length
                    break
            if not slots or len(slots) < len(shapes[j]) and len(shapes[j]) > 1:
                break  # its bins have run dry; what is left is packed below
            n = min(need, *(stock.left[y] // sum(z == y for z, _ in slots) for y, _ in slots))
            for y, _ in slots:
                stock.take(y, n)
            put(slots, n)
            need -= n
    while stock.lengths:
        length = stock.lengths[-1]
        n = stock.left[length]
        i = bisect.bisect_left(gaps, length)
        if i == len(gaps):
            t = capacity // length
            if n >= t:
                put([(length, t)], n // t)
                stock.take(length, n // t * t)
            else:
                put([(length, n)], 1)
                stock.take(length, n)
            continue
        gap = gaps[i]
        slots, count = open_by_gap[gap].pop()
        if not open_by_gap[gap]:
            del open_by_gap[gap]
            gaps.pop(i)
        t = min(gap // length, n)
        filled = min(count, n // t)
        put([*slots, (length, t)], filled)
        stock.take(length, filled * t)
        if count > filled:
            put(slots, count - filled)
    return done + [x for groups in open_by_gap.values() for x in groups]


class Lookup:
    """(length, rank) -> sequence and offset, from a plan."""

    def __init__(self, groups: list[tuple[list[tuple[int, int]], int]]):
        rank: dict[int, int] = {}
        rows, base = [], 0
        for slots, n in groups:
            offset = 0
            for length, t in slots:
                rows.append((length, rank.get(length, 0), t, base, offset))
                rank[length] = rank.get(length, 0) + n * t
                offset += length * t
            base += n
        rows.sort()
        self.sequences = base
        self.length, self.first, self.times, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.begin = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            lo, hi = self.begin[x], self.begin[x + 1]
            row[own] = lo + np.searchsorted(self.first[lo:hi], rank[own], side="right") - 1
        k = rank - self.first[row]
        return self.base[row] + k // self.times[row], self.offset[row] + length * (k % self.times[row])


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``parts`` is a written table, it is read twice."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    lookup = Lookup(plan(histogram, capacity))
    buckets = 16 + sum(histogram.values()) // 200_000
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))  # at most ``buckets`` rows for each length
    skips = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(skips, ["bucket", "length"])

    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def look(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = lookup(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    out = ranked.withColumn("at", look(F.col("length"), F.col("skip") + F.col("nth") - 1))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there."""
    return place(materialize(pieces(docs, path or vocabulary_path(), id_col, text_col, capacity), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the mergeable neighbours by (merge rank,
place). The best entry is taken, skipped if one of its symbols has merged meanwhile (a stale entry), else
its pair merges and the two new neighbour pairs enter the queue. Decoding concatenates vocabulary strings, with the file's
separator (a blank where the file names no decoder). Texts with letters whose lower case this Python's Unicode tables don't
know as the tokenizers library does (some 50, none in common scripts) are lower-cased by that library.

Words repeat, so each worker keeps the ids of the words met, at most CACHE_WORDS of them; the cache
changes the speed only. Text goes in and ids come out in Arrow batches as flat buffers.

Defined results: null text encodes as the empty text, to no ids; null ids decode to the empty text; the strings of special
tokens in a text become those tokens; repeated rows give equal results; other columns are kept, and an output
column of the same name is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCABULARY = "word_bpe_49k.json"
#: Words kept per worker; about 60 MB.
CACHE_WORDS = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def other_cases():
    """A search for characters whose lower case differs between this Python and the tokenizers library; cased letters lie in the
    planes 0 and 1."""
    from tokenizers import normalizers

    chars = list(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]))
    lower = normalizers.Lowercase().normalize_str("\n".join(chars)).split("\n")
    differ = "".join(c for c, low in zip(chars, lower) if ("σ" if c == "Σ" else c.lower()) != low)
    return re.compile(f"[{re.escape(differ)}]").search if differ else lambda text: None


def newer_letters(pattern: str):
    """The regex package may know letters and digits of a later Unicode than the tokenizers library. Returns a search
    for characters from the first such one on, and a findall that takes them for neither letter nor digit."""
    from tokenizers import Regex, normalizers

    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)])))
    newer = normalizers.Replace(Regex(r"[\p{L}\p{N}]"), "").normalize_str("".join(known))
    if not newer:
        return (lambda text: None), None
    out = f"[{newer}]"
    for plain, exact in ((r"[\p{L}]+", rf"[\p{{L}}--{out}]+"), (r"[\p{N}]", rf"[\p{{N}}--{out}]"), (r"[^\p{White_Space}\p{L}\p{N}]+", rf"(?:{out}|[^\p{{White_Space}}\p{{L}}\p{{N}}])+")):
        if plain not in pattern:
            raise ValueError(f"{plain} is not in the pattern {pattern}")
        pattern = pattern.replace(plain, exact)
    return re.compile(f"[{min(newer)}-\U0010ffff]").search, regex.compile(pattern, regex.V1).findall


def latin_words(pattern: str):
    """The same findall for texts of the first 256 characters only, where plain character sets do."""
    sets = {k: "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    blank = r"\t-\r\x20\x85\xa0"
    return re.compile(pattern.replace(r"\p{White_Space}", blank).replace(r"\p{L}", sets["L"]).replace(r"\p{N}", sets["N"])).findall


class WordBPE(dict):
    """Word -> its ids as little-endian 32-bit bytes, filled as words are met."""

    def __init__(self, path: str):
        from tokenizers import normalizers

        super().__init__()
        self.lowercase = normalizers.Lowercase().normalize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] is not None:
            raise ValueError(f"{path}: its normalizer, pre-tokenizer or decoder is of another kind")
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        skip = len(model["continuing_subword_prefix"] or "")
        #: Rank by pair, a pair as one number; and the symbol that a merge of each rank makes.
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [vocab[a + b[skip:]] for a, b in model["merges"]]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.newer, self.older_words = newer_letters(pattern)
        self.latin_words = latin_words(pattern)
        self.other_case = other_cases()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {s: np.int32(i).tobytes() for s, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.names = [""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in [*vocab.items(), *special.items()]:
            self.names[i] = s
        self.strings = pa.array(self.names)

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, rank_of = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        # an entry is rank << 32 | place of the left symbol
        queue = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or rank_of(ids[i] << 32 | ids[j]) != entry >> 32:
                continue  # stale: a neighbour has merged since this entry was made
            ids[i] = made = self.made[entry >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of(made << 32 | ids[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] << 32 | made)) is not None:
                heappush(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.merge(word)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if self.other_case(text):
                text = self.lowercase(text)
            else:
                text = text.replace("Σ", "σ").lower()  # each letter alone: a final sigma is not told apart
            if self.newer(text):
                return b"".join(map(self.__getitem__, self.older_words(text)))
            return b"".join(map(self.__getitem__, self.words(text)))
        return b"".join(map(self.__getitem__, self.latin_words(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit bytes."""
        if len(self) > CACHE_WORDS:
            self.clear()
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.cut(text) if x)


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _with(frame: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in frame.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that a worker holds little besides its cache."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _put(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [n for n in part.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), column], names=[*kept, name])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in _slices(batches):
            ids = [bpe.encode(x.as_py() or "") for x in part.column(text_col)]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield _put(part, ids_col, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat))

    return docs.mapInArrow(run, _with(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """frame with the text of each array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load(path).strings
        for part in _slices(batches):
            ids = part.column(ids_col).fill_null([])
            names = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), strings.take(ids.flatten()))
            yield _put(part, text_col, pc.binary_join(names, " "))

    return frame.mapInArrow(run, _with(frame, text_col, T.StringType()))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

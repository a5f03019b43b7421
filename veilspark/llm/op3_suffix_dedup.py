"""Suffix-array deduplication of passages.

A byte goes if a ``LENGTH``-byte string that covers it starts at another place too. All suffixes that can share such a string
must meet in one bucket, and buckets must stay small however large the corpus:

1. *Anchors*: each LENGTH-byte string names the place in it whose ``GRAM``-byte hash is least. Equal strings name equal places,
   so a suffix's bucket is the hash at its anchor. A string whose anchor hash occurs once in the corpus is not repeated; only
   the others go on.
2. *Buckets*: the text around each remaining anchor travels to its bucket. A hash that occurs over ``HOT`` times is split: equal
   contexts are combined, then cut in groups of neighbouring starts, and the content that all strings of a group share names its
   bucket. A bucket that still has over ``HOT`` distinct contexts is split again in smaller groups, down to single starts (``STEPS``), where
   a bucket has one context. So no bucket holds over ``HOT`` contexts, however many texts share a passage.
3. *Sorting*: each task takes bucket after bucket, in blocks of bounded size, and sorts their suffixes by difference
   cover (see ``suffixes``). Neighbours that agree over LENGTH bytes are repeated strings.
4. The spans go back to their texts, and from there to all rows with that text. Copies of a whole text are counted before
   anything travels: such a text goes wholly, and one of it serves the comparison with others.

Defined results: null text counts as empty; texts shorter than LENGTH bytes are never cut; repeated rows remove each other's
bytes wholly; matches never cross documents; an empty table gives no rows; other columns stay as they are. ``remove_repeats`` returns
text, so it keeps a character whose bytes are removed only in part; the byte counts and the digest of the query don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import content, each_salt, materialize, salt_of, salts_met, spread, table
from .suffixes import repeated, repeated_pairs

LENGTH, GRAM = 200, 48
#: Contexts beyond which a bucket is split, and the starts in one group of a bucket split once, twice, three times.
HOT, STEPS = 2000, (16, 4, 1)
#: Bytes of text hashed at a time, and of context sorted at a time.
CHUNK, BLOCK = 1 << 17, 1 << 20
_random = np.random.default_rng(20240503)
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _random.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH, _U32 = np.uint64(0xFFFFFFFF00000000), np.uint64(32)


def grams(text: np.ndarray) -> np.ndarray:
    """The hash of the GRAM = 32 + 16 bytes from each place on."""
    h = _BYTE[text]
    for i in range(5):
        if i == 4:
            h16 = h
        h = h[: -(1 << i)] * _MULT[i] + h[1 << i :]
    h = h[:-16] * _MULT[5] + h16[32:]
    h ^= h >> _U32
    h *= _MULT[6]
    h ^= h >> _U32
    return h


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes, and the anchor of the string from each start on: the first place of the least hash."""
    h = grams(text)
    least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    return h, (least & ~_HIGH).astype(np.int64)


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of several texts, and (row, begin, end) of those of LENGTH bytes or more."""
    held, rows, size = [], [], 0
    for row, x in enumerate(texts):
        raw = x.as_py().encode("utf-8")
        if len(raw) < LENGTH:
            continue
        held.append(raw)
        rows.append((row, size, size + len(raw)))
        size += len(raw)
        if size >= CHUNK:
            yield np.frombuffer(b"".join(held), np.uint8), rows
            held, rows, size = [], [], 0
    if rows:
        yield np.frombuffer(b"".join(held), np.uint8), rows


def runs(anchor: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each run of starts of one document with one anchor."""
    own = anchor[begin : end - LENGTH + 1]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) + begin
    return first, np.append(first[1:], end - LENGTH + 1) - 1


def anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, n): each distinct anchor hash of each text and how often it has it there; periodic text repeats one hash often."""
    for batch in batches:
        key, text = batch.column(0), batch.column(1)
        for data, rows in chunks(text):
            h, anchor = anchors(data)
            own, found, times = [], [], []
            for row, begin, end in rows:
                first, _ = runs(anchor, begin, end)
                value, n = np.unique(h[anchor[first]], return_counts=True)
                found.append(value)
                times.append(n)
                own.append(np.full(len(value), row))
            columns = [key.take(pa.array(np.concatenate(own))), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(times).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "n"])


PIECE = "bucket bigint, off int, ctx binary, uid bigint, start bigint, hi bigint, hot boolean, digest binary"
_PIECE = pa.schema([("bucket", pa.int64()), ("off", pa.int32()), ("ctx", pa.binary()), ("uid", pa.int64()), ("start", pa.int64()), ("hi", pa.int64()), ("hot", pa.bool_()), ("digest", pa.binary())])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context of each anchor whose hash recurs: the bytes of all strings with that anchor. off: from the first start to the anchor.
    A text that has copies goes wholly; its contexts serve the other texts and have no uid. In periodic text one context follows itself:
    its strings are repeated at once, so it is sent once without a uid, beside one row without context for the starts from start to hi."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    for batch in batches:
        uid, text, hashes, hot, copies = (batch.column(i) for i in range(5))
        rows, size = [], 0
        for data, docs in chunks(text):
            h, anchor = anchors(data)
            raw = data.tobytes()
            for row, begin, end in docs:
                first, last = runs(anchor, begin, end)
                at = anchor[first]
                own = h[at].view(np.int64)
                listed = np.flatnonzero(np.isin(own, hashes[row].values.to_numpy()))
                heavy = set(hot[row].values.to_numpy().tolist())
                u = uid[row].as_py() if copies[row].as_py() == 1 else None
                before, since, until = None, 0, 0
                for a, lo, hi, bucket in [*zip(at[listed].tolist(), first[listed].tolist(), last[listed].tolist(), own[listed].tolist()), (0, 0, -1, None)]:
                    ctx = raw[lo : hi + LENGTH]
                    if before == (bucket, a - lo, ctx) and lo == until + 1:
                        until = hi  # the same strings at the next period
                        continue
                    if before is not None:
                        b, off, held = before
                        once = until - since == len(held) - LENGTH
                        digest = xxhash.xxh3_128_digest(held + off.to_bytes(2, "little") + b.to_bytes(8, "little", signed=True)) if b in heavy else None
                        rows.append((b, off, held, u if once else None, since - begin, None, b in heavy, digest))
                        size += len(held)
                        if not once and u is not None:
                            rows.append((None, None, None, u, since - begin, until - begin, False, None))
                    before, since, until = (bucket, a - lo, ctx), lo, hi
                if size >= 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)


CUT = "bucket bigint, off int, ctx binary, digest binary, part_of binary, at bigint, n bigint"
_CUT = pa.schema([("bucket", pa.int64()), ("off", pa.int32()), ("ctx", pa.binary()), ("digest", pa.binary()), ("part_of", pa.binary()), ("at", pa.int64()), ("n", pa.int64())])


def split(step: int):
    """Cuts contexts (bucket, off, ctx, digest, n) in groups of ``step`` starts, counted from the anchor. The bucket of a group is the hash of
    the bytes that all its strings share, so equal strings still meet; part_of and at: the context that it was cut from, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, off, ctx, digest, n in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = 0, len(ctx) - LENGTH
                while lo <= hi:
                    group = (off - lo) // step
                    stop, core = min(hi, off - group * step), off - group * step
                    shared = ctx[core : core - step + 1 + LENGTH]
                    own, held = xxhash.xxh3_64_intdigest(shared, seed=(bucket + group) % 2**64) - 2**63, ctx[lo : stop + LENGTH]
                    key = xxhash.xxh3_128_digest(held + (off - lo).to_bytes(2, "little") + own.to_bytes(8, "little", signed=True))
                    rows.append((own, off - lo, held, key, digest, lo, n))
                    lo = stop + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)

    return run


RUN = "uid bigint, digest binary, lo bigint, hi bigint"
_RUN = pa.schema([("uid", pa.int64()), ("digest", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])


def sort_block(rows: list[tuple]) -> list[tuple]:
    """Runs (uid, digest, first start, last start) of repeated strings of a block of whole buckets; rows: bucket, off, ctx, uid, start, n, digest.
    A bucket of one context has nothing to compare; two contexts are compared at once; more are sorted."""
    bucket, members = np.unique(np.array([r[0] for r in rows]), return_inverse=True, return_counts=True)[1:]
    size = members[bucket]
    out = []
    for pick, test in ((size == 1, None), (size == 2, repeated_pairs), (size > 2, repeated)):
        if pick.any():
            own = np.flatnonzero(pick)
            out += _runs_of([rows[i] for i in own.tolist()], bucket[own], test)
    return out


def _runs_of(rows: list[tuple], bucket: np.ndarray, test) -> list[tuple]:
    sizes = np.array([len(r[2]) for r in rows])
    counts = sizes - LENGTH + 1
    ends, total = np.cumsum(counts), int(counts.sum())
    row = np.repeat(np.arange(len(rows)), counts)
    found = np.array([r[5] > 1 for r in rows])[row]
    step = np.arange(total) - np.repeat(ends - counts, counts)
    if test is not None:
        begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b"\xff".join(r[2] for r in rows), np.uint8)  # no UTF-8 text holds this byte
        off = np.array([r[1] for r in rows])
        found |= test(text, begins[row] + step, bucket[row] * LENGTH + off[row] - step, LENGTH)
    # runs of found starts that don't go on into the next context
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])) != 0)
    out = []
    for lo, hi in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
        while lo <= hi:
            r = int(row[lo])
            stop = min(hi, int(ends[r]) - 1)
            _, _, _, uid, start, _, digest = rows[r]
            if uid is not None or digest is not None:
                out.append((uid, digest, start + int(step[lo]), start + int(step[stop])))
            lo = stop + 1
    return out


def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, bucket = [], 0, None

    def out() -> Iterator[pa.RecordBatch]:
        if found := sort_block(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _RUN)], schema=_RUN)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for r in zip(*columns):
            if r[0] != bucket and size >= BLOCK:
                yield from out()
                rows, size = [], 0
            bucket = r[0]
            rows.append(r)
            size += len(r[2])
    if rows:
        yield from out()


def _spans(starts: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed byte runs [a, b) from runs of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def cut_texts(text: pa.Array, starts: pa.Array) -> pa.Array:
    """The text without the spans: as bytes, and as text, where a character cut in part stays whole."""
    rows = []
    for t, s in zip(text.to_pylist(), starts.to_pylist()):
        raw = t.encode("utf-8")
        spans = _spans(s or [])
        kept, shown, at, seen = [], [], 0, 0
        for a, b in spans:
            kept.append(raw[at:a])
            at = b
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1  # from the next character on
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1  # up to the one that is cut
            shown.append(raw[seen:a])
            seen = b
        kept.append(raw[at:])
        shown.append(raw[seen:])
        rows.append({"n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept": b"".join(kept), "kept_text": b"".join(shown).decode("utf-8")})
    return pa.array(rows, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string())]))


def cut(text: str, starts: str) -> Column:
    run = arrow_udf(cut_texts, "struct<n_removed:bigint,n_spans:bigint,kept:binary,kept_text:string>")
    return run(F.col(text), F.col(starts))


def text_key(text_col: str) -> Column:
    """128 bits of the text's SHA-256: rows of equal texts share all results."""
    return F.substring(F.unhex(F.sha2(content(text_col), 256)), 1, 16)


def parts_of_hot(heavy: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The contexts (bucket, off, ctx, digest, n) that heavy ones are cut into, none of whose buckets is crowded, and for each round of
    cutting what was cut from what (digest, part_of, at)."""
    done, cuts = None, []
    for step in STEPS:
        cut = materialize(heavy.mapInArrow(split(step), CUT), "cut")
        cuts.append(cut.select("digest", "part_of", "at"))
        combined = cut.groupBy("bucket", "off", "ctx", "digest").agg(F.sum("n").alias("n"))
        distinct = cut.select("bucket", "digest").distinct()
        crowded = distinct.groupBy("bucket").agg(F.count("*").alias("contexts"), salts_met(salt_of("digest")).alias("met")).where(F.col("contexts") > HOT)
        crowded = materialize(crowded, "crowded")
        last = step == STEPS[-1] or crowded.isEmpty()
        if not last:
            flags = crowded.select("bucket", each_salt(F.col("met")).alias("salt"), F.lit(True).alias("again"))
            combined = materialize(combined.withColumn("salt", salt_of("digest")).join(flags, ["bucket", "salt"], "left").drop("salt"), "combined")
            heavy, combined = combined.where("again").drop("again"), combined.where("again IS NULL").drop("again")
        done = combined if done is None else done.unionByName(combined)
        if last:
            break
    return done, cuts


def runs_of_hot(found: DataFrame, cuts: list[DataFrame], where: DataFrame) -> DataFrame:
    """(uid, runs) of the runs (digest, lo, hi) found in parts of hot contexts: from part to whole, and from there to all texts
    that hold it (digest, uid, start)."""
    runs = found
    for cut in reversed(cuts):
        per_part = runs.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # under LENGTH runs each
        up = spread(cut, per_part, "digest", "part_of").select(F.col("part_of").alias("digest"), "at", F.explode("runs").alias("r"))
        up = up.select("digest", (F.col("r.lo") + F.col("at")).alias("lo"), (F.col("r.hi") + F.col("at")).alias("hi"))
        runs = up.unionByName(found) if cut is not cuts[0] else up
    per_context = runs.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return spread(where, per_context, "digest", "uid").select("uid", F.expr("transform(runs, r -> struct(r.lo + start AS lo, r.hi + start AS hi))").alias("runs"))


def repeats(docs: DataFrame, text_col: str = "text", by: Column | None = None) -> DataFrame:
    """(key, text, starts, met) of the distinct texts that hold repeated strings; starts: runs of their first bytes. key is ``text_key``,
    met notes the salts ``by`` of the rows with that text."""
    long = docs.select(text_key(text_col).alias("key"), content(text_col).alias("text"), (F.lit(0) if by is None else by).alias("salt")).where(F.octet_length("text") >= LENGTH)
    hashes = materialize(long.select("key", "text").mapInArrow(anchor_hashes, "key binary, h bigint, n bigint"), "anchors")
    salted = hashes.withColumn("salt", salt_of("key"))
    again = salted.groupBy("h").agg(F.sum("n").alias("total"), salts_met(F.col("salt")).alias("met")).where("total > 1")
    listed = salted.join(again.select("h", "total", each_salt(F.col("met")).alias("salt")), ["h", "salt"])
    listed = listed.groupBy("key").agg(F.collect_set("h").alias("hashes"), F.collect_set(F.when(F.col("total") > HOT, F.col("h"))).alias("hot"))
    texts = long.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"), salts_met(F.col("salt")).alias("met"))  # copies meet before they travel
    flagged = materialize(texts.join(listed.hint("merge"), "key").withColumn("uid", F.monotonically_increasing_id()), "flagged")
    parts = materialize(flagged.select("uid", "text", "hashes", "hot", "copies").mapInArrow(pieces, PIECE), "contexts")
    few = parts.where("NOT hot AND ctx IS NOT NULL").select("bucket", "off", "ctx", "uid", "start", F.lit(1).cast("bigint").alias("n"), "digest")
    heavy = parts.where("hot").groupBy("bucket", "off", "ctx", "digest").agg(F.count("*").alias("n"))  # equal contexts meet before they are cut
    heavy, cuts = parts_of_hot(heavy.select("bucket", "off", "ctx", "digest", "n"))
    heavy = heavy.select("bucket", "off", "ctx", F.lit(None).cast("bigint").alias("uid"), F.lit(0).cast("bigint").alias("start"), "n", "digest")
    found = materialize(few.unionByName(heavy).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_buckets, RUN), "runs")
    hot = runs_of_hot(found.where("digest IS NOT NULL").select("digest", "lo", "hi"), cuts, parts.where("hot AND uid IS NOT NULL").select("digest", "uid", "start"))
    plain = found.where("digest IS NULL").select("uid", "lo", "hi").unionByName(parts.where("ctx IS NULL").select("uid", F.col("start").alias("lo"), "hi"))
    plain = plain.select("uid", F.array(F.struct("lo", "hi")).alias("runs"))
    all_of_it = F.struct(F.lit(0).cast("bigint").alias("lo"), (F.octet_length("text") - LENGTH).cast("bigint").alias("hi"))
    whole = flagged.where("copies > 1").select("uid", F.array(all_of_it).alias("runs"))
    per_text = plain.unionByName(hot).unionByName(whole).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("starts"))
    return flagged.select("uid", "key", "text", "met").join(per_text.hint("merge"), "uid").drop("uid")  # texts travel alike at every size


def changed(docs: DataFrame, text_col: str, by: Column) -> DataFrame:
    """own_key, salt and the result c of ``cut``, for each distinct text that loses bytes and each salt ``by`` of its rows."""
    found = repeats(docs, text_col, by).select(F.col("key").alias("own_key"), "met", cut("text", "starts").alias("c"))
    return found.select("own_key", "c", each_salt(F.col("met")).alias("salt"))


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their repeated passages removed from the text; all other columns as they are."""
    told = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and isinstance(f.dataType, T.AtomicType)]
    by = salt_of(*told) if told else F.lit(0)
    new = changed(docs, text_col, by).select("own_key", "salt", F.col("c.kept_text").alias("kept_text"), F.lit(True).alias("is_new"))
    rows = docs.select(F.struct("*").alias("row"), text_key(text_col).alias("own_key"), by.alias("salt"))
    met = rows.join(new.hint("merge"), ["own_key", "salt"], "left")
    return met.select(*[F.when(F.col("is_new"), F.col("kept_text")).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha, by = F.sha2(content(), 256), salt_of("doc_id")
    whole = docs.select("doc_id", F.octet_length(content()).cast("long").alias("n_bytes"), sha.alias("sha"), text_key("text").alias("own_key"), by.alias("salt"))
    new = changed(docs, "text", by).select("own_key", "salt", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("new"))
    met = whole.join(new.hint("merge"), ["own_key", "salt"], "left")
    zero = F.lit(0).cast("long")
    return met.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("new", "sha").alias("kept_sha256"))

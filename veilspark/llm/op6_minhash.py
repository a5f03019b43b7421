"""MinHash near-duplicates.

1. *Sketch*: each document's set of shingles (as 64-bit hashes) gives ``ROWS`` universal hash minima for each band; the number of
   bands follows from the similarity asked for. Documents with the same set are one node from here on.
2. *Banding*: ``ROWS`` minima make a band key. Each member of a band bucket is tied to the bucket's smallest node, its hub, never to
   every other member.
3. *Signature verification and exact links*: ties whose signatures agree are proven on the full sets, a hub's set held while the
   sets of its members pass by; components of the proven ties are the first groups. A bucket whose members all lie in
   one group is settled, as most are: a large group of near copies costs as much as it has members.
4. Buckets that still hold several groups are compared in whole: their members are cut in blocks of at most ``BLOCK`` documents and
   ``WEIGHT`` shingles, a large group in blocks of its own, and each pair of blocks that can hold a new link is a unit. A unit compares
   signatures, then the full sets of the pairs that pass, and returns a spanning forest of the links, never the list of pairs.
5. *Components* of groups and links by alternating large-star and small-star.

A pair of the least similarity asked for shares no band with probability below MISS: (1 - 0.85 ** 8) ** 44 or (1 - 0.8 ** 8) ** 76.
Its 128 signature bytes fall under the signature bound with probability below 2e-8 at either. Nothing else is lost: there is no cap on buckets, groups or candidates.
The work grows with the square of a bucket's documents only for those that its hub does not tie together, in bounded blocks that spread over the tasks.

Defined results: null, empty or blank text has no shingles, is linked with nothing and stays; fewer words than a shingle
form one shingle; each row is judged by its own text, so of repeated rows with one id those with one text share a verdict, and a text's
component is named by the smallest id that has a text in it; a row with a null id takes no part and stays, with
a null component; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import each_salt, materialize, salt_of, salts_met, scope, spread, table
from .components import connected_components

#: Minima in one band, and the probability below which a pair of the least similarity asked for may share no band.
ROWS, MISS = 8, 1e-6
SIGNATURE = 128
#: Documents and shingles in one side of a comparison unit.
BLOCK, WEIGHT = 500, 2_000_000
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U32, _U29 = np.uint64(32), np.uint64(29)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; only A-Z are lower-cased."""
    words = _words(text.encode("utf-8").lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    s = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        s += (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> _U29)) * _MIX[i]
    s ^= s >> _U32
    s *= _MIX[63]
    s ^= s >> _U29
    return np.unique(s)


def bands(percent: int) -> int:
    """The least number of bands that misses a pair of that similarity with probability below MISS, and that gives the signature its minima."""
    same = (percent / 100) ** ROWS
    return max(SIGNATURE // ROWS, math.ceil(math.log(MISS) / math.log1p(-same)) if same < 1 else 1)


@lru_cache(maxsize=None)
def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """a (odd) and b of n universal functions; the first of them are the same for every n."""
    drawn = np.random.default_rng(20240301).integers(0, 2**63, (n, 2), dtype=np.uint64)
    return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1].copy()


def minima(s: np.ndarray, n: int, step: int = 256) -> np.ndarray:
    """For each of n universal functions (a * x + b mod 2^64) >> 32 of the 32-bit x, the least value over the set."""
    (a, b), x, least = functions(n), s >> _U32, np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(x), step):
        v = a[:, None] * x[None, i : i + step]
        v += b[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return (least >> _U32).astype(np.uint32)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    kind, n_bands = docs.schema[id_col].dataType.simpleString(), bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ns, digests, keys, signs = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), size)
                    ns.append(len(s))
                    if not len(s):
                        digests.append(None), keys.append([]), signs.append(None)
                        continue
                    m = minima(s, n_bands * ROWS)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) - 2**63 for i, band in enumerate(m.reshape(n_bands, ROWS))])
                    signs.append(m[:SIGNATURE].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    names=["doc_id", "mark", "n_shingles", "digest", "bands", "sign"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("*", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark bigint, n_shingles bigint, digest binary, bands array<bigint>, sign binary")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def least_common(percent: int) -> int:
    """The signature bytes that a linked pair has in common, but for six standard deviations."""
    share = percent / 100
    return int(SIGNATURE * share - 6 * (SIGNATURE * share * (1 - share)) ** 0.5)


def linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> list[bool]:
    """Which of the other sets are linked with the one of ``own``."""
    found = []
    for at in range(0, len(others), 256):
        some = others[at : at + 256]
        joined = np.concatenate(some)
        place = np.minimum(own.searchsorted(joined), len(own) - 1)
        common = np.add.reduceat(own[place] == joined, np.cumsum([0, *map(len, some[:-1])]), dtype=np.int64)
        found += [100 * c >= percent * (len(own) + len(s) - c) for c, s in zip(common.tolist(), some)]
    return found


def unit_links(ids: list, sides: np.ndarray, labels: list, signs: list[bytes], sets: list[np.ndarray], crossing: bool, percent: int) -> list[tuple]:
    """A spanning forest of the links among the documents of one unit that labels don't tie already; between its two sides only if crossing."""
    sign = np.frombuffer(b"".join(signs), np.uint8).reshape(len(ids), SIGNATURE)
    sizes, forest, found, least = np.array([len(s) for s in sets]), Forest(len(ids)), [], least_common(percent)
    first: dict = {}
    for i, label in enumerate(labels):
        forest.join(first.setdefault(label, i), i)
    for i in range(len(ids) - 1):
        near = (sign[i + 1 :] == sign[i]).sum(axis=1) >= least
        near &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        if crossing:
            near &= sides[i + 1 :] != sides[i]
        own = forest.root(i)
        others = [j for j in (np.flatnonzero(near) + i + 1).tolist() if forest.root(j) != own]
        for j, yes in zip(others, linked(sets[i], [sets[j] for j in others], percent)):
            if yes and forest.join(i, j):
                found.append((ids[i], ids[j]))
    return found


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=_EDGES)


def similar(percent: int):
    """Whether two signatures and set sizes allow for a link."""
    least = least_common(percent)

    @arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        sides = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in (x, y)]
        n, m = n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)
        return pa.array(((sides[0] == sides[1]).sum(axis=1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))

    return run


def hub_links(ties: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The ties (node, hub) that are links. A hub's members are dealt to as many units as there are partitions; its text is sent to each."""
    units = int(ties.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, pivot, held, weight = None, None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yes = linked(pivot, [s for _, s in held], percent) if held else []
            if any(yes):
                yield _edges([(node, unit[0]) for (node, _), y in zip(held, yes) if y])

        for batch in batches:
            for row in range(batch.num_rows):
                hub, part, _, node, text = (batch.column(c)[row].as_py() for c in range(5))
                s = shingles(text, size)
                if (hub, part) != unit or len(held) >= 256 or weight >= WEIGHT:
                    yield from out()
                    held, weight = [], 0
                if (hub, part) != unit:
                    unit, pivot = (hub, part), s  # a hub comes before its members
                else:
                    held.append((node, s))
                    weight += len(s)
        yield from out()

    part = F.pmod(F.xxhash64("node"), F.lit(units)).cast("int").alias("part")
    members = ties.select("hub", part, F.lit(1).alias("role"), "node")
    rows = members.unionByName(members.select("hub", "part").distinct().select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("node")))
    rows = spread(rows, texts.select("node", "text"), "node", "hub", "part").select("hub", "part", "role", "node", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, "a bigint, b bigint")


def exact_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the units of ``members``: unit columns cluster, i, j; side, label, node, sign, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def links():
            if len(rows) > 1:
                nodes, sides, labels, signs, sets = zip(*rows)
                if found := unit_links(list(nodes), np.array([x == unit[1] for x in sides]), labels, signs, sets, unit[1] != unit[2], percent):
                    yield _edges(found)

        for batch in batches:
            for row in range(batch.num_rows):
                cluster, i, j, side, label, node, sign, text = (batch.column(c)[row].as_py() for c in range(8))
                if (cluster, i, j) != unit:
                    yield from links()
                    unit, rows = (cluster, i, j), []
                rows.append((node, side, label, sign, shingles(text, size)))
        yield from links()

    dealt = members.select("cluster", "i", "j", "side", "label", "node", "sign", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def units_of(members: DataFrame) -> DataFrame:
    """members (node, label, cluster, n_shingles) with each unit (i, j) that they belong to; side: their own block. Blocks are written as
    label/number for a large label and as -/number for all others; two blocks of one label make no unit."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("w") / WEIGHT)).cast("int")
    labels = members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).withColumn("large", (F.col("n") > BLOCK) | (F.col("w") > WEIGHT))
    own = labels.groupBy("cluster", "large", F.when(F.col("large"), F.col("label")).alias("label")).agg(blocks.alias("blocks"))
    plan = own.groupBy("cluster").agg(F.collect_list(F.struct(F.coalesce(F.col("label").cast("string"), F.lit("-")).alias("label"), "blocks")).alias("plan"))  # under one entry for a block
    rows = spread(members, plan, "cluster", "node")
    group = F.element_at(F.filter("plan", lambda p: p["label"].isin("-", F.col("label").cast("string")) & ((p["label"] != "-") | ~F.exists("plan", lambda q: q["label"] == F.col("label").cast("string")))), 1)
    rows = rows.withColumn("group", group)
    rows = rows.withColumn("side", F.concat_ws("/", "group.label", F.pmod(F.xxhash64("node"), F.col("group.blocks")).cast("string")))
    every = F.flatten(F.transform("plan", lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda i: F.struct(p["label"].alias("label"), F.concat_ws("/", p["label"], i.cast("string")).alias("block")))))
    other = F.explode(F.filter(every, lambda p: (p["label"] != F.col("group.label")) | (p["label"] == "-"))).alias("other")
    rows = rows.select("node", "label", "cluster", "side", other)
    return rows.select("node", "label", "cluster", "side", F.least("side", "other.block").alias("i"), F.greatest("side", "other.block").alias("j"))


def unsettled_units(rest: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """The units of the buckets in ``rest`` (node, label, hub): buckets that share a document are one cluster."""
    clusters = connected_components(rest.select("node", "hub"), "node", "hub")
    members = rest.select("node", "label").distinct().join(clusters, "node", "left").select("node", "label", F.coalesce("component", "node").alias("cluster"))
    placed = units_of(members.join(facts.select("node", "n_shingles"), "node"))
    return placed.join(facts.select("node", "sign"), "node").join(texts.hint("merge"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    known = materialize(sketch(docs, id_col, text_col, size, percent), "sketches")
    with scope():
        named = materialize(components(docs, known, id_col, text_col, percent, size), "components", outer=True)
    rows = known.select("doc_id", "n_shingles", "digest", salt_of("doc_id").alias("salt"))
    out = rows.join(named.withColumn("salt", each_salt(F.col("met"))), ["digest", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """(digest, component, met) of each distinct set; met: the salts of its rows."""
    one = [F.first(c).alias(c) for c in ("bands", "sign", "n_shingles")]
    reps = known.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), salts_met(salt_of("doc_id")).alias("met"), *one)
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    # buckets of two and more, each member beside the hub
    banded = reps.select("node", F.explode("bands").alias("band"), salt_of("node").alias("salt"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n"), salts_met(F.col("salt")).alias("met")).where("n > 1")
    bucketed = materialize(banded.join(hubs.select("band", "hub", each_salt(F.col("met")).alias("salt")), ["band", "salt"]), "buckets")
    ties = materialize(bucketed.where("node != hub").select("node", "hub").distinct(), "ties")
    tied = ties.select("node").unionByName(ties.select(F.col("hub").alias("node"))).distinct()
    facts = materialize(reps.select("node", "rep", "sign", "n_shingles").join(tied, "node"), "tied")
    # one text for each node: of the rows with the id and the text that its set came from
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    texts = rows.join(facts.select("node", "rep.doc_id", "rep.mark").hint("merge"), ["doc_id", "mark"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(texts, "texts")
    # ties with the hub
    ends = spread(ties.join(facts.select("node", "sign", "n_shingles"), "node"), facts.select(F.col("node").alias("hub"), F.col("sign").alias("hub_sign"), F.col("n_shingles").alias("hub_n")), "hub", "node")
    near = materialize(ends.where(similar(percent)("sign", "hub_sign", "n_shingles", "hub_n")).select("node", "hub"), "near")
    groups = connected_components(hub_links(near, texts, size, percent))
    # buckets whose members lie in several groups
    held = bucketed.join(groups, "node", "left").select("node", "band", "salt", "hub", F.coalesce("component", "node").alias("label"))
    several = held.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), salts_met(F.col("salt")).alias("met")).where("lo != hi")
    rest = materialize(held.join(several.select("band", each_salt(F.col("met")).alias("salt")), ["band", "salt"]).select("node", "label", "hub").distinct(), "unsettled")
    whole = groups
    if not rest.isEmpty():
        links = materialize(exact_links(unsettled_units(rest, facts, texts), size, percent), "links")
        if not links.isEmpty():
            whole = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    # a component's name is the least id of its sets
    whole = whole.unionByName(whole.select(F.col("component").alias("node"), "component").distinct()).join(facts.select("node", "rep"), "node")
    salted = whole.select("node", "component", "rep.doc_id", salt_of("node").alias("salt"))
    names = salted.groupBy("component").agg(F.min("doc_id").alias("name"), salts_met(F.col("salt")).alias("met"))
    labelled = salted.join(names.select("component", "name", each_salt(F.col("met")).alias("salt")), ["component", "salt"]).select("node", "name")
    return reps.select("digest", "node", "rep", "met").join(labelled, "node", "left").select("digest", "met", F.coalesce("name", "rep.doc_id").alias("component"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

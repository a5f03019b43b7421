"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import op3_suffix_dedup, op5_exact_dedup, op6_minhash
from veilspark.llm.components import connected_components
from veilspark.llm.suffixes import COVER, SHIFT, V, cover_ranks, repeated

from .conftest import CLASHES, prose, rows


def by_row(found):
    return sorted((tuple(r) for r in found), key=repr)


def test_op5(spark, docs, empty, table_dir):
    got = op5_exact_dedup.op5_exact_dedup(spark, table_dir(documents=docs)).collect()
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    want = []
    for r in rows():
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert by_row(got) == sorted(want, key=repr)
    assert op5_exact_dedup.op5_exact_dedup(spark, table_dir(documents=empty)).count() == 0


def test_op5_is_native(spark, docs, table_dir):
    plan = op5_exact_dedup.op5_exact_dedup(spark, table_dir(documents=docs))._jdf.queryExecution().toString()
    assert "Aggregate" in plan and not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_keep_one_gives_the_rows_that_stay(spark, docs, empty):
    got = op5_exact_dedup.keep_one(docs)
    assert got.columns == docs.columns and op5_exact_dedup.keep_one(empty).count() == 0
    last = {}
    for r in rows():
        if (r[1] or "") not in last or (r[0] if r[0] is not None else -1) > last[r[1] or ""]:
            last[r[1] or ""] = r[0] if r[0] is not None else -1
    found = {r["text"] or "": r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()}
    assert found == last and got.count() == len(last)


def brute_near(table):
    az = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(az))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_op6(spark, docs, empty, table_dir):
    got = op6_minhash.op6_minhash(spark, table_dir(documents=docs)).collect()
    want = brute_near([(r[0], r[1]) for r in rows() if r[0] is not None])
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert tuple(r)[1:] == want[r["doc_id"]]
    assert op6_minhash.op6_minhash(spark, table_dir(documents=empty)).count() == 0


def near_cluster(n, seed=0):
    r, base = random.Random(seed), prose(50, 150).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1500, 20])
def test_op6_chains_in_a_large_cluster(spark, monkeypatch, block):
    """Members that link with some of the cluster only; small blocks force units of two sides."""
    monkeypatch.setattr(op6_minhash, "BLOCK", block)
    table = near_cluster(150)
    got = op6_minhash.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_near(table)


def test_op6_very_long_texts_make_blocks_by_weight(spark, monkeypatch):
    monkeypatch.setattr(op6_minhash, "WEIGHT", 2000)
    table = near_cluster(60, 3)
    got = op6_minhash.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_near(table)


def test_op6_repeated_ids(spark):
    """One id 2000 times with one text, and one id with two texts: what each of them links to is named by that id, and by nothing else."""
    a, b, c = prose(60, 100), prose(61, 100), prose(62, 100)
    table = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, c + " more"), (8, c), *[(7, c)] * 2000, (7, prose(63, 100)), (5, a)]
    got = op6_minhash.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3))
    want = Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (9, 7, False): 1, (8, 7, False): 1, (7, 7, True): 2001, (5, 1, False): 1})
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()) == want
    facts = spark.createDataFrame([(1, 5, 1, 10), (2, 5, 1, 10), (3, 6, 1, 10), (4, 6, 1, 10)], "node bigint, label bigint, cluster bigint, n_shingles bigint")
    assert op6_minhash.units_of(facts).count() == 4  # small groups share one block


def test_op6_blocks_of_one_large_group_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(op6_minhash, "BLOCK", 10)
    members = spark.createDataFrame([(i, 0 if i < 100 else i, 0, 5) for i in range(104)], "node bigint, label bigint, cluster bigint, n_shingles bigint")
    units = op6_minhash.units_of(members).collect()
    pairs = {(u["i"], u["j"]) for u in units}
    assert len(pairs) == 11 and all("-/0" in p for p in pairs)  # the four others among themselves and with each of ten blocks
    assert Counter(u["side"] for u in units if u["node"] >= 100) == {"-/0": 44}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(up) if root(x) != x}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_spans(table, length=200):
    count, raw = Counter(), [(d, (t or "").encode()) for d, t in table]
    for _, b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 2])
def test_op3(spark, docs, empty, table_dir, monkeypatch, hot):
    monkeypatch.setattr(op3_suffix_dedup, "HOT", hot)
    folder = table_dir(documents=docs)
    assert by_row(op3_suffix_dedup.op3_suffix_dedup(spark, folder).collect()) == brute_spans([(r[0], r[1]) for r in rows()])
    assert op3_suffix_dedup.op3_suffix_dedup(spark, table_dir(documents=empty)).count() == 0


def test_op3_on_near_copies_and_low_entropy(spark, table_dir):
    r = random.Random(8)
    table = [*near_cluster(60, 1), *((100 + i, "".join(r.choice("ab") for _ in range(r.randrange(600)))) for i in range(30)), (200, "xyz" * 200), (201, "xyz" * 150 + "q"), (202, "é" * 250 + "x" * 250)]
    again = prose(70, 45)
    table += [(210, again + " " + prose(71, 90) + " " + again + " " + prose(72, 30) + " " + again), (211, "Und " * 2000 + prose(73, 60) + " Und" * 500), (212, "Und " * 300)]
    got = op3_suffix_dedup.op3_suffix_dedup(spark, table_dir(documents=spark.createDataFrame(table, "doc_id bigint, text string")))
    assert by_row(got.collect()) == brute_spans(table)


def test_op3_a_passage_in_many_texts_makes_no_large_bucket(spark, table_dir, monkeypatch):
    """The surroundings differ, so that the contexts of the passage's anchors are all distinct."""
    monkeypatch.setattr(op3_suffix_dedup, "HOT", 20)
    passage = prose(81, 60)[:260]
    table = [(i, f"{prose(1000 + i, 12 + i % 30)} {passage} {prose(5000 + i, 12 + i % 25)}") for i in range(300)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    assert by_row(op3_suffix_dedup.op3_suffix_dedup(spark, table_dir(documents=df)).collect()) == brute_spans(table)
    raws = [(r[1].encode(), r[1].encode().index(passage.encode()) + 120) for r in table]  # an anchor inside the passage
    contexts = [(7, at - max(0, at - 152), raw[max(0, at - 152) : at + 200], bytes([i // 256, i % 256]), 1) for i, (raw, at) in enumerate(raws)]
    heavy = spark.createDataFrame(contexts, "bucket bigint, off int, ctx binary, digest binary, n bigint")
    done, cuts = op3_suffix_dedup.parts_of_hot(heavy)
    size = Counter(r["bucket"] for r in done.collect())
    assert len(cuts) > 1 and max(size.values()) <= 20


def test_remove_repeats_keeps_rows_columns_and_characters(spark, docs):
    out = op3_suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows()) and sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows())
    lost = {d: n for d, _, n, _, _ in brute_spans([(r[0], r[1]) for r in rows()])}
    for r in got:
        own = {x[1] for x in rows() if x[0] == r["doc_id"]}
        if r["doc_id"] is not None and r["text"] is not None:
            n = len(next(iter(own)).encode()) - len(r["text"].encode())
            assert lost[r["doc_id"]] - 6 <= n <= lost[r["doc_id"]]


def test_cover_and_suffix_ranks():
    assert sorted((a - b) % V for a in COVER for b in COVER if a != b) == list(range(1, V))
    assert SHIFT.max() < V
    r = np.random.default_rng(1)
    for alphabet, n in ((2, 3000), (1, 700), (50, 2000)):
        text = r.integers(97, 97 + alphabet, n).astype(np.uint8)
        starts = np.sort(r.choice(n - 60, 300, replace=False))
        classes = r.integers(0, 3, 300)
        raw = text.tobytes()
        count = Counter((c, raw[s : s + 60]) for s, c in zip(starts.tolist(), classes.tolist()))
        want = [count[c, raw[s : s + 60]] > 1 for s, c in zip(starts.tolist(), classes.tolist())]
        assert repeated(text, starts, classes, 60).tolist() == want
    assert cover_ranks(np.zeros(0, np.uint64), 0, 10).tolist() == [0] * (10 + 2 * V)


def test_clashing_names_are_covered():
    assert "digest" in CLASHES

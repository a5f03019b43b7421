"""BPE, quality rules, language identification and the quality classifier."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import op1_bpe, op2_quality_rules, op4_language, op8_quality_classifier, op10_packing

from .conftest import prose, rows, texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op1_bpe.vocabulary_path())


def test_bpe_equals_the_library_on_random_text(library):
    bpe, r = op1_bpe.WordBPE(op1_bpe.vocabulary_path()), random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x500), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), 0x1F600, 0x85, 0xA0, 0x2028, 0xFEFF, 0x1C, 0xAC00, 0x1100, 0x1161]]
    for _ in range(3000):
        x = "".join(r.choice(pool) for _ in range(r.randrange(25)))
        assert np.frombuffer(bpe.encode(x), "<i4").tolist() == library.encode(x, add_special_tokens=False).ids, ascii(x)


def test_bpe_equals_the_library_on_every_cased_or_rare_code_point(library):
    """All planes' code points but the large blocks of unified ideographs and syllables, private use and unassigned planes; letters
    whose lower case is newer than this Python are among them."""
    own, packed = op1_bpe.WordBPE(op1_bpe.vocabulary_path()), op10_packing.LibraryBPE(op1_bpe.vocabulary_path())
    assert own.other_case("x\ua7dc") or "\ua7dc".lower() != "\ua7dc"
    chars = list(map(chr, [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x18D00, 0x20000)]))
    for i in range(0, len(chars), 256):
        text = " ".join("a" + c + "b" for c in chars[i : i + 256])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<i4").tolist() == want == np.frombuffer(packed.encode(text), "<i4").tolist(), hex(ord(chars[i]))


def test_bpe_long_words_and_stale_entries(library):
    bpe = op1_bpe.WordBPE(op1_bpe.vocabulary_path())
    for x in ("a" * 4000, "abcabc" * 300, "".join(random.Random(1).choice("thein") for _ in range(3000))):
        assert np.frombuffer(bpe.encode(x), "<i4").tolist() == library.encode(x, add_special_tokens=False).ids


def test_op1(spark, docs, empty, table_dir, library):
    got = sorted((tuple(r) for r in op1_bpe.op1_bpe(spark, table_dir(documents=docs)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert op1_bpe.op1_bpe(spark, table_dir(documents=empty)).count() == 0


def test_bpe_keeps_other_columns(docs):
    out = op1_bpe.encode(docs, op1_bpe.vocabulary_path())
    assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes)["ids"] == "array<int>"
    nulls = docs.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))
    assert op1_bpe.decode(nulls, op1_bpe.vocabulary_path()).first()["decoded"] == ""


def stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_op2(spark, docs, empty, table_dir):
    got = op2_quality_rules.op2_quality_rules(spark, table_dir(documents=docs)).collect()
    want = [(r[0], *stats(r[1])) for r in rows()]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert op2_quality_rules.op2_quality_rules(spark, table_dir(documents=empty)).count() == 0


def test_op2_verdicts_by_brute_force(spark, docs, table_dir):
    """Estimation document by document, in plain loops, instead of on the histogram of votes."""
    folder = table_dir(documents=docs)
    frame = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", op2_quality_rules.stats_column(op2_quality_rules.content()).alias("stats"))
    names = list(op2_quality_rules.rules())
    votes = [(r["doc_id"], r["votes"]) for r in frame.select("doc_id", F.array(*op2_quality_rules.rules().values()).alias("votes")).collect()]
    start, weight = (op2_quality_rules.START_BAD, op2_quality_rules.START_GOOD), op2_quality_rules.WEIGHT
    share, table = 0.85, [[list(start[0]), list(start[1])] for _ in names]

    def good(v):
        yes, no = share, 1 - share
        for t, x in zip(table, v):
            no, yes = no * t[0][x + 1], yes * t[1][x + 1]
        return yes / (yes + no)

    for _ in range(200):
        p = [good(v) for _, v in votes]
        sums = [[[weight * x for x in side] for side in start] for _ in names]
        for q, (_, v) in zip(p, votes):
            for t, x in zip(sums, v):
                t[0][x + 1] += 1 - q
                t[1][x + 1] += q
        before, share = share, (17 + sum(p)) / (20 + len(votes))
        table = [[[x / sum(side) for x in side] for side in t] for t in sums]
        if abs(share - before) < 1e-9:
            break
    want = sorted(((d, round(good(v), 6)) for d, v in votes), key=repr)
    got = op2_quality_rules.op2_quality_rules(spark, folder).collect()
    assert sorted(((r["doc_id"], round(r["posterior"], 6)) for r in got), key=repr) == want


def test_label_model_finds_good_and_bad_rules():
    r, names = random.Random(3), ["sharp", "weak", "noise"]
    count, truth = Counter(), Counter()
    for _ in range(20000):
        good = r.random() < 0.8
        votes = (0 if good or r.random() < 0.3 else -1, (1 if r.random() < 0.9 else 0) if good else (-1 if r.random() < 0.6 else 1), r.choice((-1, 0, 1)))
        count[votes] += 1
        truth[votes] += good
    model = op2_quality_rules.fit(sorted(count.items()), names)
    assert abs(model.good - 0.8) < 0.06
    right = sum(truth[v] if model.posterior(v) >= 0.5 else n - truth[v] for v, n in count.items())
    assert right / 20000 > 0.93
    one = op2_quality_rules.fit([], names)
    assert 0 < one.good < 1 and one.posterior((0, 0, 0)) > 0.5


def test_keep_good_drops_junk_and_keeps_prose(spark, docs):
    out = op2_quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    kept = {r["text"] for r in out.collect()}
    assert texts()[7] in kept and not any(t in kept for t in ("", "one", "### $$$ %%% &&& " * 30, "word " * 400))


def language_rows():
    r, out = random.Random(9), []
    parts = {"aa": "lor men tik ros vel dan".split(), "bb": "schu gerz blum acht pfel".split(), "cc": "ção ñor éla íqu que".split()}
    for i in range(300):
        lang = list(parts)[i % 3]
        out.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randrange(3, 40))), lang if i % 10 else None))
    return [*out, (None, "lormen", "aa"), (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (3, out[3][1], out[3][2])]


def test_op4(spark, empty, table_dir):
    df = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string")
    got = op4_language.op4_language(spark, table_dir(documents=df)).collect()
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(300)}
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["rejected"]
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert len(got) == len(language_rows())
    assert op4_language.op4_language(spark, table_dir(documents=empty)).count() == 0


def test_op4_by_brute_force(spark, table_dir):
    """Frequencies, vectors and cosines in plain loops over all rows; extra columns, ties and a very long text."""
    table = [(*r, "x", 1) for r in [*language_rows(), (950, "lormen tik " * 30000, "aa"), (951, language_rows()[0][1], "bb")]]
    df = spark.createDataFrame(table, "doc_id bigint, text string, lang string, h string, nth int").repartition(3)
    train = {}
    for d, t, lang, *_ in table:
        if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5:
            train.setdefault((lang, d), []).append(t)
    texts = [t for ts in train.values() for t in ts]
    seen = [g for t in texts if (g := op4_language.grams(t)) is not None]
    idf = [np.log((1 + len(seen)) / (1 + sum(g[i] > 0 for g in seen))) + 0.05 for i in range(op4_language.DIM)]
    model = op4_language.fit(df.where(op4_language.crc_fold() != 0))
    assert np.allclose(model.idf, idf, atol=1e-6) and model.langs == ["aa", "bb", "cc"]
    for r in op4_language.op4_language(spark, table_dir(documents=df)).collect():
        text = next(t for d, t, *_ in table if d == r["doc_id"])
        g = op4_language.grams(text) if text else None
        if g is None:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        x = {i: float(np.log1p(n)) * idf[i] for i, n in enumerate(g.tolist()) if n}
        size = sum(v * v for v in x.values()) ** 0.5
        near = [sum(float(c[i]) * v for i, v in x.items()) / size for c in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        assert r["lang_pred"] == model.langs[model.owner[best]] and abs(r["distance"] - 1 + near[best]) < 1e-4
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_op4_sample_is_that_of_least_hash(spark, monkeypatch):
    monkeypatch.setattr(op4_language, "SAMPLE", 7)
    df = spark.range(3000).selectExpr("id % 1500 AS doc_id", "if(id % 3 = 0, 'a', 'b') AS lang", "'x' AS text").repartition(5)
    want = {lang: [r[0] for r in df.where(F.col("lang") == lang).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(7).collect()] for lang in "ab"}
    got = op4_language.sampled(df).collect()
    assert {lang: sorted(r["doc_id"] for r in got if r["lang"] == lang) for lang in "ab"} == {k: sorted(v) for k, v in want.items()}


def test_op4_rejects_what_is_far(spark):
    df = spark.createDataFrame([r for r in language_rows() if r[2]], "doc_id bigint, text string, lang string")
    model = op4_language.fit(df)
    assert model.predict("xqwz xqzw zzqx wqxz " * 5)[3] and not model.predict("lormentik rosveldan tikrosmen lordantik velmenros")[3]


def test_op4_without_training_rows(spark, table_dir):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id bigint, text string, lang string")
    assert op4_language.op4_language(spark, table_dir(documents=df)).first()["lang_pred"] == "und"


def test_op4_knows_every_language(spark):
    word = lambda i: "".join(chr(0x4E00 + 5 * i + j) for j in (0, 2, 1, 4, 3))
    table = [(2 * i + j, " ".join([word(i)] * 6), f"l{i:03}") for i in range(130) for j in range(1 + (i < 100))]
    model = op4_language.fit(spark.createDataFrame(table, "doc_id bigint, text string, lang string"))
    assert model.langs == [f"l{i:03}" for i in range(130)]
    assert [model.predict(word(i) + " " + word(i))[0] for i in range(130)] == model.langs


def test_op4_fits_and_predicts_with_one_vector(spark):
    """The only training text is its language's centroid, also where an n-gram occurs over 65,535 times."""
    text = "a" * 3_000_000 + " " + prose(9, 300)
    model = op4_language.fit(spark.createDataFrame([(1, text, "aa")], "doc_id bigint, text string, lang string"))
    assert model.predict(text)[2] < 1e-5


def quality_rows():
    good = [(i, prose(i, 60 + i % 50)) for i in range(400) if i % 4]
    return [*good, *((i, " ".join(w + r"$$$" for w in prose(i, 50).split())) for i in range(0, 400, 4)), (1000, None), (1001, ""), (None, "x"), (1, good[0][1])]


def test_op8(spark, empty, table_dir):
    docs = spark.createDataFrame(quality_rows(), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = op8_quality_classifier.op8_quality_classifier(spark, table_dir(documents=docs, labels=labels)).collect()
    assert len(got) == len(quality_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) >= 0.97
    none = op8_quality_classifier.op8_quality_classifier(spark, table_dir(documents=docs.limit(3), labels=labels.limit(0))).collect()
    assert all(0.2 < r["score"] < 0.8 for r in none)
    assert op8_quality_classifier.op8_quality_classifier(spark, table_dir(documents=empty, labels=labels)).count() == 0


def test_op8_by_brute_force(spark, table_dir):
    """The rows to learn from picked in plain loops, and each score as the double sum over pairs of inputs; extra columns, a repeated id
    with other texts, and a very long text."""
    table = [(d, t, "x", 5) for d, t in [*quality_rows(), (2, "another text of an id that there is"), (1002, prose(4, 30000))]]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, label string, places int").repartition(3)
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 5)] + [(1, 1, 1), (1, 0, 0), (2, 0, 0)]
    marked, text = {}, {}
    for i, q, _ in labels:
        marked[i] = max(q, marked.get(i, 0))
    for d, t, *_ in table:
        if d in marked and zlib.crc32(str(d).encode()) % 5:
            text[d] = min(t or "", text.get(d, t or ""))
    rows_ = [(*op8_quality_classifier.inputs(t), marked[d]) for d, t in text.items()]
    m = op8_quality_classifier.fit_rows(sorted(rows_, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())))
    folder = table_dir(documents=docs, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    short = {}
    for d, t, *_ in table:
        if d != 1002:
            at, x = op8_quality_classifier.inputs(t or "")
            v = m.factors[at].astype(float) * x[:, None]
            short.setdefault(d, set()).add(round(1 / (1 + float(np.exp(-(m.bias + m.weight[at] @ x + np.triu(v @ v.T, 1).sum())))), 3))
    for r in op8_quality_classifier.op8_quality_classifier(spark, folder).collect():
        assert r["doc_id"] == 1002 or any(abs(r["score"] - y) < 2e-3 for y in short[r["doc_id"]])
    few = op8_quality_classifier.fit(docs.unionByName(docs.where("doc_id = 1")).where("doc_id IS NOT NULL"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"), rows=2)
    assert few.factors.shape[0] == op8_quality_classifier.DIM


def test_factorisation_machine_uses_pairs_and_the_identity():
    r, data = np.random.default_rng(2), []
    for _ in range(1500):
        a, b = r.integers(0, 2, 2)
        data.append((np.array([a, 10 + b]), np.array([1.0, 1.0], np.float32), int(a ^ b)))
    m = op8_quality_classifier.fit_rows(data, rounds=60)
    z = lambda a, b: m.bias + m.weight[a] + m.weight[10 + b] + m.factors[a] @ m.factors[10 + b]
    assert all((z(a, b) > 0) == bool(a ^ b) for a in (0, 1) for b in (0, 1))
    text = prose(3, 50)
    at, x = op8_quality_classifier.inputs(text)
    slow = m.bias + float(m.weight[at] @ x) + sum(float(m.factors[i] @ m.factors[j]) * x[p] * x[q] for p, i in enumerate(at) for q, j in enumerate(at) if p < q)
    assert abs(m.score(text) - 1 / (1 + np.exp(-slow))) < 1e-4

"""WARC, URL rules, packing and the pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from veilspark.llm import op1_bpe, op2_quality_rules, op6_minhash, op7_warc, op9_url_filters, op10_packing
from veilspark.llm.common import workspace

from .conftest import prose, rows
from .test_dedup_operators import brute_near, brute_spans
from .test_text_operators import stats


def page_rows():
    html = [f"<html>{prose(i, 50)}</html>" for i in range(40)]
    urls = ["http://a.example.com/en/x?y", None, "no scheme", "HTTPS://WWW.Example.COM/EN/", "http://www.example.com/en/q", "ftp://example.com", "http://example.com/en/", "http://xexample.com/en/", "http://b.net/es/1#f", "http://net/fr/", "http://b.net/esx", "://", "http://com/", "http://com", "http://h\r\nX: y/%0A", "http://a..com/", "http://é.com/ü"]
    out = [(i, urls[i % len(urls)], html[i]) for i in range(40)]
    return [*out, (50, "u", html[3]), (51, None, html[3]), (52, "u", None), (53, "u", ""), (None, "u", html[5]), (None, None, None), (3, urls[3], html[3])]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1, None) for r in page_rows()], "page_id bigint, url string, html string, sha string, shard int, first string").repartition(3)


def test_op7(spark, pages, table_dir):
    got = sorted((tuple(r) for r in op7_warc.op7_warc(spark, table_dir(pages=pages)).collect()), key=repr)
    first = {}
    for p, _, h in page_rows():
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in page_rows():
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and p != to
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want, key=repr)
    assert op7_warc.op7_warc(spark, table_dir(pages=pages.limit(0))).count() == 0


def test_warc_round_trip_keeps_urls_and_payloads(spark, pages):
    found = op7_warc.read(op7_warc.write(pages, workspace(spark, "t"))).where("record_type = 'response'").collect()
    for r in found:
        assert any(r["url"] == u and bytes(r["payload"]).decode() == (h or "") for p, u, h in page_rows() if p == r["page_id"])


def test_warc_splits_archives_and_takes_very_long_payloads(spark, pages):
    long = "<p>" + prose(8, 200_000)
    table = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame([(90, "u", long), (91, "v", long), (92, None, long + "x")], "page_id bigint, url string, html string"))
    manifest = op7_warc.write(table.coalesce(1), workspace(spark, "t"), size_limit=4000)
    assert manifest.count() > 5
    found = op7_warc.read(manifest).collect()
    assert len(found) == table.count()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found}
    size = len(long.encode())
    assert kinds[90] == ("response", None, size) and kinds[91] == ("revisit", 90, size) and kinds[92] == ("response", None, size + 1)


def test_hot_keys_meet_their_verdicts_by_salt(spark, pages):
    """Both sides of the write-back joins have an exchange of their own by key and salt."""
    from veilspark.llm import op5_exact_dedup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', cast(id AS string)) AS text")
        out = op5_exact_dedup.exact_dedup(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"hashpartitioning\(digest#\d+, salt#\d+", plan)) >= 2 and "SortMergeJoin [digest" in plan
        assert len(set(r["salt"] for r in op5_exact_dedup.keyed(df).where("content = 'hot'").select("salt").distinct().collect())) == 32
        assert out.where("group_size = 2000 AND keep_id = 3998").count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_warc_frames_stand_alone():
    records = [op7_warc.record(i, "u", prose(i, 80).encode(), op7_warc.digest(prose(i, 80).encode()), None) for i in range(300)]
    data = op7_warc.archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and list(op7_warc.frames(data)) == records
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)
    assert list(op7_warc.frames(op7_warc.archive(records[:1]))) == records[:1]


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), -i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[3], max(fits)[4]) if fits else (None, "allow")))


@pytest.mark.parametrize("rules", [op9_url_filters.RULES, [], [("block", "example.com", "/"), ("allow", "a.example.com", "/en"), ("block", "example.com", "/en/x"), ("block", "com", "/"), ("allow", "com", "/"), ("allow", "net", "/es/"), ("block", "b.net", "/es/1")]])
def test_op9(spark, pages, rules):
    got = sorted((tuple(r) for r in op9_url_filters.judge(pages, rules).collect()), key=repr)
    assert got == sorted(((p, *verdict(u, rules)) for p, u, _ in page_rows()), key=repr)
    assert op9_url_filters.judge(pages.limit(0), rules).count() == 0


def test_op9_is_native(spark, pages, table_dir):
    plan = op9_url_filters.op9_url_filters(spark, table_dir(pages=pages))._jdf.queryExecution().toString()
    assert "Window" in plan and not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_op9_keys_survive_any_character(spark):
    rules = [("block", "com", "/"), ("allow", "x", "/abcdef"), ("block", "q.net", "/\t"), ("allow", "", "/e")]
    urls = ["http://q.net/\tcom.evil", "http://q.net/\t", "http://a\tb.com/", "http://x/abcdef\t", "http://com./e", "http://" + "a." * 3000 + "com/", "http://c\u0000om/", "http://.com/"]
    table = [(i, u, None) for i, u in enumerate(urls)]
    got = op9_url_filters.judge(spark.createDataFrame(table, "page_id bigint, url string, html string"), rules).collect()
    assert {x["page_id"]: tuple(x)[1:] for x in got} == {i: verdict(u, rules) for i, u, _ in table}


def test_op9_nested_rules_at_random(spark):
    r = random.Random(2)
    hosts = [".".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(300)]
    rules = [(r.choice(["allow", "block"]), h, r.choice(["/", "/x", "/x/y", "/z"])) for h in hosts[:60]]
    table = [(i, f"http://{h}{r.choice(['', '/', '/x', '/x/y/z', '/zz'])}", None) for i, h in enumerate(hosts)]
    got = op9_url_filters.judge(spark.createDataFrame(table, "page_id bigint, url string, html string"), rules).collect()
    assert {x["page_id"]: tuple(x)[1:] for x in got} == {i: verdict(u, rules) for i, u, _ in table}


def check_packing(got, table, capacity=2048):
    library = Tokenizer.from_file(op1_bpe.vocabulary_path())
    sequences, want, have = defaultdict(list), [], []
    for d, t in table:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((d, piece, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    for r in got:
        have.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(x[3] for x in want) // capacity)


def test_op10(spark, docs, empty, table_dir):
    got = op10_packing.op10_packing(spark, table_dir(documents=docs)).collect()
    used, least = check_packing(got, [(r[0], r[1]) for r in rows()])
    assert used <= least + 1
    assert op10_packing.op10_packing(spark, table_dir(documents=empty)).count() == 0


def test_plan_uses_every_piece_once_and_few_sequences():
    r = random.Random(6)
    for histogram in ({i: r.randrange(300) for i in range(1, 2049)}, {700: 33333, 1300: 20, 5: 7}, {2048: 9}, {}, {3: 100000}, {int(r.lognormvariate(6, 0.8)) % 2048 + 1: r.randrange(1, 9) for _ in range(4000)}):
        groups = op10_packing.plan(histogram)
        used = defaultdict(int)
        for slots, n in groups:
            assert sum(length * t for length, t in slots) <= 2048
            for length, t in slots:
                used[length] += t * n
        assert dict(used) == {k: v for k, v in histogram.items() if v}
        most_halves = sum(v for k, v in histogram.items() if k > 1024)
        least = max(-(-sum(k * v for k, v in histogram.items()) // 2048), most_halves)
        if 700 not in histogram:
            assert sum(n for _, n in groups) <= 1.02 * least + 2


def test_nnls_solves_and_stays_non_negative():
    import numpy as np

    r = np.random.default_rng(4)
    a, x = r.random((30, 60)), np.zeros(60)
    x[:8] = r.random(8)
    found = op10_packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6
    assert op10_packing.nnls(a, np.zeros(30)).tolist() == [0] * 60


def test_pipeline_against_brute_force(spark, docs, table_dir):
    """Each stage on its own input, and the whole by ``run``."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    table = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    folder = table_dir(documents=table)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == now.columns, name
        if name == "quality_rules":
            good = {r["doc_id"] for r in op2_quality_rules.op2_quality_rules(spark, folder).where("kept").collect()}
            want = {d: t for d, t in want.items() if d in good}
            assert all(stats(t)[0] >= 10 for t in want.values())
        elif name == "exact_dedup":
            last = {}
            for d, t in want.items():
                last[t] = max(d, last.get(t, d))
            want = {d: t for t, d in last.items()}
        elif name == "minhash_near_dedup":
            keep = brute_near(sorted(want.items()))
            want = {d: t for d, t in want.items() if keep[d][2]}
        rows_ = out.collect()
        if name == "suffix_array_dedup":
            lost = {d: n for d, _, n, _, _ in brute_spans(sorted(want.items()))}
            got = {r["doc_id"]: r["text"] for r in rows_}
            assert got.keys() == want.keys() and any(lost.values())
            for d, t in got.items():
                assert lost[d] - 6 <= len(want[d].encode()) - len(t.encode()) <= lost[d]
            assert all(r["n_chars"] == len(r["text"]) for r in rows_)
            want = got
        assert {r["doc_id"]: r["text"] for r in rows_} == want, name
        now = spark.createDataFrame(rows_, now.schema)
    used, least = check_packing(corpus_pipeline.run(spark, folder).collect(), sorted(want.items()))
    assert used <= least + 1


def test_pipeline_with_null_and_repeated_ids(spark, docs, table_dir):
    """The rows as they are: what the quality rules keep, one row of each text, a null id as the least."""
    folder = table_dir(documents=docs)
    now = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    kept = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert any(d is None for d, _ in kept) or len(kept) < len(rows())
    now = spark.createDataFrame(now.collect(), now.schema)
    once = corpus_pipeline.exact_duplicates(spark, now, folder).collect()
    last = {}
    for d, t in kept:
        last[t] = max(-1 if d is None else d, last.get(t, -1))
    assert {r["text"]: -1 if r["doc_id"] is None else r["doc_id"] for r in once} == last
    left = corpus_pipeline.near_duplicate_groups(spark, spark.createDataFrame(once, now.schema), folder).collect()
    assert {r["doc_id"] for r in once if r["doc_id"] is None} == {r["doc_id"] for r in left if r["doc_id"] is None}
    assert corpus_pipeline.run(spark, folder).count() >= len(left)


def test_pipeline_on_an_empty_table(spark, empty, table_dir):
    assert corpus_pipeline.run(spark, table_dir(documents=empty)).count() == 0


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    """200 words are 196 shingles, of which a changed word takes 5: 4 changes leave 176 of 216 (0.815), 5 leave 171 of 221 (0.774)."""
    own = lambda group, changes: " ".join(f"x{changes}" if i % 20 == 10 and i < 20 * changes else f"{group}{i}" for i in range(200))
    now = spark.createDataFrame([(1, own("a", 0)), (2, own("a", 4)), (3, own("b", 0)), (4, own("b", 5))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, now, "").collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in op6_minhash.near_duplicates(now).where("kept").collect()} == {1, 2, 3, 4}  # the query's own bound stays


def test_bands_follow_the_similarity():
    assert op6_minhash.bands(85) == 44 and op6_minhash.bands(80) == 76 and op6_minhash.bands(100) * op6_minhash.ROWS == op6_minhash.SIGNATURE
    assert all((1 - (p / 100) ** op6_minhash.ROWS) ** op6_minhash.bands(p) < 1e-6 for p in range(50, 101))
    assert len(op6_minhash.minima(op6_minhash.shingles("a b c d e f"), 608)) == 608

"""The anonymizer's parts against independent models."""

import math
import os
import pickle
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.config import AnonymizerConfig, sweep
from veilspark.functions import noise as N
from veilspark.functions import scalar as S
from veilspark.operators import agreement, aggregates, drift, metrics, neighbours, ordering, report, smoothing
from veilspark.plans.catalog import EVENTS, MIXED, ORACLES, PRIORITIES, QUERIES
from veilspark.plans.single_cluster import single_cluster
from veilspark.schema import NOMINAL, ORDINAL, Attribute, StreamSchema
from veilspark.sources import readers, writers
from veilspark.streaming import kernel as kernel_module
from veilspark.streaming.batch import anonymize
from veilspark.streaming.buffered import nearest_groups
from veilspark.streaming.detectors import Adwin, PageHinkley
from veilspark.streaming.draws import uniforms
from veilspark.streaming.kernel import Anonymizer, Group, listed
from veilspark.streaming.learners import LEARNERS, NaiveBayes, Prequential
from veilspark.streaming.nearest import Places, matcher

X = Attribute("x", lo=0.0, hi=100.0)
C = Attribute("c", NOMINAL, values=("u", "v", "w"))
SCHEMA = StreamSchema("seq", (X,), Attribute("s", NOMINAL, values=("a", "b", "c")))
BOTH = StreamSchema("seq", (X, C), SCHEMA.sensitive)


def stream(n, seed=1, spread=100.0):
    r = random.Random(seed)
    return [(i + 1, round(r.random() * spread, 3), r.choice("uvw"), r.choice("aabbc")) for i in range(n)]


def step_model(rows, k, l, c, threshold, delta=None):  # noqa: E741
    """A slow restatement of the grouping rules for one numeric and one nominal column."""
    groups, out, opened = [], [], 0

    def verdict(g):
        n = sorted(Counter(r[3] for r in g["all"]).values(), reverse=True)
        return 1 if len(g["all"]) < k else 0 if len(n) >= l and n[0] < c * sum(n[l - 1 :]) else 2

    def emit(g, time):
        for r in reversed(g["wait"]):
            out.append((r[0], time, len(out) + 1, g["id"], verdict(g)))
        g["wait"] = []

    def centre(g):
        xs = [r[1] for r in g["all"]]
        n = Counter(r[2] for r in g["all"])
        return (xs[0] if len(xs) == 1 else (xs[0] + sum(xs)) / (len(xs) + 1)), min(n, key=lambda v: (-n[v], v))

    for r in rows:
        for g in [g for g in groups if delta and g["wait"] and r[0] - g["wait"][0][0] >= delta]:
            groups.remove(g)
            emit(g, r[0])
        near = []
        for g in groups:
            x, v = centre(g)
            if (abs(r[1] - x) / 100 + (r[2] != v)) / 2 <= threshold:
                near.append((math.sqrt((r[1] - x) ** 2 + (r[2] != v)), g["id"], g))
        if not near:
            groups.append({"id": opened, "all": [r], "wait": [r]})
            opened += 1
            continue
        g = min(near, key=lambda t: t[:2])[2]
        g["all"].append(r)
        g["wait"].append(r)
        if len(g["all"]) >= k:
            emit(g, r[0])
        if len(g["all"]) >= 4 * k:
            groups.remove(g)
    for g in groups:
        emit(g, rows[-1][0])
    return out


@pytest.mark.parametrize(("k", "l", "c", "threshold", "delta"), [(5, 2, 3.0, 0.1, None), (4, 3, 2.0, 0.3, 40), (7, 2, 1.1, 1.0, None)])
def test_kernel_against_a_step_model(k, l, c, threshold, delta):  # noqa: E741
    rows = stream(600)
    kernel = Anonymizer(BOTH, AnonymizerConfig(k=k, l=l, c=c, threshold=threshold, delta=delta))
    got = [x[:5] for r in rows for x in kernel.step(r[0], (r[1], r[2]), r[3])] + [x[:5] for x in kernel.flush()]
    assert got == step_model(rows, k, l, c, threshold, delta)


def test_kernel_equals_the_closed_form(spark):
    rows = [(r[0], r[1], r[3]) for r in stream(700)]
    cfg = AnonymizerConfig(k=12, l=3, c=2.0, threshold=2.0)
    df = spark.createDataFrame(rows, "seq bigint, x double, s string")
    want = {r["seq"]: (r["pub_seq"], r["publish_time"], r["status"], r["cluster"], round(r["anon_x"], 3)) for r in single_cluster(df, SCHEMA, cfg).collect()}
    got = anonymize(df.withColumn("shard", F.lit("one")), SCHEMA, cfg, "shard").collect()
    assert len(got) == 700 and {r["status"] for r in got} == {0, 2}
    for r in got:
        *facts, shown = want[r["seq"]]
        assert [r["pub_seq"], r["publish_time"], r["status"], r["cluster"]] == facts and abs(r["anon_x"] - shown) < 2e-3


def test_published_groups_keep_their_guarantees(spark):
    rows = stream(2000, 3)
    cfg = AnonymizerConfig(k=10, l=2, c=3.0, threshold=0.2, noise="laplace", eps=1.0, suppress="kernel", drift="centroid")
    df = spark.createDataFrame(rows, "seq bigint, x double, c string, s string").withColumn("shard", F.pmod("seq", F.lit(3)))
    got = anonymize(df, BOTH, cfg, "shard").collect()
    again = anonymize(df.repartition(7), BOTH, cfg, "shard").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(r["seq"] for r in got) == [r[0] for r in rows]
    assert all(0 <= r["anon_x"] <= 100 and r["anon_c"] in "uvw" for r in got)
    size = Counter((r["shard"], r["cluster"]) for r in got)
    assert max(size.values()) <= 40
    assert all(size[r["shard"], r["cluster"]] >= 10 for r in got if r["status"] == 0)


def test_gap_and_late_rows():
    kernel = Anonymizer(SCHEMA, AnonymizerConfig(k=3, delta=10, gap=True, threshold=2.0, noise="one_sided", sensitivity="observed", suppress="uniform"))
    assert kernel.step(1, (5.0,), "a") == [] and kernel.step(2, (6.0,), "a") == []
    assert [x[4] for x in kernel.step(30, (5.0,), "b")] == [1, 1]
    assert kernel.step(4, (5.0,), "b")[0][4] == 3 and kernel.opened == 2


def test_randomized_publisher_counts_all_as_published():
    kernel = Anonymizer(BOTH, AnonymizerConfig(k=4, threshold=0.5, publisher="random"))
    got = [x for r in stream(50) for x in kernel.step(r[0], (r[1], r[2]), r[3])] + kernel.flush()
    assert len(got) == 50 and {x[4] for x in got} == {0} and len({x[5][0] for x in got}) == 50


def orders_of(regions, each, seed=2):
    """Records of MIXED whose customers move to another region after every ``each`` records, so that groups stay behind."""
    r = random.Random(seed)
    for i in range(regions * each):
        yield i, (round(r.random() * 5e5, 2), 15000 * (i // each) + r.randrange(15000), r.choice("12345"), r.choice("FOP")), r.choice(PRIORITIES)


@pytest.mark.parametrize("cfg", [AnonymizerConfig(k=5, threshold=0.12, delta=600, gap=True), AnonymizerConfig(k=20, threshold=0.15, delta=20000), AnonymizerConfig(k=20, threshold=0.15, publisher="random"), AnonymizerConfig(k=20, threshold=0.15, delta=2000, gap=True, drift="centroid", noise="one_sided", sensitivity="observed", suppress="uniform")])
def test_a_search_does_not_grow_with_the_open_groups(cfg):
    kernel, looked = Anonymizer(MIXED, cfg), []
    about = kernel.places.about
    kernel.places.about = lambda values: looked.append(len(found := list(about(values)))) or found
    for record in orders_of(20, 150):
        kernel.step(*record)
    assert len(kernel.groups) > 60 and max(looked) < len(kernel.groups) / 3
    by_place = {g.id for held in kernel.places.cells.values() for g in held.values()}
    assert by_place == set(kernel.groups)


@pytest.mark.parametrize("schema", [MIXED, StreamSchema("seq", MIXED.quasi[:2], MIXED.sensitive), StreamSchema("seq", MIXED.quasi[3:], MIXED.sensitive), StreamSchema("seq", MIXED.quasi[2:], MIXED.sensitive)])
@pytest.mark.parametrize("threshold", [0.0, 0.12, 0.4, 3.0, math.inf])
def test_search_equals_the_distances_of_all_groups(schema, threshold):
    r = random.Random(4)

    def place():
        whole = (r.choice([1e3, 2.5e5, 3e5, math.nan, 6e12]), r.choice([0, 1500, 4218.75, 60000, -7, 9e5]) + r.random() * r.choice([0, 4000]), r.choice("12345"), r.choice("FOP"))
        return tuple(v for a, v in zip(MIXED.quasi, whole) if a in schema.quasi)

    places = Places(schema, threshold)
    kernel = Anonymizer(schema, AnonymizerConfig(threshold=threshold))
    groups = [Group(i, centroid=list(place())) for i in range(300)]
    for g in groups:
        places.put(g)
    for g in r.sample(groups, 100):
        g.centroid = list(place())
        places.put(g)
    for _ in range(200):
        x = place()
        raw = lambda g: math.sqrt(sum((p - q) ** 2 if a.kind == "numeric" else float(p != q) for a, p, q in zip(schema.quasi, x, g.centroid)))  # noqa: B023, E731
        near = [g for g in groups if kernel.distance(x, g.centroid) <= threshold]
        best = min(near, key=lambda g: (raw(g), g.id)) if near else None
        assert matcher(schema, threshold)(places.about(x), x) is best


def test_draws_are_hashes_of_seed_shard_and_keys():
    kernel = Anonymizer(MIXED, AnonymizerConfig(seed=9), "it's")
    want = ((xxhash.xxh3_64_intdigest(repr((9, "it's", "s", 17, 2)).encode()) >> 12) + 0.5) / 2**52
    assert kernel._uniform("'s', 17, 2") == want


@pytest.mark.parametrize("cfg", [AnonymizerConfig(k=5, threshold=0.12, delta=300), AnonymizerConfig(k=5, threshold=0.12, delta=300, gap=True, drift="centroid", noise="laplace", suppress="kernel")])
def test_a_restored_state_goes_on_alike(cfg):
    one, two, got = Anonymizer(MIXED, cfg), Anonymizer(MIXED, cfg), []
    for i, record in enumerate(orders_of(4, 200)):
        if i % 90 == 0:
            two = pickle.loads(pickle.dumps(two))
        got.append(one.step(*record))
        assert two.step(*record) == got[-1]
    assert two.flush() == one.flush() and any(got)


def test_shards_are_dealt_by_size(spark, monkeypatch):
    df = spark.range(6000).select(F.when(F.col("id") % 17 < 16, (F.col("id") % 17).cast("string")).alias("shard"), (6000 - F.col("id")).alias("seq"))
    held = [[(r.shard, r.seq) for r in part] for part in ordering.dealt(df, "shard", "seq").rdd.glom().collect()]
    assert sorted(len({s for s, _ in part}) for part in held) == [1] * 17  # one of them is the null shard
    assert all(part == sorted(part, key=lambda r: r[1]) for part in held) and sum(map(len, held)) == 6000
    monkeypatch.setattr(ordering, "OWN", 3)
    monkeypatch.setattr(ordering, "SIZED", 9)  # the others go by hash
    skewed = df.where("shard is null or shard = '0' or id % 10 = 0")
    few = [[(r.shard, r.seq) for r in part] for part in ordering.dealt(skewed, "shard", "seq").rdd.glom().collect()]
    assert len(few) == 4 and sum(map(len, few)) == skewed.count() and sorted(x for part in few for s in {s for s, _ in part} for x in [str(s)]) == sorted(str(s) for s in {r.shard for r in skewed.collect()})
    assert not [part for part in few if {None, "0"} <= {s for s, _ in part}]
    assert all([s for i, (s, _) in enumerate(part) if i == 0 or part[i - 1][0] != s] == sorted({s for s, _ in part}, key=lambda s: (s is not None, s or "")) for part in few)
    assert ordering.dealt(df.where("false"), "shard", "seq").count() == 0


def test_shards_with_parts_of_their_own_are_sorted_by_the_order_alone(spark):
    plan = lambda n: ordering.dealt(spark.range(500).select((F.col("id") % n).cast("string").alias("shard"), F.col("id").alias("seq")), "shard", "seq")._jdf.queryExecution().sparkPlan().toString()
    assert "Sort [seq#" in plan(16) and "Sort [shard#" in plan(40)


@pytest.mark.parametrize("name", ["microagg_gap", "microagg_randomized"])
def test_each_shard_of_the_kernels_queries_has_a_task(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001").select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(out) == len({r.p for r in out}) == 16


def test_the_sign_of_a_normal_draw_settles_whether_it_is_under_a_limit():
    kernel = Anonymizer(MIXED, AnonymizerConfig())
    assert all(kernel._normal_under(str(i), x) == (kernel._normal(str(i)) < x) for i in range(500) for x in (-0.5, 0.0, 0.05, 2.0))


@pytest.mark.parametrize("cfg", [AnonymizerConfig(publisher="random"), AnonymizerConfig(suppress="uniform", seed=3)])
def test_random_values_by_plan_are_those_drawn_one_by_one(cfg):
    kernel, seen = Anonymizer(MIXED, cfg, "7"), []
    for record in orders_of(1, 40):
        kernel.step(*record)
    for g in kernel.groups.values():
        assert g.waiting and g.size < cfg.k
        for seq, values in [(r[0], r[5]) for r in kernel._publish(list(g.waiting), g, g.centroid, 99)]:
            assert values == tuple(kernel._typed(a, kernel._random(i, g, seq)) for i, a in enumerate(MIXED.quasi))
            assert values == kernel._drawn(g)(seq)
            seen.append(seq)
    assert sorted(seen) == list(range(40)) and type(values[1]) is int


@pytest.mark.parametrize("shard", ["", "7", "it's", "ö" * 9, "k20_l2_eps0.01|3", "x" * 40])
def test_draws_of_many_records_are_those_of_each(shard):
    kernel, r = Anonymizer(MIXED, AnonymizerConfig(seed=1000 * len(shard) + 3), shard), random.Random(5)
    seqs = [0, 9, 10, -1, -(2**63), 2**63 - 1, 10**18, 10**18 - 1, *(r.randrange(10 ** r.randrange(1, 19)) for _ in range(400))]
    for i, got in enumerate(uniforms(f"{kernel.lead}, 's', ", seqs, [f", {i})" for i in range(12)])):
        assert got.tolist() == [kernel._uniform(f"'s', {s}, {i}") for s in seqs]
    assert [x.tolist() for x in uniforms("(", [], ["a", "b"])] == [[], []]


@pytest.mark.parametrize("cfg", [AnonymizerConfig(k=20, threshold=0.15, publisher="random"), AnonymizerConfig(k=5, l=3, c=1.1, threshold=0.12, delta=300, suppress="uniform")])
def test_random_values_of_a_batch_are_drawn_together(cfg, monkeypatch):
    one, records = Anonymizer(MIXED, cfg, "7"), list(orders_of(4, 200))
    want = [x for r in records for x in one.step(*r)] + one.flush()
    many = Anonymizer(MIXED, cfg, "7", late=True)
    monkeypatch.setattr(kernel_module, "digest", None)  # no draw is made by itself
    rows = [x for r in records for x in many.step(*r)] + many.flush()
    values = list(zip(*map(listed, many.shown(rows))))
    assert [(*r[:5], v) for r, v in zip(rows, values)] == want and len(want) == 800
    assert any(type(r[5]) is list for r in rows) and type(values[0][1]) is int and many.shown([]) == [[]] * 4


def test_random_numbers_that_are_none_are_refused():
    schema = StreamSchema("seq", (Attribute("x", lo=0.0, hi=math.inf),), SCHEMA.sensitive)
    for late in (False, True):
        kernel = Anonymizer(schema, AnonymizerConfig(k=1, buffer=2, threshold=2.0, publisher="random"), late=late)
        with pytest.raises(ValueError, match="no number"):
            kernel.shown(kernel.step(1, (1.0,), "a") + kernel.flush())


def test_what_a_search_found_is_kept_until_a_group_near_it_changes():
    places, groups = Places(MIXED, 0.15), [Group(i, centroid=[1e5, 1e3 + 1e6 * (i % 2), "1", "F"]) for i in range(6)]
    for g in groups[:4]:
        places.put(g)
    near, far = places.about((0, 1000, "1", "F")), places.about((0, 1001000, "1", "F"))
    assert [g.id for g in near] == [0, 2] and [g.id for g in far] == [1, 3]
    places.put(groups[4])
    assert places.about((0, 1001000, "1", "F")) is far and [g.id for g in places.about((0, 1000, "1", "F"))] == [0, 2, 4]
    places.drop(groups[3])
    assert [g.id for g in places.about((0, 1001000, "1", "F"))] == [1]
    kernel = Anonymizer(MIXED, AnonymizerConfig(k=20, threshold=0.15, delta=2000, gap=True, drift="centroid"))
    for record in orders_of(6, 300):
        kernel.step(*record)
        for cell, found in kernel.places.near.items():
            assert sorted(g.id for g in found) == sorted(g.id for c, held in kernel.places.cells.items() if abs(c - cell) <= 2 for g in held.values())


@pytest.mark.parametrize("base", [0, 9e10, 2.1094e11, 5e13])
def test_search_among_large_numbers(base):
    r, places, groups = random.Random(8), Places(MIXED, 0.15), []
    kernel = Anonymizer(MIXED, AnonymizerConfig(threshold=0.15))
    for i in range(300):
        groups.append(Group(i, centroid=[r.random() * 5e5, base + r.random() * 1e5, r.choice("12345"), r.choice("FOP")]))
        places.put(groups[-1])
    for i in range(300):
        at = r.choice([base + r.random() * 1e5, groups[i].centroid[1] + r.choice([-1, 1]) * 4218.75])
        x = (groups[i].centroid[0] if i % 2 else r.random() * 5e5, at, groups[i].centroid[2], groups[i].centroid[3])
        near = [g for g in groups if kernel.distance(x, g.centroid) <= 0.15]
        raw = lambda g: math.sqrt(sum((p - q) ** 2 if a.kind == "numeric" else float(p != q) for a, p, q in zip(MIXED.quasi, x, g.centroid)))  # noqa: B023, E731
        assert matcher(MIXED, 0.15)(places.about(x), x) is (min(near, key=lambda g: (raw(g), g.id)) if near else None)


def test_floored_centroids_and_drift_reset():
    a = Attribute("x", discrete=True, lo=0, hi=100)
    kernel = Anonymizer(StreamSchema("seq", (a,), SCHEMA.sensitive), AnonymizerConfig(k=100, threshold=2.0, floor_discrete=True))
    for i, v in enumerate((5, 8, 8, 9)):
        kernel.step(i + 1, (v,), "a")
    assert kernel.groups[0].centroid == [math.floor((math.floor((math.floor((5 * 2 + 8) / 3) * 3 + 8) / 4) * 4 + 9) / 5)]
    drifting = Anonymizer(SCHEMA, AnonymizerConfig(k=5, buffer=5, threshold=2.0, drift="centroid", drift_factor=9.0, confidence=0.1))
    for i in range(10):
        drifting.step(i + 1, (1.0 if i < 5 else 99.0,), "ab"[i % 2])
    assert drifting.groups[0].centroid == [99.0]


def test_streaming_equals_batch_across_batches_and_a_restart(spark, tmp_path):
    from veilspark.streaming.stream import END, anonymize_stream

    rows = [(str(r[0] % 2), r[0], r[1], r[3]) for r in stream(300, 5)]
    cfg = AnonymizerConfig(k=8, threshold=0.3, noise="laplace", eps=1.0)
    kinds = "shard string, seq bigint, x double, s string"
    inputs = f"{tmp_path}/in"
    for part in ((0, 100), (100, 230), (230, 300)):
        some = rows[part[0] : part[1]] + ([("0", END, 0.0, ""), ("1", END, 0.0, "")] if part[1] == 300 else [])
        spark.createDataFrame(some, kinds).repartition(2).write.mode("append").parquet(inputs)
        out = anonymize_stream(spark.readStream.schema(kinds).parquet(inputs), SCHEMA, cfg, "shard")
        # each run is a restart from the checkpoint
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = anonymize(spark.createDataFrame(rows, kinds), SCHEMA, cfg, "shard").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_schema_from_csv_and_stream_reading(spark, tmp_path):
    side = tmp_path / "side.csv"
    side.write_text('Feature,Type,Val_Type,Weight,Max_Rank,Min_Val,Max_Val,Distinct_Val\nTimestamp,numeric,discrete,1,,1,9,\nage.now,numeric,discrete,1,,0,100,\nday,categorical,ordinal,2,7,,,"{1,2,3,4,5,6,7}"\nclass,categorical,nominal,1,,,,"{<=50K, >50K}"\n')
    schema = StreamSchema.from_csv(spark, str(side))
    assert schema.sensitive.values == ("<=50K", ">50K") and schema.quasi[1].kind == ORDINAL and schema.quasi[1].max_rank == 7
    assert schema.counts() == {"numeric": 1, "categorical": 1} and not schema.all_numeric
    data = tmp_path / "data.csv"
    data.write_text("Timestamp,age.now,day,class\n1, 30,2, <=50K\n2,41,5,>50K\n")
    df = readers.read_stream(spark, str(data), schema)
    assert [tuple(r) for r in df.collect()] == [(1, 30, "2", "<=50K"), (2, 41, "5", ">50K")]
    (tmp_path / "data.tsv").write_text("1\t30\t2\t<=50K\n")
    assert readers.read_tsv(spark, str(tmp_path / "data.tsv"), schema).count() == 1
    rich = schema.enriched(df)
    assert (rich["age.now"].mean, rich["age.now"].mad) == (35.5, 5.5) and math.isclose(rich["age.now"].std, 11 / math.sqrt(2))
    with pytest.raises(ValueError, match="sequence"):
        side.write_text("Feature,Type,Val_Type,Weight,Max_Rank,Min_Val,Max_Val,Distinct_Val\nTimestamp,numeric,discrete,1,,1,9,\n")
        StreamSchema.from_csv(spark, str(side))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, "v", "b"), (1, 0.25, "u", "a")], "seq bigint, x double, c string, s string")
    writers.write_arff(df, BOTH, f"{tmp_path}/arff", "demo", "seq")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/arff").orderBy(F.input_file_name()).collect()]
    assert "@attribute x numeric" in lines and "@attribute c {u,v,w}" in lines and lines[-2:] == ["0.2500,u,a", "1.5000,v,b"]
    pairs = df.select(F.col("seq").alias("pub_seq"), "x", "c", F.col("s").alias("sensitive"), F.col("x").alias("anon_x"), F.col("c").alias("anon_c"))
    writers.write_pairs(pairs, BOTH, f"{tmp_path}/pairs")
    assert spark.read.option("header", True).csv(f"{tmp_path}/pairs/anonymized").columns == ["pub_seq", "x", "c", "sensitive"]
    writers.write_record_pairs(pairs, BOTH, f"{tmp_path}/record_pairs")
    assert {r["anonymized"] for r in spark.read.option("header", True).csv(f"{tmp_path}/record_pairs").collect()} == {"0.2500,u,a", "1.5000,v,b"}
    writers.append_text(df, "c", f"{tmp_path}/text")
    writers.append_text(df, "c", f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").count() == 4
    assert report.aligned(df, df.select("seq", "x"), "seq").where("anon_x = x").count() == 2
    writers.write_series(spark.createDataFrame([("k1", 100, 0.5), ("k2", 100, 0.7)], "run string, time bigint, metric double"), f"{tmp_path}/series")
    found = readers.read_series(spark, f"{tmp_path}/series/*")
    assert metrics.compare(found, "run", ["k1", "k2"], "metric").first().asDict() == {"time": 100, "k1": 0.5, "k2": 0.7}
    writers.append_report(spark.createDataFrame([("k1", 0.5)], "run string, mse double"), f"{tmp_path}/report")
    writers.append_report(spark.createDataFrame([("k2", 0.6)], "run string, mse double"), f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/report").count() == 2
    (tmp_path / "pred.csv").write_text("a,b\nb,b\n")
    assert readers.read_predictions(spark, f"{tmp_path}/pred.csv").count() == 2
    assert readers.last_measures(spark.createDataFrame([(1, 0.5), (2, 0.7)], "instances bigint, auc double"), ["auc", "f1"]).first().asDict() == {"auc": "0.7", "f1": "?"}


def test_positions_and_running_sums_over_block_edges(spark):
    keys = random.Random(2).sample(range(5000), 700)
    df = spark.createDataFrame([(k, float(k % 7)) for k in keys], "k bigint, v double")
    out = ordering.with_running_sums(ordering.with_position(df, "k"), "pos", {"total": F.col("v")}, block=50).collect()
    total = 0.0
    for i, r in enumerate(sorted(out, key=lambda r: r["k"])):
        total += r["v"]
        assert r["pos"] == i + 1 and r["total"] == total


def test_shuffle_and_duplicates_repeat(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = (sorted(map(tuple, ordering.shuffled(x, "k", 3).collect())) for x in (df, df.repartition(5)))
    assert one == two and sorted(x[1] for x in one) == list(range(1000)) and [x[0] for x in one] != [x[1] for x in one]
    more = ordering.reinsert_duplicates(df.withColumn("v", F.col("k") * 2), "k", 0.25, 3).collect()
    assert len(more) == 1250 and sorted(r["k"] for r in more) == list(range(1250)) and all(r["v"] % 2 == 0 for r in more)


def test_noise_distributions(spark):
    df = spark.range(40000)
    e = df.select(N.laplace(F.lit(2.0), 5, F.col("id")).alias("e"), N.laplace(F.lit(2.0), 5, F.col("id"), one_sided=True).alias("p"), N.normal(5, F.col("id")).alias("z"), N.uniform(5, F.col("id")).alias("u"))
    s = e.agg(*[f(c).alias(f"{n}_{c}") for c in "epzu" for n, f in (("m", F.avg), ("v", F.var_samp), ("lo", F.min))]).first()
    assert abs(s["m_e"]) < 0.06 and abs(s["v_e"] - 8) < 0.6 and abs(s["m_p"] - 2) < 0.06 and s["lo_p"] >= 0
    assert abs(s["m_z"]) < 0.03 and abs(s["v_z"] - 1) < 0.05 and abs(s["m_u"] - 0.5) < 0.01 and s["lo_u"] > 0
    swapped = df.select((N.replace_category(F.lit("a"), F.array(F.lit("a"), F.lit("b")), 0.1, 1.0, 5, F.col("id")) == "b").cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(swapped - 0.5398) < 0.02


def test_detectors():
    r = random.Random(1)
    window = Adwin()
    quiet = sum(window.detect(r.random()) for _ in range(3000))
    cuts = [i for i in range(3000) if window.detect(2 + r.random())]
    assert quiet <= 1 and cuts and cuts[0] < 200 and abs(window.mean - 2.5) < 0.1
    assert window.width == sum((1 << i) * len(row) for i, row in enumerate(window.rows))
    hinkley = PageHinkley(threshold=20)
    assert not any(hinkley.detect(r.random()) for _ in range(500)) and any(hinkley.detect(5 + r.random()) for _ in range(50))


def test_drift_statistics():
    r = np.random.default_rng(1)
    a, same, moved = r.normal(size=(150, 2)), r.normal(size=(150, 2)), r.normal(size=(150, 2)) + 1.5
    assert drift.ks2d(a, same)[1] > 0.05 > drift.ks2d(a, moved)[1]
    assert drift.energy_test(a, same)[1] > 0.02 >= drift.energy_test(a, moved)[1]
    assert drift.energy_test(a, moved, log=True)[1] < 0.05
    assert drift.pca_ks(a, moved) > drift.ks_threshold(0.01, 150, 150) > drift.pca_ks(a, same)
    assert drift.pca_ks(a, moved, pooled=False) < drift.pca_ks(a, moved)
    assert abs(drift.energy_test(a, moved, rounds=0)[0] - drift.energy(*drift.standardized(a, moved))) < 1e-9
    with pytest.raises(KeyError):
        drift.ks_threshold(0.2, 5, 5)


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_learners_beat_or_equal_the_majority(name):
    r, right = random.Random(3), []
    act = Prequential(name, "hi")
    for _ in range(1500):
        x = (r.random() * 10, r.random())
        y = "hi" if x[0] > 5 else "lo"
        (actual, pred, score), = act(*x, y)
        assert actual == y and 0 <= score <= 1
        right.append(pred == y)
    assert np.mean(right[500:]) > (0.4 if name == "majority" else 0.85)


@pytest.mark.parametrize("name", ["leveraging_bag", "adaptive_random_forest", "hoeffding_adaptive_tree"])
def test_a_record_is_judged_once_by_each_member(name, monkeypatch):
    calls, predict = [], NaiveBayes.predict
    monkeypatch.setattr(NaiveBayes, "predict", lambda self, x: calls.append(1) or predict(self, x))
    r = random.Random(6)
    records = [([r.random() * 10, r.random()], r.choice("ab")) for _ in range(900)]
    records = [(x, "a" if x[0] > 5 else y) for x, y in records]
    known, alone = LEARNERS[name](), LEARNERS[name]()
    for x, y in records:
        known.predict(x)
        known.learn(x, y)
    assert len(calls) == len(records) * len(getattr(known, "members", "1"))
    for x, y in records:
        alone.learn(x, y)
    assert alone.predict([5.5, 0.5]) == known.predict([5.5, 0.5])


def test_bounds_and_sweep(spark):
    with pytest.raises(ValueError):
        AnonymizerConfig(k=10, delta=5)
    with pytest.raises(ValueError):
        AnonymizerConfig(k=10, buffer=50)
    assert len(sweep([20, 50], [2], [0.01, 0.1])) == 4
    many = spark.range(neighbours.MAX_CENTROIDS + 1).select(F.col("id").alias("cluster"), F.lit(1.0).alias("x"))
    with pytest.raises(ValueError, match="broadcast"):
        neighbours.nearest(spark.range(1).select(F.col("id").alias("seq"), F.lit(1.0).alias("x")), many, SCHEMA, 1.0)


def test_diversity_and_kappa_edges(spark):
    df = spark.createDataFrame([("g", "a")] * 4 + [("g", "b")] * 2 + [("h", "a")], "g string, v string")
    got = {r["g"]: r for r in aggregates.diversity(df, ["g"], "v", 2, 2.0).collect()}
    assert not got["g"]["recursive_ok"] and got["g"]["distinct_ok"] and not got["h"]["distinct_ok"] and got["h"]["entropy"] == 0
    assert math.isnan(agreement.kappa(spark.createDataFrame([("a", "a")], "p string, q string"), "p", "q").first()[0])
    assert S.duration(F.lit(1)) is not None and EVENTS.all_numeric and not MIXED.all_nominal


def test_catalog_is_whole():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 50


def test_lowess_follows_a_line_and_smooths_noise(spark):
    x = np.arange(200.0)
    assert np.allclose(smoothing.lowess(x, 3 * x + 1), 3 * x + 1)
    noisy = np.sin(x / 30) + np.random.default_rng(1).normal(0, 0.3, 200)
    assert np.abs(smoothing.lowess(x, noisy, 0.15) - np.sin(x / 30)).mean() < 0.12
    assert smoothing.lowess(np.array([1.0]), np.array([2.0])).tolist() == [2.0]
    assert smoothing.timed(spark, lambda: None).first()["took"].startswith("00:00:00")


def test_buffered_groups():
    r = np.random.default_rng(2)
    for n in (1, 9, 10, 19, 20, 57):
        sizes = Counter(nearest_groups(r.random((n, 2)), 10).tolist())
        assert sum(sizes.values()) == n and all(10 <= s < 20 for s in sizes.values()) or n < 10


def test_sweep_of_noise_and_learners(spark):
    from veilspark.plans.catalog import EPSILONS, KS, QUERIES

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    rows = {(r.k, r.eps): r.mse_published for r in QUERIES["noise_sweep_losses"](spark, d).collect()}
    assert set(rows) == {(float(k), e) for k in KS for e in EPSILONS}
    for k in KS[:5]:
        assert rows[k, 0.01] > rows[k, 1.0]
    seen = {r.learner: r for r in QUERIES["classifier_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert set(seen) == set(LEARNERS)
    assert all(0 <= r.auc_anonymized <= r.auc_original + 0.1 <= 1.1 for r in seen.values())

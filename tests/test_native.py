"""The learners in the JVM against those in Python, record by record."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import agreement
from veilspark.plans.catalog import QUERIES
from veilspark.streaming import native
from veilspark.streaming.learners import LEARNERS, Bag, Prequential


def records(n, seed=1):
    """Three streams of three classes: one that turns twice, so that bags renew members and trees are cut back, a steady one, one with gaps."""
    r, out = random.Random(seed), []
    for i in range(n):
        a, b, c, d = round(r.random() * 100, 1), r.random(), float(r.randrange(5)), r.gauss(0, 3)
        turned = i // (n // 3) == 1
        y = "mid" if r.random() < 0.1 else "high" if (a > 60) != turned else "low"
        out += [("a", i, y, a, b, c, d), ("b", i, "high" if a > 60 else "low", a, b, c, d), ("c", i, y, None if i == 400 else a, b, c, None if i % 97 == 50 else d)]
    return out


def test_jvm_learners_repeat_python_s(spark, monkeypatch):
    rows, renewed = records(2400), []
    new = Bag._new
    monkeypatch.setattr(Bag, "_new", lambda self, i: renewed.append(i) or new(self, i))
    df = spark.createDataFrame(rows, "shard string, k bigint, y string, a double, b double, c double, d double").withColumn("learners", F.lit(",".join(LEARNERS)))
    out = native.prequential(df.repartition(3, F.rand(2)), "shard", "k", "learners", "y", [["a", "b", "c", "d"], ["d", "c", "b", "a"]], "high")
    got = {(r.shard, r.k, r.learner): r for r in out.collect()}
    assert len(got) == len(rows) * len(LEARNERS)
    for name in LEARNERS:
        for side in (0, 1):
            acts = {s: Prequential(name, "high") for s in "abc"}
            for shard, k, y, *x in rows:
                x = [math.nan if v is None else v for v in x]
                (actual, pred, score), = acts[shard](*(x[::-1] if side else x), y)
                r = got[shard, k, name]
                assert (actual, pred) == (r.actual, r[f"pred_{side}"]), (name, shard, k)
                assert abs(score - r[f"score_{side}"]) < 1e-9, (name, shard, k)
    assert len(renewed) > 2 * 2 * 3 * 10  # more than the first members


def test_comparison_learns_in_the_jvm(spark, monkeypatch):
    """As the sequential definition gives it, and with no learner in an interpreter."""
    from veilspark.plans import catalog

    def never(*_):
        raise AssertionError("a learner in Python")

    monkeypatch.setattr(catalog, "Prequential", never)
    kept = {}
    made = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name, *a: kept.setdefault(name, made(df, name, *a)))
    seen = {r.learner: r for r in QUERIES["classifier_comparison"](spark, "/root/testdata/sf0.001").collect()}
    lines = sorted(map(tuple, kept["sides"].select("shard", "o_orderkey", "y", "price", "shown", "month", "cust", "rank").collect()))
    assert len(lines) == 1500 and set(seen) == set(LEARNERS)
    for name in LEARNERS:
        for side, auc in enumerate((seen[name].auc_original, seen[name].auc_anonymized)):
            acts, p, q = {}, [], []
            for shard, _, y, price, shown, *rest in lines:
                (actual, _, score), = acts.setdefault(shard, Prequential(name, "high"))((price, shown)[side], *rest, y)
                (p if actual == "high" else q).append(score)
            won = sum((a > b) + (a == b) / 2 for a in p for b in q)
            assert abs(auc - won / len(p) / len(q)) < 2e-5, (name, side)


def test_agreement_by_group(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), round(r.random(), 1), r.randrange(2), r.choice("ab"), r.choice("ab")) for _ in range(600)] + [(3, 0.5, 1, "a", "a")]
    df = spark.createDataFrame(rows, "g int, s double, y int, a string, b string")
    ranked = {x.g: x.auc for x in agreement.auc_by(df.withColumn("z", 1 - F.col("y")).repartition(5), "g", "s", "y", "z").collect()}
    counts = df.groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    agreed = {x.g: x.kappa for x in agreement.kappa(counts.unionAll(counts), "a", "b", ["g"], "n").collect()}
    for g in range(3):
        one = df.where(F.col("g") == g)
        p, q = ([x[1] for x in rows if x[0] == g and x[2] == v] for v in (1, 0))
        assert abs(ranked[g] - sum((a > b) + (a == b) / 2 for a in p for b in q) / len(p) / len(q)) < 1e-8
        assert agreement.auc(one, "s", "y").first()[0] == ranked[g] and agreement.kappa(one, "a", "b").first()[0] == agreed[g]
    assert ranked[3] is None and math.isnan(agreed[3])  # a class alone has no rank


def test_ranks_go_on_over_batches():
    r = random.Random(5)
    rows = sorted((round(r.random(), 1), r.randrange(4), r.randrange(4)) for _ in range(200)) + [(math.nan, 1, 2)] * 2
    whole, parts = agreement.Ranks(), agreement.Ranks()
    columns = lambda some: (np.array([x[0] for x in some], float), *(np.array([x[i] for x in some], np.int64) for i in (1, 2)))
    whole.add(*columns(rows))
    for at in range(0, len(rows), 7):
        parts.add(*columns(rows[at : at + 7]))
    won = sum(a[1] * b[2] * (1 if i // 2 else 0.5 if i else 0) for a in rows for b in rows for i in [2 * (a[0] > b[0] or a[0] != a[0] and b[0] == b[0]) or (a[0] == b[0] or a[0] != a[0] and b[0] != b[0])])
    assert whole.sums() == parts.sums() == {"p": sum(x[1] for x in rows), "q": sum(x[2] for x in rows), "won": won}


def test_sums_are_those_of_the_predictions(spark):
    df = spark.createDataFrame(records(300), "shard string, k bigint, y string, a double, b double, c double, d double").withColumn("learners", F.lit("majority,sgd"))
    given = (df, "shard", "k", "learners", "y", [["a", "b", "c", "d"], ["d", "c", "b", "a"]], "high")
    each, sums = native.prequential(*given).collect(), native.prequential_sums(*given).collect()
    scores, cells = Counter(), Counter()
    for r in sums:
        if r.n is None:
            scores[r.learner, r.side, r.score, True] += r.p
            scores[r.learner, r.side, r.score, False] += r.q
        else:
            cells[r.learner, r.side, r.a, r.b] += r.n
    assert +scores == Counter((r.learner, i, r[f"score_{i}"], r.actual == "high") for r in each for i in (0, 1))
    assert cells == Counter((r.learner, 1, r.pred_0, r.pred_1) for r in each)

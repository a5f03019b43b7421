"""Every query of the engine on the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AnonymizerConfig, sweep
from ..functions import distance as D
from ..functions import noise as N
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import agreement as G
from ..operators import drift as C
from ..operators import metrics as M
from ..operators import neighbours as J
from ..operators import ordering as O
from ..operators import report as R
from ..operators.smoothing import smoothed
from ..schema import NOMINAL, ORDINAL, Attribute, StreamSchema, numeric_stats
from ..shared import materialize, workspace
from ..sources import readers as Q
from ..sources import writers as W
from ..streaming import detectors
from ..streaming.batch import anonymize, anonymize_runs
from ..streaming.buffered import knn_anonymize
from ..streaming.learners import LEARNERS, Prequential
from ..streaming.native import prequential_sums
from .grouping_sql import grouping_sql
from .single_cluster import single_cluster

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STATUSES, PRIORITIES = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PRICE = Attribute("o_totalprice", lo=0.0, hi=600000.0)
ORDERS = StreamSchema("o_orderkey", (PRICE,), Attribute("o_orderstatus", NOMINAL, values=STATUSES))
CUSTOMER = Attribute("o_custkey", discrete=True, weight=2.0, lo=0, hi=15000)
RANK = Attribute("o_rank", ORDINAL, weight=0.5, max_rank=5)
STATUS = Attribute("o_orderstatus", NOMINAL, weight=0.25, values=STATUSES)
MIXED = StreamSchema("o_orderkey", (PRICE, CUSTOMER, RANK, STATUS), Attribute("o_orderpriority", NOMINAL, values=PRIORITIES))
LINE = [Attribute("l_quantity", lo=0.0, hi=60.0), Attribute("l_extendedprice", lo=0.0, hi=120000.0, weight=2.0), Attribute("l_discount", lo=0.0, hi=0.1), Attribute("l_tax", lo=0.0, hi=0.1)]
EVENTS = StreamSchema("event_id", (Attribute("value", lo=0.0, hi=500.0),), Attribute("event_type", NOMINAL, values=("click", "error", "purchase", "signup", "view")))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("o_rank", F.substring("o_orderpriority", 1, 1))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each order beside the one of the next key, whose columns begin with n_."""
    a = orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey", "o_rank", "o_orderstatus", "o_orderpriority")
    b = a.select(*[F.col(c).alias(f"n_{c}") for c in a.columns])
    return a.join(b, F.col("n_o_orderkey") == F.col("o_orderkey") + 1)


_X, _Y = D.side(), D.side("n_")
_NEXT = "orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"
_P = "(abs(a.o_totalprice - b.o_totalprice) / 600000.0)"
_K = "(2.0 * abs(a.o_custkey - b.o_custkey) / 15000.0)"
_R = "(0.25 * abs(CAST(substr(a.o_orderpriority, 1, 1) AS INT) - CAST(substr(b.o_orderpriority, 1, 1) AS INT)) / 16.0)"
_S = "(CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 0 ELSE 0.25 END)"


def _distance(spark: SparkSession, d: str, column) -> DataFrame:
    return neighbours(spark, d).select("o_orderkey", F.round(column, 9).alias("dist"))


# schema and scalar functions -----------------------------------------------------------------------------------------


@query("""
SELECT attr, min(x) + 0.0 AS lo, max(x) + 0.0 AS hi, round(avg(x) + 1e-8, 6) AS mean, round(stddev_samp(x) + 1e-8, 6) AS std, round(avg(abs(x - m)) + 1e-8, 6) AS mad FROM (
  SELECT *, avg(x) OVER (PARTITION BY attr) AS m FROM (
    SELECT 'l_quantity' AS attr, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
    UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)) GROUP BY attr""")
def domain_stats(spark, d):
    found = numeric_stats(table(spark, d, "lineitem"), [a.name for a in LINE])
    return found.select("attr", "lo", "hi", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("mean", "std", "mad")])


@query("SELECT o_orderkey, round(o_totalprice / 600000.0 * 2 - 1, 9) AS scaled FROM orders")
def minmax_normalize(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(S.minmax(PRICE, F.col("o_totalprice"), -1.0, 1.0), 9).alias("scaled"))


def _standardized(spark, d, spread):
    stats = F.broadcast(numeric_stats(table(spark, d, "orders"), ["o_totalprice"]))  # one row
    return orders(spark, d).join(stats, how="cross").select("o_orderkey", F.round(S.zscore(F.col("o_totalprice"), F.col("mean"), F.col(spread)), 6).alias("z"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders")
def zscore_std(spark, d):
    return _standardized(spark, d, "std")


@query("""
WITH m AS (SELECT avg(o_totalprice) AS m FROM orders), s AS (SELECT avg(abs(o_totalprice - m)) AS s FROM orders, m)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, m, s""")
def zscore_mad(spark, d):
    return _standardized(spark, d, "mad")


@query("""
SELECT o_orderkey, least(greatest(o_totalprice, 50000.0), 200000.0) AS price, CAST(trunc(least(greatest(o_totalprice, 50000.0), 200000.0)) AS BIGINT) AS price_int FROM orders""")
def clamp(spark, d):
    a = replace(PRICE, lo=50000.0, hi=200000.0)
    return orders(spark, d).select("o_orderkey", S.clamp(a, F.col("o_totalprice")).alias("price"), S.clamp(replace(a, discrete=True), F.col("o_totalprice")).alias("price_int"))


@query("""
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INT) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INT) AS "o_orderstatus_P" FROM orders""")
def one_hot(spark, d):
    return orders(spark, d).select("o_orderkey", *S.one_hot(STATUS, F.col("o_orderstatus")))


@query("""
SELECT o_orderkey, replace(concat_ws(',', printf('%.4f', o_totalprice), o_custkey, substr(o_orderpriority, 1, 1), o_orderstatus, o_orderpriority), ' ', '') AS line FROM orders""")
def record_format(spark, d):
    return orders(spark, d).select("o_orderkey", S.record_text(MIXED).alias("line"))


@query("""
SELECT event_id, printf('%02d:%02d:%02d %s', event_id // 3600, event_id % 3600 // 60, event_id % 60,
  CASE WHEN event_id >= 3600 THEN 'hours' WHEN event_id >= 60 THEN 'minutes' ELSE 'seconds' END) AS took FROM events""")
def duration_format(spark, d):
    return table(spark, d, "events").select("event_id", S.duration(F.col("event_id")).alias("took"))


@query("""
SELECT o_orderkey AS seq, o_totalprice AS price, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS sensitive FROM orders""")
def record_projection(spark, d):
    from ..sources.readers import records

    r = records(orders(spark, d), MIXED)
    return r.select("seq", F.col("quasi.o_totalprice").alias("price"), F.col("quasi.o_custkey").alias("cust"), F.col("quasi.o_orderstatus").alias("status"), "sensitive")


# distances -----------------------------------------------------------------------------------------------------------


@query(f"SELECT a.o_orderkey, round(sqrt(({_P} * {_P} + {_K} * {_K}) / 2), 9) AS dist FROM {_NEXT}")
def dist_numeric(spark, d):
    return _distance(spark, d, D.scaled_euclidean([PRICE, CUSTOMER], _X, _Y))


@query(f"SELECT a.o_orderkey, round(({_P} + {_K} + {_R} + {_S}) / 3.75, 9) AS dist FROM {_NEXT}")
def dist_mixed(spark, d):
    return _distance(spark, d, D.distance(MIXED, _X, _Y))


@query(f"""SELECT a.o_orderkey, round(((a.o_orderstatus <> b.o_orderstatus)::INT + (a.o_orderpriority <> b.o_orderpriority)::INT) / 2, 9) AS dist FROM {_NEXT}""")
def dist_nominal(spark, d):
    return _distance(spark, d, D.mismatch_share([STATUS, MIXED.sensitive], _X, _Y))


@query(f"SELECT a.o_orderkey, round({_R}, 9) AS dist, round({_R} * 8, 9) AS corrected FROM {_NEXT}")
def dist_ordinal(spark, d):
    own = lambda c: D.ordinal(RANK, F.col("o_rank"), F.col("n_o_rank"), c)
    return neighbours(spark, d).select("o_orderkey", F.round(own(False), 9).alias("dist"), F.round(own(True), 9).alias("corrected"))


@query(f"""SELECT a.o_orderkey, round(sqrt(pow(a.o_totalprice - b.o_totalprice, 2) + pow(a.o_custkey - b.o_custkey, 2)
  + (a.o_orderpriority <> b.o_orderpriority)::INT + (a.o_orderstatus <> b.o_orderstatus)::INT), 6) AS dist FROM {_NEXT}""")
def dist_unbounded(spark, d):
    return neighbours(spark, d).select("o_orderkey", F.round(D.unbounded(MIXED.quasi, _X, _Y), 6).alias("dist"))


@query(f"SELECT a.o_orderkey, round(sqrt({_P} * {_P} + {_K} * {_K} / 4), 9) AS dist FROM {_NEXT}")
def dist_minmax(spark, d):
    return _distance(spark, d, D.minmax_euclidean([PRICE, CUSTOMER], _X, _Y))


@query("""SELECT a.vec_id, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])
  * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dist_cosine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(D.cosine(F.col("embedding"), F.col("next")), 6).alias("dist"))


@query(f"""SELECT a.o_orderkey, round(CASE WHEN a.o_totalprice = 0 AND b.o_totalprice = 0 THEN 0 ELSE {_P} END
  + CASE WHEN a.o_custkey = 0 AND b.o_custkey = 0 THEN 0 ELSE {_K} / 2 END + {_R} / 4 + {_S} / 4, 9) AS dist FROM {_NEXT}""")
def relative_error(spark, d):
    return _distance(spark, d, D.relative_error(MIXED.quasi, _X, _Y))


# neighbours ----------------------------------------------------------------------------------------------------------

_SPLIT = StreamSchema("o_orderkey", (PRICE, replace(CUSTOMER, weight=1.0)), MIXED.sensitive)
_CENTROIDS = "c AS (SELECT o_orderpriority AS cluster, avg(o_totalprice) + 40000 * CAST(substr(o_orderpriority, 1, 1) AS INT) - 120000 AS p, avg(o_custkey) AS k FROM orders GROUP BY 1)"
_NEAR = "sqrt((pow((o_totalprice - p) / 600000.0, 2) + pow((o_custkey - k) / 15000.0, 2)) / 2)"


def _centroids(spark, d):
    found = A.centroids(orders(spark, d), ["o_orderpriority"], list(_SPLIT.quasi))
    return found.select(F.col("o_orderpriority").alias("cluster"), (F.col("o_totalprice") + 40000 * F.substring("o_orderpriority", 1, 1).cast("int") - 120000).alias("o_totalprice"), "o_custkey")


@query(f"""WITH {_CENTROIDS} SELECT o_orderkey, cluster, round({_NEAR}, 9) AS dist FROM orders, c WHERE {_NEAR} <= 0.1""")
def candidate_clusters(spark, d):
    return J.candidates(orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey"), _centroids(spark, d), _SPLIT, 0.1).select("o_orderkey", "cluster", F.round("dist", 9).alias("dist"))


@query(f"""WITH {_CENTROIDS}, r AS (SELECT o_orderkey, cluster, round(sqrt(pow(o_totalprice - p, 2) + pow(o_custkey - k, 2)), 9) AS raw FROM orders, c WHERE {_NEAR} <= 0.1),
b AS (SELECT o_orderkey, cluster, raw, row_number() OVER (PARTITION BY o_orderkey ORDER BY raw, cluster) AS n FROM r)
SELECT o.o_orderkey, cluster, round(raw, 3) AS dist_raw FROM orders o LEFT JOIN b ON o.o_orderkey = b.o_orderkey AND n = 1""")
def nearest_centroid(spark, d):
    return J.nearest(orders(spark, d), _centroids(spark, d), _SPLIT, 0.1).select("o_orderkey", "cluster", F.round("dist_raw", 3).alias("dist_raw"))


# aggregates ----------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS size, round(avg(o_totalprice), 4) AS price, round(avg(o_custkey), 4) AS cust, any_value(m.o_orderstatus) AS status
FROM orders JOIN m USING (o_orderpriority) WHERE m.n = 1 GROUP BY 1""")
def centroid_batch(spark, d):
    out = A.centroids(orders(spark, d), ["o_orderpriority"], [PRICE, CUSTOMER, STATUS])
    return out.select("o_orderpriority", "size", F.round("o_totalprice", 4).alias("price"), F.round("o_custkey", 4).alias("cust"), F.col("o_orderstatus").alias("status"))


@query("""SELECT o_orderkey, round((first_value(o_totalprice) OVER w + sum(o_totalprice) OVER w) / (count(*) OVER w + 1) + 1e-6, 4) AS centroid, round(avg(o_totalprice) OVER w + 1e-6, 4) AS mean
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def centroid_running(spark, d):
    run = lambda t: F.round(A.running_centroid("o_totalprice", ["o_custkey"], "o_orderkey", t) + 1e-6, 4)
    return orders(spark, d).select("o_orderkey", run(False).alias("centroid"), run(True).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey, n, x AS c FROM o WHERE n = 1 UNION ALL SELECT o.o_custkey, o.n, CAST(floor((r.c * o.n + o.x) / (o.n + 1)) AS BIGINT) FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
SELECT o_custkey, max_by(c, n) AS centroid FROM r GROUP BY 1""")
def centroid_floored(spark, d):
    whole = orders(spark, d).select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("x"))
    return A.floored_centroid(whole, "o_custkey", "o_orderkey", "x")


@query("""SELECT o_custkey, 'o_orderstatus' AS attr, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def freq_table(spark, d):
    return A.frequencies(orders(spark, d), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("""WITH c AS (SELECT o_orderkey, sum((o_orderstatus = 'F')::INT) OVER w AS f, sum((o_orderstatus = 'O')::INT) OVER w AS o, sum((o_orderstatus = 'P')::INT) OVER w AS p
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END AS mode FROM c""")
def running_mode(spark, d):
    counts = A.running_counts("o_orderstatus", list(STATUSES), ["o_custkey"], "o_orderkey")
    return orders(spark, d).select("o_orderkey", counts.alias("c")).select("o_orderkey", A.most_frequent(F.col("c"), list(STATUSES)).alias("mode"))


_COUNTS = "n AS (SELECT o_custkey AS g, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, v) AS r FROM n)"


def _diversity(spark, d):
    return A.diversity(orders(spark, d), ["o_custkey"], "o_orderpriority", 3, 2.0)


@query(f"WITH {_COUNTS} SELECT g AS o_custkey, count(*) AS n_distinct, count(*) >= 3 AS distinct_ok FROM k GROUP BY g")
def div_distinct(spark, d):
    return _diversity(spark, d).select("o_custkey", "n_distinct", "distinct_ok")


@query(f"WITH {_COUNTS} SELECT g AS o_custkey, coalesce(max(n) < CAST(2.0 AS DOUBLE) * sum(n) FILTER (r >= 3), false) AS recursive_ok FROM k GROUP BY g")
def div_recursive(spark, d):
    return _diversity(spark, d).select("o_custkey", "recursive_ok")


@query(f"""WITH {_COUNTS}, e AS (SELECT g, -sum(p * log2(p)) AS e FROM (SELECT g, n / sum(n) OVER (PARTITION BY g) AS p FROM n) GROUP BY g)
SELECT g AS o_custkey, round(abs(e), 6) AS entropy, round(e, 9) > round(log2(3), 9) AS entropy_ok FROM e""")
def div_entropy(spark, d):
    return _diversity(spark, d).select("o_custkey", F.round(F.abs("entropy"), 6).alias("entropy"), "entropy_ok")


@query("SELECT o_custkey, count(*) AS size, count(*) >= 10 AS ok FROM orders GROUP BY 1")
def k_gate(spark, d):
    return orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("size"), (F.count("*") >= 10).alias("ok"))


@query("""WITH f AS (SELECT user_id, epoch_us(ts) AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS f FROM events)
SELECT user_id, count(*) AS size, round((count(*) - 1) / (sum(t - f) / 1e6 + 1), 9) AS activity FROM f GROUP BY user_id""")
def cluster_activity(spark, d):
    return A.activity(table(spark, d, "events"), ["user_id"], F.col("ts"))


@query("""WITH c AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, avg(value) OVER () AS g FROM events)
SELECT event_type, count(*) AS size, round(sum(abs(value - m) / 500.0), 6) AS gse, round(sum(abs(value - g) / 500.0), 6) AS gse_total FROM c GROUP BY 1""")
def group_square_error(spark, d):
    e = table(spark, d, "events")
    own = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    all_ = F.broadcast(e.agg(F.avg("value").alias("g")))  # one row
    far = lambda c: F.round(F.sum(F.abs(F.col("value") - F.col(c)) / 500.0), 6)
    return e.join(own, "event_type").join(all_, how="cross").groupBy("event_type").agg(F.count("*").alias("size"), far("m").alias("gse"), far("g").alias("gse_total"))


# the anonymizer with one open group ----------------------------------------------------------------------------------

FLAGSHIP = AnonymizerConfig(k=48, l=3, c=2.0)
_PAIRS = """
s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, o_orderkey AS seq, o_totalprice AS x, o_orderstatus AS s, count(*) OVER () AS n FROM orders),
m AS (SELECT *, (pos - 1) // 192 AS c, (pos - 1) % 192 + 1 AS j, count(*) OVER (PARTITION BY (pos - 1) // 192) AS size FROM s),
u AS (SELECT c, j, (first_value(x) OVER w + sum(x) OVER w) / (j + 1) AS cen, sum((s = 'F')::INT) OVER w AS f, sum((s = 'O')::INT) OVER w AS o, sum((s = 'P')::INT) OVER w AS p
  FROM m WINDOW w AS (PARTITION BY c ORDER BY j ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN size < 48 THEN size ELSE greatest(j, 48) END AS r FROM m),
v AS (SELECT h.*, cen, f, o, p, greatest(f, o, p) < CAST(2 AS DOUBLE) * least(f, o, p) AND least(f, o, p) > 0 AS diverse FROM h JOIN u ON u.c = h.c AND u.j = h.r),
pairs AS (SELECT CASE WHEN size < 48 THEN c * 192 + size - j + 1 WHEN j <= 48 THEN c * 192 + 48 - j + 1 ELSE pos END AS pub_seq, seq, pos,
  CASE WHEN size < 48 THEN n WHEN j <= 48 THEN c * 192 + 48 ELSE pos END AS publish_time, CASE WHEN size < 48 THEN 1 WHEN diverse THEN 0 ELSE 2 END AS status, c AS cluster,
  CASE WHEN f >= o AND f >= p THEN 'F' WHEN o >= p THEN 'O' ELSE 'P' END AS majority, s AS sensitive, x AS o_totalprice,
  CASE WHEN size >= 48 AND diverse THEN floor(cen * 10000 + 0.5) / 10000 ELSE 300000.0 END AS anon FROM v)"""


def _dist():
    return F.abs(F.col("o_totalprice") - F.col("anon_o_totalprice")) / 600000.0


def pairs(spark: SparkSession, d: str, cfg: AnonymizerConfig = FLAGSHIP) -> DataFrame:
    return single_cluster(table(spark, d, "orders"), ORDERS, cfg)


@query(f"WITH {_PAIRS} SELECT pub_seq, seq, publish_time, status, cluster, majority, sensitive, o_totalprice, round(anon + 1e-6, 3) AS anon FROM pairs")
def microagg_single_cluster(spark, d):
    return pairs(spark, d).select("pub_seq", "seq", "publish_time", "status", "cluster", "majority", "sensitive", "o_totalprice", F.round(F.col("anon_o_totalprice") + 1e-6, 3).alias("anon"))


@query(f"""WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (status = 0) AS published, count(*) FILTER (status = 1) AS suppressed_size,
count(*) FILTER (status = 2) AS suppressed_diversity, count(DISTINCT cluster) AS opened_clusters FROM pairs""")
def publish_status(spark, d):
    return M.counters(pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(pow((o_totalprice - anon) / 600000.0, 2)), 9) AS mse FROM pairs")
def mse(spark, d):
    return M.mse(pairs(spark, d), _dist())


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(sum(abs(o_totalprice - anon)) / 1000, 3) AS sse FROM pairs")
def sse(spark, d):
    return M.sse(pairs(spark, d), F.abs(F.col("o_totalprice") - F.col("anon_o_totalprice"))).select("n", F.round(F.col("sse") / 1000, 3).alias("sse"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(abs(o_totalprice - anon) / 600000.0) * 100, 6) AS relative_error FROM pairs")
def relative_error_metric(spark, d):
    return M.relative_error(pairs(spark, d), _dist(), 1)


@query(f"""WITH {_PAIRS}, a AS (SELECT *, avg(o_totalprice) OVER () AS m FROM pairs) SELECT round(sum(pow((o_totalprice - anon) / 600000.0, 2)), 6) AS sse,
round(sum(pow((o_totalprice - m) / 600000.0, 2)), 6) AS sst, round(sum(pow((o_totalprice - anon) / 600000.0, 2)) / sum(pow((o_totalprice - m) / 600000.0, 2)), 9) AS homogeneity FROM a""")
def homogeneity(spark, d):
    return M.homogeneity(pairs(spark, d), _dist(), "o_totalprice", 600000.0)


@query(f"""WITH {_PAIRS} SELECT sum((status <> 0 OR sensitive <> majority)::INT)::BIGINT AS penalties, round(avg((status <> 0 OR sensitive <> majority)::INT), 9) AS classification_metric FROM pairs""")
def classification_metric(spark, d):
    return M.classification(pairs(spark, d))


_RISK = """b AS (SELECT *, min(dd) OVER (PARTITION BY pub_seq) AS best FROM met),
r AS (SELECT pub_seq, count(*) FILTER (dd = best) AS ties, CASE WHEN max(own) FILTER (dd = best) = 1 THEN 1 / count(*) FILTER (dd = best) ELSE 0 END AS risk FROM b GROUP BY pub_seq)"""


@query(f"""WITH {_PAIRS}, met AS (SELECT t.pub_seq, abs(t.anon - a.o_totalprice) AS dd, (a.pub_seq = t.pub_seq)::INT AS own
FROM pairs t JOIN pairs a ON (a.pub_seq <= 99 AND a.pub_seq < t.pub_seq) OR a.pub_seq = t.pub_seq), {_RISK} SELECT pub_seq, ties, risk FROM r""")
def disclosure_anchor(spark, d):
    return M.disclosure_anchor(pairs(spark, d), "o_totalprice", "anon_o_totalprice")


@query(f"""WITH {_PAIRS}, met AS (SELECT t.pub_seq, abs(t.anon - a.o_totalprice) AS dd, (a.pub_seq = t.pub_seq)::INT AS own
FROM pairs t JOIN pairs a ON a.pub_seq BETWEEN t.pub_seq - 99 AND t.pub_seq), {_RISK} SELECT pub_seq, ties, risk FROM r""")
def disclosure_sliding(spark, d):
    return M.disclosure_sliding(pairs(spark, d), "o_totalprice", "anon_o_totalprice")


@query(f"""WITH {_PAIRS}, met AS (SELECT t.pub_seq, abs(t.anon - a.o_totalprice) AS dd, (a.pub_seq = t.pub_seq)::INT AS own
FROM pairs t JOIN pairs a ON (a.pub_seq <= 99 AND a.pub_seq < t.pub_seq) OR a.pub_seq = t.pub_seq), {_RISK},
q AS (SELECT pub_seq, risk, sum(risk) OVER (ORDER BY pub_seq ROWS UNBOUNDED PRECEDING) AS total FROM r),
z AS (SELECT pub_seq, last_value(CASE WHEN risk > 0 THEN total / pub_seq END IGNORE NULLS) OVER (ORDER BY pub_seq ROWS UNBOUNDED PRECEDING) AS risk FROM q)
SELECT pub_seq AS time, round(coalesce(risk, 0), 6) AS risk FROM z WHERE pub_seq % 100 = 0""")
def disclosure_series(spark, d):
    return M.stale_series(M.disclosure_anchor(pairs(spark, d), "o_totalprice", "anon_o_totalprice"))


@query(f"WITH {_PAIRS} SELECT round(avg(publish_time - pos), 3) AS avg_delay FROM pairs")
def delay_avg(spark, d):
    return M.delay(pairs(spark, d))


_RUN = "OVER (ORDER BY pub_seq ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {_PAIRS}, q AS (SELECT pub_seq AS time, round(avg(publish_time - pos) {_RUN}, 6) AS delay, round(avg(pow((o_totalprice - anon) / 600000.0, 2)) {_RUN}, 6) AS mse,
round(avg((status <> 0 OR sensitive <> majority)::INT) {_RUN}, 6) AS penalty FROM pairs) SELECT * FROM q WHERE time % 100 = 0""")
def metric_series(spark, d):
    return M.series(pairs(spark, d), {"delay": F.col("publish_time") - F.col("pos"), "mse": _dist() * _dist(), "penalty": M.classification_penalty()})


_REPORT = """count(*) AS n, count(DISTINCT cluster) AS opened_clusters, count(*) FILTER (status = 1) AS suppressed_size, count(*) FILTER (status = 2) AS suppressed_diversity,
round(avg(publish_time - pos), 3) AS avg_delay, round(avg(pow((o_totalprice - anon) / 600000.0, 2)), 9) AS mse, round(sum(abs(o_totalprice - anon)) / 1000, 3) AS sse_thousands,
round(avg(abs(o_totalprice - anon) / 600000.0) * 100, 6) AS relative_error, round(avg((status <> 0 OR sensitive <> majority)::INT), 9) AS classification_metric FROM pairs"""


def _report(spark, d, cfg, run_id):
    return R.run_report(pairs(spark, d, cfg), cfg, _dist(), F.abs(F.col("o_totalprice") - F.col("anon_o_totalprice")), 1, run_id)


@query(f"""WITH {_PAIRS} SELECT 'flagship' AS run_id, 48.0::DOUBLE AS k, 3.0::DOUBLE AS l, 2.0::DOUBLE AS c, 0.01::DOUBLE AS eps, NULL::DOUBLE AS delta, 144.0::DOUBLE AS buffer, 1.0::DOUBLE AS threshold, {_REPORT}""")
def run_report(spark, d):
    return _report(spark, d, FLAGSHIP, "flagship")


KS, EPSILONS = (20, 50, 100, 200, 400, 800), (0.01, 0.05, 0.1, 1.0)


def _swept(sql: str, k: int) -> str:
    """SQL of k = 48 and l = 3 for another k and l = 2."""
    rest = "(f + o + p - greatest(f, o, p))"
    return sql.replace("192", str(4 * k)).replace("48", str(k)).replace("least(f, o, p) AND least(f, o, p) > 0", f"{rest} AND {rest} > 0")


@query(" UNION ALL ".join(f"""(WITH {_swept(_PAIRS, k)} SELECT 'k{k}_l2_eps0.01' AS run_id, {k}.0::DOUBLE AS k, {_REPORT})""" for k in KS))
def parameter_sweep(spark, d):
    """All group sizes, on the closed form, which adds no noise."""
    runs = [_report(spark, d, cfg, run_id).drop("l", "c", "eps", "delta", "buffer", "threshold") for run_id, cfg in sweep(list(KS), [2], c=2.0).items()]
    return reduce(DataFrame.unionByName, runs)


#: Learners that go along a shard together: a bag costs as much as many single ones.
TOGETHER = ("leveraging_bag", "adaptive_random_forest", ",".join(x for x in LEARNERS if x not in ("leveraging_bag", "adaptive_random_forest")))


@query()
def classifier_comparison(spark, d):
    """Every learner on the original and on the published prices of each shard, and the agreement of the two; the learners run side by side."""
    o = orders(spark, d).withColumn("shard", F.pmod("o_custkey", F.lit(8)).cast("string")).withColumns({"month": F.month("o_orderdate").cast("double"), "cust": F.col("o_custkey").cast("double"), "rank": F.col("o_rank").cast("double")})
    anon = anonymize(o, ORDERS, AnonymizerConfig(k=20, threshold=0.1), "shard").select(F.col("seq").alias("o_orderkey"), F.col("anon_o_totalprice").alias("shown"))
    own = o.select("shard", "o_orderkey", F.col("o_totalprice").alias("price"), "month", "cust", "rank", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("y"))
    both = materialize(own.join(anon, "o_orderkey"), "sides")
    each = both.withColumn("learners", F.explode(F.array(*[F.lit(x) for x in TOGETHER]))).withColumn("shard", F.concat_ws("|", "learners", "shard"))
    sides = [[price, "month", "cust", "rank"] for price in ("price", "shown")]
    sums = prequential_sums(each, "shard", "o_orderkey", "learners", "y", sides, "high")
    return R.paired_report(materialize(sums, "sums"), list(LEARNERS))


QUERIES["microagg_randomized"] = lambda spark, d: _kernel(AnonymizerConfig(k=20, threshold=0.15, publisher="random"), MIXED)(spark, d)


def _sql_delay(k: int) -> str:
    return f"""(SELECT CASE WHEN size < {k} THEN c * {4 * k} + size - j + 1 WHEN j <= {k} THEN c * {4 * k} + {k} - j + 1 ELSE pos END AS pub_seq,
  CASE WHEN size < {k} THEN n WHEN j <= {k} THEN c * {4 * k} + {k} ELSE pos END - pos AS wait FROM (SELECT pos, n, (pos - 1) // {4 * k} AS c, (pos - 1) % {4 * k} + 1 AS j,
  count(*) OVER (PARTITION BY (pos - 1) // {4 * k}) AS size FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, count(*) OVER () AS n FROM orders)))"""


@query("WITH " + ", ".join(f"d{k} AS (SELECT pub_seq AS time, round(avg(wait) {_RUN}, 6) AS v FROM {_sql_delay(k)})" for k in (20, 50, 100)) + """
SELECT d20.time, d20.v AS k20, d50.v AS k50, d100.v AS k100 FROM d20 JOIN d50 USING (time) JOIN d100 USING (time) WHERE time % 100 = 0""")
def compare_pivot(spark, d):
    runs = []
    for k in (20, 50, 100):
        series = M.series(pairs(spark, d, AnonymizerConfig(k=k)), {"delay": F.col("publish_time") - F.col("pos")})
        runs.append(series.withColumn("run", F.lit(f"k{k}")))
    return M.compare(runs[0].unionByName(runs[1]).unionByName(runs[2]), "run", ["k20", "k50", "k100"], "delay")


# drift ---------------------------------------------------------------------------------------------------------------


def _event_windows(spark, d, size):
    e = O.with_position(table(spark, d, "events"), "event_id").select("pos", "value", "event_type", F.col("user_id").cast("double").alias("user"))
    return C.windows(e, "pos", size)


_W = """e AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, * FROM events), w AS (SELECT (pos - 1) // {0} AS win, * FROM e),
t AS (SELECT win AS pair, 1 AS tag, * FROM w UNION ALL SELECT win + 1, 0, * FROM w)"""


@query(f"""WITH {_W.format(500)}, c AS (SELECT pair, value, count(*) FILTER (tag = 0) AS a, count(*) FILTER (tag = 1) AS b FROM t GROUP BY ALL),
g AS (SELECT pair, abs(sum(a) OVER u / sum(a) OVER p - sum(b) OVER u / sum(b) OVER p) AS g, sum(a) OVER p AS n, sum(b) OVER p AS m FROM c
  WINDOW u AS (PARTITION BY pair ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY pair))
SELECT pair, round(max(g), 9) AS d, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM g WHERE n > 0 AND m > 0 GROUP BY pair""")
def ks_two_sample(spark, d):
    return C.ks_statistic(C.paired(_event_windows(spark, d, 500)), "pair", "tag", "value")


@query(f"""WITH {_W.format(500)}, n AS (SELECT win, event_type, row_number() OVER (PARTITION BY win ORDER BY k DESC, event_type) AS r FROM (SELECT win, event_type, count(*) AS k FROM w GROUP BY 1, 2)),
c AS (SELECT win, count(*) AS n, avg(value) AS v, avg(user_id) AS u FROM w GROUP BY win), z AS (SELECT c.*, event_type FROM c JOIN n USING (win) WHERE r = 1 AND c.n = 500)
SELECT b.win, round(1.2 * (abs(a.v - b.v) / 500.0 + abs(a.u - b.u) / 1000.0 + (a.event_type <> b.event_type)::INT) / 3, 9) AS change,
round(1.2 * (abs(a.v - b.v) / 500.0 + abs(a.u - b.u) / 1000.0 + (a.event_type <> b.event_type)::INT) / 3, 9) > CAST(1.36 AS DOUBLE) * sqrt(1000 / 250000.0) AS drift
FROM z a JOIN z b ON b.win = a.win + 1""")
def centroid_shift(spark, d):
    schema = StreamSchema("pos", (EVENTS.quasi[0], Attribute("user", lo=0.0, hi=1000.0), replace(EVENTS.sensitive, weight=1.0)), EVENTS.sensitive)
    e = O.with_position(table(spark, d, "events"), "event_id").select("pos", "value", "event_type", F.col("user_id").cast("double").alias("user"))
    return C.centroid_shift(e, "pos", 500, schema, 1.2, 0.05)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS s, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, i, CASE WHEN t > 50 THEN 0 ELSE n END, CASE WHEN t > 50 THEN 0 ELSE m END, CASE WHEN t > 50 THEN 0 ELSE t END, CASE WHEN t > 50 THEN event_id END FROM (
    SELECT user_id, i, n, m, s * CAST(0.9999 AS DOUBLE) + x - m - CAST(0.005 AS DOUBLE) AS t, event_id FROM (
      SELECT r.user_id, e.i, r.n + 1 AS n, (e.x + r.m * r.n) / (r.n + 1) AS m, r.s, e.x, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, count(hit) AS changes, coalesce(min(hit), -1) AS first_change FROM r GROUP BY user_id""")
def page_hinkley(spark, d):
    return C.page_hinkley(table(spark, d, "events"), "user_id", "event_id", "value")


_PT = f"{_W.format(100)}, f AS (SELECT t.pair, t.tag, t.value AS x, CAST(t.user_id AS DOUBLE) AS y FROM t WHERE pair BETWEEN 1 AND (SELECT max(win) FROM w))"


def _planar(spark, d):
    held = C.paired(_event_windows(spark, d, 100))
    last = F.broadcast(_event_windows(spark, d, 100).agg(F.max("win").alias("last")))
    return held.join(last, (F.col("pair") >= 1) & (F.col("pair") <= F.col("last")))


@query(f"""WITH {_PT}, q AS (SELECT p.pair, p.tag, p.x, p.y, s.tag AS side, avg((s.x <= p.x AND s.y <= p.y)::INT) AS a, avg((s.x <= p.x AND s.y > p.y)::INT) AS b,
  avg((s.x > p.x AND s.y <= p.y)::INT) AS c, avg((s.x > p.x AND s.y > p.y)::INT) AS dd, count(*) AS n FROM f p JOIN f s ON s.pair = p.pair GROUP BY ALL),
g AS (SELECT o.pair, o.tag, o.a - t.a - 1 / (o.n / 1.0) * 1 AS a, o.b - t.b AS b, o.c - t.c AS c, o.dd - t.dd AS dd FROM q o JOIN q t ON o.pair = t.pair AND o.tag = t.tag AND o.x = t.x AND o.y = t.y AND o.side = o.tag AND t.side <> t.tag),
k AS (SELECT pair, tag, count(*) AS n FROM f GROUP BY ALL),
m AS (SELECT g.pair, g.tag, greatest(-min(least(a, b, c, dd)), max(greatest(a, b, c, dd)) + 1.0 / any_value(k.n)) AS d FROM g JOIN k ON k.pair = g.pair AND k.tag = g.tag GROUP BY ALL)
SELECT pair, round(avg(d), 6) AS d FROM m GROUP BY pair""")
def ks2d_stat(spark, d):
    return C.per_pair(_planar(spark, d), ["value", "user"], {"d": "ks2d"}).select("pair", F.round("d", 6).alias("d"))


@query(f"""WITH {_PT}, z AS (SELECT pair, tag, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS x, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS y FROM f WINDOW p AS (PARTITION BY pair)),
k AS (SELECT pair, count(*) FILTER (tag = 0) AS n, count(*) FILTER (tag = 1) AS m FROM f GROUP BY pair),
s AS (SELECT a.pair, a.tag AS ta, b.tag AS tb, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s FROM z a JOIN z b ON a.pair = b.pair AND a.tag <= b.tag GROUP BY ALL)
SELECT pair, round(sum(CASE WHEN ta <> tb THEN s / (n * m) WHEN ta = 0 THEN -s / 2 / (n * n) ELSE -s / 2 / (m * m) END), 6) AS energy FROM s JOIN k USING (pair) GROUP BY pair""")
def energy_stat(spark, d):
    return C.per_pair(_planar(spark, d), ["value", "user"], {"energy": "energy"}).select("pair", F.round("energy", 6).alias("energy"))


@query()
def drift_tests(spark, d):
    """p-values of the planar and the energy test and the principal-axis statistics, one row for each pair of windows."""
    return C.per_pair(_planar(spark, d), ["value", "user"], {"ks2d_p": "ks2d_p", "energy_p": "energy_p", "pca_ks": "pca_ks", "pca_ks_apart": "pca_ks_apart"})


@query()
def adwin_changes(spark, d):
    """Where adaptive windows of each type's rising values were cut."""

    def step():
        window = detectors.Adwin()
        return lambda x: [(window.width, window.mean)] if window.detect(x) else []

    rising = table(spark, d, "events").withColumn("x", F.col("value") + F.col("event_id") * 0.05)
    return C.fold_shards(rising, "event_type", "event_id", ["x"], step, "event_type string, event_id bigint, width bigint, mean double")


# agreement and prequential learners ----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS b, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c), r AS (SELECT a AS v, sum(n) AS x FROM c GROUP BY a), k AS (SELECT b AS v, sum(n) AS y FROM c GROUP BY b),
p AS (SELECT sum(x * y) AS chance FROM r JOIN k USING (v))
SELECT round((same / n - chance / (n * n)) / (1 - chance / (n * n)) * 100, 6) AS kappa FROM t, p""")
def kappa(spark, d):
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return G.kappa(table(spark, d, "lineitem").select("l_returnflag", guess.alias("guess")), "l_returnflag", "guess")


@query("""WITH c AS (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1),
b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(p * (below + q / 2)) / (CAST(sum(p) AS DOUBLE) * sum(q)), 9) AS auc FROM b""")
def auc_rank(spark, d):
    return G.auc(table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_extendedprice", "y")


_B = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_BH = "OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _argmax(columns: dict[str, str]) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"{c} >= {o}" for o in columns.values() if o != c) + f" THEN '{v}'" for v, c in columns.items()) + " END"


@query(f"""WITH c AS (SELECT user_id, event_id, event_type, {", ".join(f"coalesce(sum((event_type = '{v}')::INT) {_B}, 0) AS {v}" for v in EVENTS.sensitive.values)} FROM events)
SELECT user_id, event_id, event_type AS actual, {_argmax({v: v for v in EVENTS.sensitive.values})} AS pred FROM c""")
def prequential_majority(spark, d):
    return G.prequential_majority(table(spark, d, "events"), "user_id", "event_id", "event_type", list(EVENTS.sensitive.values))


@query(f"""WITH c AS (SELECT user_id, event_id, event_type, {", ".join(f"coalesce(sum((event_type = '{v}')::INT) {_B}, 0) AS n_{v}, coalesce(sum((event_type = '{v}')::INT) {_BH}, 0) AS h_{v}" for v in EVENTS.sensitive.values)} FROM events),
s AS (SELECT *, {", ".join(f"round(ln(n_{v} + 1) + ln((h_{v} + 1) / (n_{v} + 2)), 9) AS s_{v}" for v in EVENTS.sensitive.values)} FROM c)
SELECT user_id, event_id, event_type AS actual, {_argmax({v: f"s_{v}" for v in EVENTS.sensitive.values})} AS pred FROM s""")
def prequential_naive_bayes(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return G.prequential_naive_bayes(e, "user_id", "event_id", "event_type", list(EVENTS.sensitive.values), ["hour"])


def _learner(name: str, members: int | None = None) -> Query:
    def run(spark, d):
        lines = table(spark, d, "orders").withColumn("shard", F.pmod("o_custkey", F.lit(8))).withColumn("y", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low"))
        lines = lines.withColumns({"month": F.month("o_orderdate").cast("double"), "price": F.col("o_totalprice") / 1000, "cust": F.col("o_custkey").cast("double")})
        out = C.fold_shards(lines, "shard", "o_orderkey", ["price", "month", "cust", "y"], lambda: Prequential(name, "high"), "shard bigint, o_orderkey bigint, actual string, pred string, score double")
        return G.accuracy(out, "shard")

    return run


for _name in ("sgd", "naive_bayes", "hoeffding_adaptive_tree", "leveraging_bag", "adaptive_random_forest"):
    QUERIES[f"learner_{_name}"] = _learner(_name)


# order, sampling, noise ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, new_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) AS i FROM orders)
JOIN (SELECT o_orderkey AS new_key, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) USING (i)""")
def shuffle_hash(spark, d):
    return O.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5).select("o_orderkey", "new_key")


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n, max(o_orderkey) OVER () AS last FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT last + r, o_custkey, o_totalprice FROM r WHERE r <= floor(n * 0.1)""")
def duplicates_reinserted(spark, d):
    return O.reinsert_duplicates(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 0.1, 5)


@query("""WITH w AS (SELECT o_orderkey, o_custkey, max(o_totalprice) OVER u - min(o_totalprice) OVER u AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders
  WINDOW u AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, round(s, 4) AS sensitivity, round(CASE WHEN n > 3 THEN avg(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) ELSE s END, 4) AS smoothed,
round(0.5 * s / (8 * CAST(0.01 AS DOUBLE)), 4) AS scale FROM w""")
def noise_sensitivity(spark, d):
    o = orders(spark, d).withColumn("s", N.observed_sensitivity(F.col("o_totalprice"), 8, "o_orderkey", ["o_custkey"]))
    smooth = N.moving_average(F.col("s"), 8, "o_orderkey", ["o_custkey"])
    return o.select("o_orderkey", F.round("s", 4).alias("sensitivity"), F.round(smooth, 4).alias("smoothed"), F.round(N.laplace_scale(1, F.col("s"), 8, 0.01), 4).alias("scale"))


@query()
def noise_laplace(spark, d):
    """Clamped noisy prices, two-sided and one-sided."""
    scale = N.laplace_scale(1, F.lit(PRICE.span), 50, 0.1)
    noisy = lambda one: S.clamp(PRICE, F.col("o_totalprice") + N.laplace(scale, 7, F.col("o_orderkey"), one_sided=one))
    return orders(spark, d).select("o_orderkey", "o_totalprice", noisy(False).alias("noisy"), noisy(True).alias("noisy_up"))


@query()
def noise_categorical(spark, d):
    seen = F.array(*[F.lit(v) for v in STATUSES])
    return orders(spark, d).select("o_orderkey", "o_orderstatus", N.replace_category(F.col("o_orderstatus"), seen, 0.1, 1.0, 7, F.col("o_orderkey")).alias("noisy"))


@query()
def suppression(spark, d):
    """A uniform and a kernel draw for the price, a uniform one for the status, per order; the kernel is over the customer's prices."""
    o, key = orders(spark, d), F.col("o_orderkey")
    held = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("o_totalprice"), F.lit(0.0)).alias("spread"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    prices = o.select("o_custkey", nth.alias("at"), F.col("o_totalprice").alias("center"))
    drawn = o.join(held, "o_custkey").withColumn("at", N.kernel_place(F.col("n"), 7, key)).join(prices, ["o_custkey", "at"])
    kernel = N.kernel_step(F.col("center"), F.col("n"), F.col("spread"), PRICE, 7, key)
    return drawn.select("o_orderkey", N.uniform_in_domain(PRICE, 7, key).alias("uniform"), kernel.alias("kernel"), N.uniform_category(STATUS, 7, key).alias("status"))


# the exact anonymizer ------------------------------------------------------------------------------------------------


def _kernel(cfg: AnonymizerConfig, schema: StreamSchema) -> Query:
    def run(spark, d):
        return anonymize(orders(spark, d).withColumn("shard", F.pmod("o_custkey", F.lit(16))), schema, cfg, "shard")

    return run




def _grouped(cfg: AnonymizerConfig) -> Query:
    """The kernel over several open groups; the suppressed values of nominal attributes are random draws and not listed."""

    def run(spark, d):
        out = _kernel(cfg, MIXED)(spark, d)
        shown = lambda n: F.when(F.col("status") == 0, F.col(f"anon_{n}"))
        return out.select("shard", "seq", "publish_time", "pub_seq", "cluster", "status", F.round(F.col("anon_o_totalprice") + 1e-6, 3).alias("price"), F.col("anon_o_custkey").alias("cust"),
                          shown("o_rank").alias("rank"), shown("o_orderstatus").alias("status_value"))

    return run


for _name, _cfg in (("microagg_exact", AnonymizerConfig(k=20, threshold=0.15, delta=20000)), ("microagg_delta", AnonymizerConfig(k=5, l=3, c=2.0, threshold=0.1, delta=400)), ("microagg_gap_rule", AnonymizerConfig(k=5, threshold=0.12, delta=600, gap=True))):
    QUERIES[_name] = _grouped(_cfg)
    ORACLES[_name] = grouping_sql(_cfg.k, _cfg.l, _cfg.c, _cfg.threshold, _cfg.delta, _cfg.gap, 16)
QUERIES["microagg_noisy"] = _kernel(AnonymizerConfig(k=20, threshold=0.3, noise="laplace", eps=1.0, drift="ks", suppress="kernel"), ORDERS)
QUERIES["microagg_gap"] = _kernel(AnonymizerConfig(k=20, threshold=0.15, delta=2000, gap=True, drift="centroid", noise="one_sided", sensitivity="observed", suppress="uniform"), MIXED)


_ONE_GROUP = """WITH o AS (SELECT o_custkey % 16 AS g, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) AS pos, o_orderkey AS seq, o_totalprice AS x, o_orderstatus AS s FROM orders),
m AS (SELECT *, (pos - 1) // 192 AS c, (pos - 1) % 192 + 1 AS j, count(*) OVER (PARTITION BY g, (pos - 1) // 192) AS size FROM o),
u AS (SELECT g, c, j, seq AS at, (first_value(x) OVER w + sum(x) OVER w) / (j + 1) AS cen, sum((s = 'F')::INT) OVER w AS f, sum((s = 'O')::INT) OVER w AS o, sum((s = 'P')::INT) OVER w AS p
  FROM m WINDOW w AS (PARTITION BY g, c ORDER BY j ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN size < 48 THEN size ELSE greatest(j, 48) END AS r FROM m)
SELECT CAST(h.g AS VARCHAR) AS shard, seq, c.at AS publish_time, h.c AS cluster, CASE WHEN size < 48 THEN 1 WHEN greatest(f, o, p) < CAST(2 AS DOUBLE) * least(f, o, p) AND least(f, o, p) > 0 THEN 0 ELSE 2 END AS status,
round(CASE WHEN size >= 48 AND greatest(f, o, p) < CAST(2 AS DOUBLE) * least(f, o, p) AND least(f, o, p) > 0 THEN cen ELSE 300000 END + 1e-6, 3) AS anon
FROM h JOIN u c ON c.g = h.g AND c.c = h.c AND c.j = h.r"""


@query(_ONE_GROUP)
def microagg_exact_one_group(spark, d):
    """The kernel where no distance exceeds the threshold, which SQL can follow."""
    out = _kernel(AnonymizerConfig(k=48, l=3, c=2.0, threshold=2.0), ORDERS)(spark, d)
    return out.select("shard", "seq", "publish_time", "cluster", "status", F.round(F.col("anon_o_totalprice") + 1e-6, 3).alias("anon"))


def _noise_runs(spark, d):
    runs = sweep(list(KS), [2], list(EPSILONS), c=2.0, threshold=2.0, noise="laplace")
    rows = orders(spark, d).withColumn("shard", F.pmod("o_custkey", F.lit(16)))
    known = F.create_map(*[x for r, cfg in runs.items() for x in (F.lit(r), F.struct(F.lit(float(cfg.k)).alias("k"), F.lit(cfg.eps).alias("eps")))])
    return anonymize_runs(rows, ORDERS, runs, "shard").withColumns({"k": known[F.col("run_id")]["k"], "eps": known[F.col("run_id")]["eps"]})


_COUNTS = """count(*) AS n, count(DISTINCT (shard, cluster)) AS opened_clusters, count(*) FILTER (status = 1) AS suppressed_size, count(*) FILTER (status = 2) AS suppressed_diversity,
round(avg(publish_time - seq), 3) AS avg_wait"""


@query(" UNION ALL ".join(f"(SELECT 'k{k}_l2_eps{e:g}' AS run_id, {k}.0::DOUBLE AS k, {e}::DOUBLE AS eps, {_COUNTS} FROM ({_swept(_ONE_GROUP, k)}))" for k in KS for e in EPSILONS))
def noise_sweep_counts(spark, d):
    """All group sizes by all noise levels in one job of the kernel: what does not depend on the noise."""
    flag = lambda s: F.sum((F.col("status") == s).cast("int"))
    return _noise_runs(spark, d).groupBy("run_id", "k", "eps").agg(
        F.count("*").alias("n"), F.countDistinct("shard", "cluster").alias("opened_clusters"), flag(1).alias("suppressed_size"), flag(2).alias("suppressed_diversity"),
        F.round(F.avg(F.col("publish_time") - F.col("seq")), 3).alias("avg_wait"))


@query()
def noise_sweep_losses(spark, d):
    """The same runs: the loss of the published prices, noise included."""
    own = orders(spark, d).select(F.col("o_orderkey").alias("seq"), "o_totalprice")
    gap = (F.col("o_totalprice") - F.col("anon_o_totalprice")) / 600000.0
    shown = F.col("status") == 0
    return _noise_runs(spark, d).join(own, "seq").groupBy("run_id", "k", "eps").agg(
        F.round(F.avg(gap * gap), 9).alias("mse"), F.round(F.avg(F.when(shown, gap * gap)), 9).alias("mse_published"))


@query(_ONE_GROUP)
def microagg_stream(spark, d):
    """The same through the streaming form, with a restart from its checkpoint half-way."""
    from ..streaming.stream import replay

    rows = orders(spark, d).withColumn("shard", F.pmod("o_custkey", F.lit(16)))
    out = replay(rows, ORDERS, AnonymizerConfig(k=48, l=3, c=2.0, threshold=2.0), "shard")
    return out.select("shard", "seq", "publish_time", "cluster", "status", F.round(F.col("anon_o_totalprice") + 1e-6, 3).alias("anon"))


@query()
def microagg_buffered(spark, d):
    """The buffered nearest-neighbour baseline."""
    schema = StreamSchema("o_orderkey", (PRICE, CUSTOMER), ORDERS.sensitive)
    return knn_anonymize(orders(spark, d).withColumn("shard", F.pmod("o_custkey", F.lit(16))), schema, 20, 200, 1.0, "shard")


@query()
def series_smoothed(spark, d):
    """Running metrics with their smoothed values."""
    held = metric_series(spark, d).withColumn("run", F.lit("flagship"))
    return smoothed(held, "run", "mse")


# sources and sinks: what is written is read back ----------------------------------------------------------------------

_ORDER_ROWS = "SELECT o_orderkey, o_totalprice, o_custkey, substr(o_orderpriority, 1, 1) AS o_rank, o_orderstatus, o_orderpriority FROM orders"


def _order_rows(spark, d):
    return orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey", "o_rank", "o_orderstatus", "o_orderpriority")


@query(_ORDER_ROWS)
def csv_round_trip(spark, d):
    path = workspace(spark, "csv")
    W.write_csv(_order_rows(spark, d), path, ["o_orderkey"])
    return Q.read_stream(spark, path, MIXED)


@query(_ORDER_ROWS)
def tsv_round_trip(spark, d):
    path = workspace(spark, "tsv")
    W.write_csv(_order_rows(spark, d), path, sep="\t", header=False)
    return Q.read_tsv(spark, path, MIXED)


@query(f"WITH {_PAIRS} SELECT pub_seq, o_totalprice, sensitive, round(anon + 1e-6, 3) AS anon FROM pairs")
def pairs_round_trip(spark, d):
    path = workspace(spark, "pairs")
    W.write_pairs(pairs(spark, d), ORDERS, path)
    read = lambda side: spark.read.schema("pub_seq bigint, o_totalprice double, sensitive string").option("header", True).csv(f"{path}/{side}")
    anon = read("anonymized").select("pub_seq", F.round(F.col("o_totalprice") + 1e-6, 3).alias("anon"))
    return read("original").join(anon, "pub_seq")


@query(f"WITH {_PAIRS} SELECT pub_seq, printf('%.4f', o_totalprice) || ',' || sensitive AS original, status FROM pairs")
def record_pairs_round_trip(spark, d):
    path, held = workspace(spark, "records"), pairs(spark, d)
    W.write_record_pairs(held.withColumnRenamed("sensitive", "o_orderstatus").withColumn("sensitive", F.col("o_orderstatus")), ORDERS, path)
    lines = spark.read.schema("pub_seq bigint, original string, anonymized string").option("header", True).csv(path)
    middle = F.col("anonymized").startswith("300000.0000,")
    both = lines.join(held.select("pub_seq", "status"), "pub_seq")
    return both.where(middle == (F.col("status") != 0)).select("pub_seq", "original", "status")


@query("SELECT o_orderpriority AS value, 2 * count(*) AS n FROM orders GROUP BY 1")
def text_append_round_trip(spark, d):
    path = workspace(spark, "text")
    for _ in range(2):
        W.append_text(orders(spark, d), "o_orderpriority", path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS status, count(*)::VARCHAR AS n, NULL::VARCHAR AS customers FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, count(*)::VARCHAR, count(DISTINCT o_custkey)::VARCHAR FROM orders GROUP BY 1""")
def appended_rows_round_trip(spark, d):
    """Rows with other fields than those before."""
    path, by = workspace(spark, "rows"), orders(spark, d).groupBy(F.col("o_orderstatus").alias("status"))
    W.append_rows(by.agg(F.count("*").alias("n")), path)
    W.append_rows(by.agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("n")), path)
    return Q.read_rows(spark, path).select("status", "n", "customers")


@query(f"""WITH {_PAIRS}, q AS (SELECT pub_seq AS time, round(avg(pow((o_totalprice - anon) / 600000.0, 2)) {_RUN}, 6) AS mse, round(avg(publish_time - pos) {_RUN}, 6) AS delay FROM pairs)
SELECT 'orders@48_0.01_3_MSE' AS run, time, mse AS metric FROM q WHERE time % 100 = 0 UNION ALL SELECT 'orders@48_0.01_3_Mean Delay', time, delay FROM q WHERE time % 100 = 0""")
def series_round_trip(spark, d):
    path, held = workspace(spark, "series"), metric_series(spark, d)
    for name, column in (("MSE", "mse"), ("Mean Delay", "delay")):
        W.write_series(held.select(F.lit(W.series_name("orders", FLAGSHIP, name)).alias("run"), "time", F.col(column).alias("metric")), path)
    return Q.read_series(spark, path)


@query(f"""WITH c AS (SELECT user_id, event_id, event_type, {", ".join(f"coalesce(sum((event_type = '{v}')::INT) {_B}, 0) AS {v}" for v in EVENTS.sensitive.values)} FROM events)
SELECT {_argmax({v: v for v in EVENTS.sensitive.values})} AS pred, event_type AS actual, count(*) AS n FROM c GROUP BY ALL""")
def predictions_round_trip(spark, d):
    path = workspace(spark, "predictions")
    W.write_csv(prequential_majority(spark, d).select("pred", "actual"), path, header=False)
    return Q.read_predictions(spark, path).groupBy("pred", "actual").agg(F.count("*").alias("n"))


@query("SELECT max_by(event_type, event_id) AS event_type, max_by(user_id, event_id)::VARCHAR AS user_id, '?' AS kappa FROM events")
def measures_last(spark, d):
    return Q.last_measures(table(spark, d, "events"), ["event_type", "user_id", "kappa"], "event_id")


_HOURS = StreamSchema("event_id", (EVENTS.quasi[0], Attribute("hour", discrete=True, lo=0, hi=23)), EVENTS.sensitive)


@query("""SELECT unnest(['@relation events', '', '@attribute value numeric', '@attribute hour {' || (SELECT string_agg(h::VARCHAR, ',' ORDER BY h) FROM (SELECT DISTINCT hour(ts) AS h FROM events)) || '}',
  '@attribute event_type {click,error,purchase,signup,view}', '', '@data']) AS line UNION ALL SELECT printf('%.4f', value) || ',' || hour(ts) || ',' || event_type FROM events""")
def arff_round_trip(spark, d):
    """With a numeric attribute declared by its values."""
    path = workspace(spark, "arff")
    W.write_arff(table(spark, d, "events").withColumn("hour", F.hour("ts").cast("bigint")), _HOURS, path, "events", "event_id", ["hour"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT o_orderkey, o_totalprice BETWEEN 50000 AND 200000 AS price_ok, o_totalprice = floor(o_totalprice) AND o_totalprice BETWEEN 50000 AND 200000 AS whole_ok, o_orderstatus IN ('F', 'O') AS status_ok FROM orders""")
def type_validation(spark, d):
    a, price = replace(PRICE, lo=50000.0, hi=200000.0), F.col("o_totalprice")
    return orders(spark, d).select("o_orderkey", S.valid(a, price).alias("price_ok"), S.valid(replace(a, discrete=True), price).alias("whole_ok"), S.valid(replace(STATUS, values=("F", "O")), F.col("o_orderstatus")).alias("status_ok"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return microagg_single_cluster(spark, d)

"""URL rules by a sort-merge range join, with DataFrame operations only.

A rule (host, path) covers the host, its subdomains, and every path that begins with the rule's. Its
canonical key is ``length of the path + path + reversed host labels``, each label closed by a dot; the length has a fixed width, so
path and host can't run into each other whatever characters they hold. Of all keys with that path, those of the host's subtree are
one interval [key, key with its last dot raised). A url is probed for each length of a rule path that rules for its host or
a parent domain have: its path cut to that length, then its reversed host. So every "is covered by" question is "which intervals
hold this key".

Intervals of prefixes nest or are disjoint. One fold over the sorted interval ends keeps a stack of
the open rules and yields disjoint segments, each with the rule on top of the stack: the longest
host of that layer. The probes and the segment starts are then sorted together, and a running
``last_value`` carries the segment that is open when a probe is met. This sweep runs separately in
``shards`` hash shards of the urls, each with all the segments, so that a hot host spreads evenly.
The rules (bounded by MAX_RULES, checked) are replicated to the shards; the urls are sorted once.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; the
default verdict is allow; of several covering rules the longest host + path wins, then the longer
host, then the earlier rule in the list; repeated pages are judged one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The rules are replicated to every shard and folded in one row, so their number is bounded.
MAX_RULES = 10_000
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def reversed_host(host: str) -> str:
    """SQL for the labels of a host from the last to the first, each closed by a dot."""
    return f"concat(array_join(reverse(split({host}, '[.]', -1)), '.'), '.')"


def key(size: str, path: str) -> str:
    """SQL for the canonical key of the column host and a path of ``size`` characters."""
    return f"concat(lpad({size}, 10, '0'), {path}, {reversed_host('host')})"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = f"substring({url}, instr({url}, '://') + 3)"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    has = f"{url} IS NOT NULL AND instr({url}, '://') > 0"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return F.expr(f"CASE WHEN {has} THEN {_LOW.format(host)} ELSE '' END"), F.expr(f"CASE WHEN {has} THEN {path} ELSE '' END")


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are replicated")
    rows = [F.struct(F.lit(i).alias("rule_id"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for i, (v, h, p) in enumerate(rules)]
    none = F.from_json(F.lit("[]"), "array<struct<rule_id:int,verdict:string,host:string,path:string>>")
    df = spark.range(1).select(F.inline(F.array(*rows) if rows else none))
    return df.select("*", F.expr(key("length(path)", "path")).alias("lo")).withColumn(
        "hi", F.expr("concat(substring(lo, 1, length(lo) - 1), '/')")
    )


def segments(rules: DataFrame) -> DataFrame:
    """(start, rule_id): from ``start`` on, up to the next start, this rule is the innermost (null: none).

    The fold's state is (stack of (hi, rule_id), segments so far): before a rule opens, those on the stack that
    end at or before its lo are closed, one segment each; at the end all are closed."""
    # of equal intervals the first rule counts
    first = rules.groupBy("lo", "hi").agg(F.min("rule_id").alias("rule_id"))
    events = first.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "rule_id"))).alias("e"))
    top = "IF(size({0}) > 0, element_at({0}, -1).rule_id, CAST(NULL AS INT))"
    close = """aggregate(
        reverse(filter({stack}, s -> s.hi <= {at})),
        named_struct('stack', {stack}, 'segs', {segs}),
        (a, s) -> named_struct(
            'stack', slice(a.stack, 1, size(a.stack) - 1),
            'segs', concat(a.segs, array(named_struct('start', s.hi, 'rule_id',
                IF(size(a.stack) > 1, element_at(a.stack, -2).rule_id, CAST(NULL AS INT)))))))"""
    empty = "CAST(array() AS array<struct<hi:string,rule_id:int>>)", "CAST(array() AS array<struct<start:string,rule_id:int>>)"
    fold = f"""aggregate(e, named_struct('stack', {empty[0]}, 'segs', {empty[1]}),
        (acc, r) -> transform(array({close.format(stack='acc.stack', segs='acc.segs', at='r.lo')}),
            c -> named_struct('stack', concat(c.stack, array(named_struct('hi', r.hi, 'rule_id', r.rule_id))),
                              'segs', concat(c.segs, array(named_struct('start', r.lo, 'rule_id', r.rule_id)))))[0],
        acc -> {close.format(stack='acc.stack', segs='acc.segs', at="'\U0010ffff'")}.segs)"""
    flat = events.select(F.posexplode(F.expr(fold)).alias("pos", "s")).select("pos", "s.start", "s.rule_id")
    # where a segment closes and another opens at one key, the later one counts
    return flat.groupBy("start").agg(F.max_by("rule_id", "pos").alias("rule_id"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], shards: int | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path("url")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    named = rule_frame(spark, rules)
    shard = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(shards)).cast("int").alias("shard")
    # the host and its parent domains, down to as many labels as a rule's host has at most; those with rules give the lengths to probe
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    parents = F.expr(f"transform(sequence(greatest(size(labels) - {most}, 0), size(labels) - 1), i -> array_join(slice(labels, i + 1, size(labels) - i), '.'))")
    lengths = named.groupBy(F.col("host").alias("parent")).agg(F.collect_set(F.length("path")).alias("lengths"))
    rows = urls.select("page_id", "host", "path", shard, F.monotonically_increasing_id().alias("row"), F.expr("split(host, '[.]', -1)").alias("labels"))
    rows = rows.select("page_id", "host", "path", "shard", "row", F.posexplode(parents).alias("nth", "parent"))
    rows = rows.join(F.broadcast(lengths), "parent", "left")  # at most MAX_RULES rows, checked in rule_frame
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    probes = rows.select("*", F.explode_outer(fitting).alias("cut")).where("cut IS NOT NULL OR nth = 0")
    probes = probes.select(
        "shard", F.coalesce(F.expr(key("cut", "substring(path, 1, cut)")), F.lit("")).alias("at"), F.lit(1).alias("kind"),
        "page_id", "host", "path", "row", F.lit(None).cast("int").alias("rule_id"),
    )
    starts = segments(named).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("start").alias("at"), F.lit(0).alias("kind"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("bigint").alias("row"), F.coalesce("rule_id", F.lit(-1)).alias("rule_id"),
    )
    sweep = Window.partitionBy("shard").orderBy("at", "kind")
    open_rule = F.last("rule_id", ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    swept = starts.unionByName(probes).select("*", open_rule.alias("open")).where("kind = 1")
    facts = named.select(
        F.col("rule_id").alias("open"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (-F.col("rule_id")).alias("order"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("fact"),
    )
    met = swept.join(F.broadcast(facts), "open", "left")  # at most MAX_RULES rows, checked above
    best = met.groupBy("shard", "row", "page_id", "host", "path").agg(F.max("fact").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH rules(n, verdict, host, path) AS (VALUES (0, 'allow', 'com', '/'), (1, 'block', 'example.com', '/en/'),
    (2, 'allow', 'www.example.com', '/en/'), (3, 'block', 'net', '/es/'), (4, 'block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS row, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0, 's'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
m AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.row ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.n) AS k
      FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

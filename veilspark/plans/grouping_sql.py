"""The order-dependent anonymizer as recursive SQL: one step for each record of all shards, the open groups as a list. For tests and
oracles on small tables."""

from __future__ import annotations

_GROUP = "STRUCT(id BIGINT, size BIGINT, p DOUBLE, k DOUBLE, pr BIGINT[], st BIGINT[], wait BIGINT[], newest BIGINT)"
_SHOWN = "STRUCT(seq BIGINT, cluster BIGINT, status INTEGER, p DOUBLE, k DOUBLE, pr BIGINT, st BIGINT)"


def grouping_sql(k: int, l: int, c: float, threshold: float, delta: int, gap: bool, shards: int) -> str:  # noqa: E741
    """SQL for orders with price, customer, priority and status as quasi-identifiers and the priority as the sensitive value too."""
    distance = "(((1.0::DOUBLE * abs(x - g.p) / 600000.0::DOUBLE + 2.0::DOUBLE * abs(cu - g.k) / 15000.0::DOUBLE) + 0.25::DOUBLE * abs(rk - list_position(g.pr, list_max(g.pr))) / 16.0::DOUBLE) + CASE WHEN st = list_position(g.st, list_max(g.st)) THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END) / 3.75::DOUBLE"
    raw = "sqrt((((x - g.p) * (x - g.p) + (cu - g.k) * (cu - g.k)) + (rk <> list_position(g.pr, list_max(g.pr)))::INT::DOUBLE) + (st <> list_position(g.st, list_max(g.st)))::INT::DOUBLE)"
    diverse = f"len(list_filter(g.pr, lambda n: n > 0)) >= {l} AND list_max(g.pr) < {c}::DOUBLE * list_sum(list_slice(list_reverse_sort(g.pr), {l}, 5))"
    status = f"CASE WHEN g.size < {k} THEN 1 WHEN {diverse} THEN 0 ELSE 2 END"
    shown = f"list_transform(list_reverse(g.wait), lambda w: {{'seq': w, 'cluster': g.id, 'status': {status}, 'p': g.p, 'k': g.k, 'pr': list_position(g.pr, list_max(g.pr)), 'st': list_position(g.st, list_max(g.st))}})"
    numbered = "list_transform(range(1, len({0}) + 1), lambda n: {{'pub_seq': published + n, 'publish_time': {1}, 'r': {0}[n]}})"
    expired = "false" if gap else f"len(g.wait) > 0 AND o.seq - g.wait[1] >= {delta}"
    late = f"seq - near.newest >= {delta}" if gap else "false"
    count = lambda name, n, own: f"list_transform(range(1, {n + 1}), lambda j: g.{name}[j] + ({own} = j)::BIGINT)"
    return f"""WITH RECURSIVE o AS (SELECT o_custkey % {shards} AS shard, o_orderkey AS seq, o_totalprice AS x, o_custkey::DOUBLE AS cu, substr(o_orderpriority, 1, 1)::BIGINT AS rk,
  list_position(['F', 'O', 'P'], o_orderstatus)::BIGINT AS st, row_number() OVER (PARTITION BY o_custkey % {shards} ORDER BY o_orderkey) AS i FROM orders),
r AS (
  SELECT DISTINCT shard, 0::BIGINT AS i, 0::BIGINT AS seq, []::{_GROUP}[] AS groups, 0::BIGINT AS opened, 0::BIGINT AS published, []::{_SHOWN}[] AS shown FROM o
  UNION ALL
  SELECT shard, i, seq, CASE WHEN u.size >= {4 * k} THEN list_filter(kept, lambda g: g.id <> u.id) WHEN fresh THEN list_append(kept, u)
      ELSE list_transform(kept, lambda g: CASE WHEN g.id = u.id THEN u ELSE g END) END::{_GROUP}[], opened + fresh::BIGINT, published, shown::{_SHOWN}[]
  FROM (SELECT shard, i, seq, kept, fresh, opened, published, list_concat(flatten(list_transform(gone, lambda g: {shown})), CASE WHEN full_ THEN list_transform([u], lambda g: {shown})[1] ELSE [] END) AS shown,
      CASE WHEN full_ THEN {{'id': u.id, 'size': u.size, 'p': u.p, 'k': u.k, 'pr': u.pr, 'st': u.st, 'wait': []::BIGINT[], 'newest': u.newest}} ELSE u END AS u
    FROM (SELECT *, u.size >= {k} AS full_ FROM (SELECT shard, i, seq, kept, gone, fresh, opened, published, list_transform([g0], lambda g: {{'id': g.id, 'size': g.size + 1,
        'p': CASE WHEN g.size = 0 THEN x ELSE (g.p * (g.size + 1) + x) / (g.size + 2) END, 'k': CASE WHEN g.size = 0 THEN cu ELSE (g.k * (g.size + 1) + cu) / (g.size + 2) END,
        'pr': {count("pr", 5, "rk")}, 'st': {count("st", 3, "st")}, 'wait': list_append(g.wait, seq), 'newest': seq}})[1] AS u
      FROM (SELECT *, CASE WHEN late THEN [near] ELSE expired END AS gone, CASE WHEN late THEN list_filter(open, lambda g: g.id <> near.id) ELSE open END AS kept, near IS NULL OR late AS fresh,
          CASE WHEN near IS NULL OR late THEN {{'id': opened, 'size': 0, 'p': 0, 'k': 0, 'pr': [0, 0, 0, 0, 0], 'st': [0, 0, 0], 'wait': [], 'newest': 0}}::{_GROUP} ELSE near END AS g0
        FROM (SELECT *, coalesce({late}, false) AS late FROM (SELECT *, list_filter(open, lambda g: g.id = best.id)[1] AS near
          FROM (SELECT *, list_sort(list_transform(list_filter(open, lambda g: {distance} <= {threshold}::DOUBLE), lambda g: {{'raw': {raw}, 'id': g.id}}))[1] AS best
            FROM (SELECT r.shard, o.i, o.seq, o.x, o.cu, o.rk, o.st, r.opened, r.published + len(r.shown) AS published, list_filter(r.groups, lambda g: {expired}) AS expired,
                list_filter(r.groups, lambda g: NOT ({expired})) AS open FROM r JOIN o ON o.shard = r.shard AND o.i = r.i + 1))))))))
),
last AS (SELECT shard, max(i) AS i FROM r GROUP BY shard),
flushed AS (SELECT shard, seq, published + len(shown) AS published, flatten(list_transform(groups, lambda g: {shown})) AS shown FROM r JOIN last USING (shard, i)),
out AS (SELECT shard, unnest({numbered.format("shown", "seq")}) AS e FROM r UNION ALL SELECT shard, unnest({numbered.format("shown", "seq")}) FROM flushed)
SELECT shard::VARCHAR AS shard, e.r.seq AS seq, e.publish_time AS publish_time, e.pub_seq AS pub_seq, e.r.cluster AS cluster, e.r.status AS status,
  round(CASE WHEN e.r.status = 0 THEN e.r.p ELSE 300000 END + 1e-6, 3) AS price, CASE WHEN e.r.status = 0 THEN trunc(e.r.k)::BIGINT ELSE 7500 END AS cust,
  CASE WHEN e.r.status = 0 THEN e.r.pr::VARCHAR END AS rank, CASE WHEN e.r.status = 0 THEN ['F', 'O', 'P'][e.r.st] END AS status_value FROM out"""

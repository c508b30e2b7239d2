"""Queries over pools, rankings and paired ledgers with planted faults, and approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ann, ledgers
from .base import DEPTH, once, query, table
from .retrieval_queries import asked_vectors

# Line items make the pool of an order, in order of their numbers. Orders of nine kinds, by key, hold a fault in the observed pool.
POOL_SQL = """p AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS rank, l_partkey * 100 + l_suppkey AS item FROM lineitem),
n AS (SELECT k, count(*) AS n FROM p GROUP BY 1),
o AS (SELECT p.k, CASE WHEN p.k % 10 = 1 AND n >= 2 AND rank <= 2 THEN 3 - rank WHEN p.k % 10 = 3 THEN rank + 1 ELSE rank END AS rank,
  CASE WHEN p.k % 10 = 4 AND rank = 1 THEN -1 WHEN p.k % 10 = 5 AND rank = 2 THEN (SELECT item FROM p q WHERE q.k = p.k AND q.rank = 1) ELSE item END AS item
  FROM p JOIN n ON n.k = p.k WHERE NOT (p.k % 10 = 2 AND rank = n) AND p.k % 10 <> 6)"""


@once("pools")
def pool_rows(spark: SparkSession, sf: str) -> DataFrame:
    """question, rank, item of the pools as they should be, with each pool's size n and its first item."""
    lines = table(spark, sf, "lineitem").withColumn("item", F.col("l_partkey") * 100 + F.col("l_suppkey"))
    whole = ledgers.ranked_items(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "item").withColumnRenamed("l_orderkey", "question")
    pool = Window.partitionBy("question")
    return whole.withColumn("n", F.count("*").over(pool)).withColumn("first", F.max(F.when(F.col("rank") == 1, F.col("item"))).over(pool))


def pools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The pools as they should be and as they were observed. Lines are exchanged once, for the table that both are read from."""
    rows = pool_rows(spark, sf)
    kind, rank = F.col("question") % 10, F.col("rank")
    whole = rows.select("question", "rank", "item")
    seen = rows.where(F.col("question").isNotNull() & ~((kind == 2) & (rank == F.col("n"))) & (kind != 6))
    moved = F.when((kind == 1) & (F.col("n") >= 2) & (rank <= 2), 3 - rank).when(kind == 3, rank + 1).otherwise(rank)
    other = F.when((kind == 4) & (rank == 1), -1).when((kind == 5) & (rank == 2), F.col("first")).otherwise(F.col("item"))
    return whole, seen.select("question", moved.alias("rank"), other.alias("item"))


@query(
    f"""WITH {POOL_SQL}, c AS (SELECT k, count(*) AS n, count(DISTINCT item) AS kinds, count(DISTINCT rank) AS ranks, min(rank) AS low, max(rank) AS high FROM o GROUP BY 1)
SELECT k AS question, 'no pool' AS problem FROM n WHERE k NOT IN (SELECT k FROM o) AND k % 7 <> 0 UNION SELECT k, 'not asked' FROM o WHERE k % 7 = 0 UNION SELECT k, 'unknown item' FROM o WHERE item < 0
UNION SELECT k, 'repeated item' FROM c WHERE kinds < n UNION SELECT k, 'ranks' FROM c WHERE low <> 1 OR high <> n OR ranks <> n UNION SELECT c.k, 'size' FROM c JOIN n ON n.k = c.k WHERE c.n <> n.n AND c.k % 7 <> 0"""
)
def pool_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh order is not asked for."""
    whole, seen = pools(spark, sf)
    asked = whole.groupBy("question").agg(F.count("*").alias("size")).where("question % 7 <> 0")
    return ledgers.pool_violations(seen, asked, whole.select("item").distinct())


@query(
    f"""WITH {POOL_SQL}, d AS (SELECT coalesce(o.k, p.k) AS k, coalesce(o.rank, p.rank) AS rank FROM o FULL JOIN p ON p.k = o.k AND p.rank = o.rank WHERE o.item IS DISTINCT FROM p.item),
b AS (SELECT a.k, a.l = coalesce(b.l, []) AS same FROM (SELECT k, list_sort(list(item)) AS l FROM p GROUP BY 1) a LEFT JOIN (SELECT k, list_sort(list(item)) AS l FROM o GROUP BY 1) b ON b.k = a.k)
SELECT d.k AS question, CAST(min(rank) AS INT) AS first_rank, any_value(same) AS same_items FROM d JOIN b ON b.k = d.k GROUP BY 1"""
)
def pool_differences(spark: SparkSession, sf: str) -> DataFrame:
    whole, seen = pools(spark, sf)
    return ledgers.pool_differences(seen, whole)


@query(
    f"""WITH {POOL_SQL}, s AS (SELECT o_orderkey AS q, unnest([1, 2]) AS a, o_totalprice AS l FROM orders),
rq AS (SELECT q, a, CASE WHEN q % 13 = 5 AND a = 2 THEN 'failed' ELSE 'success' END AS st, l FROM s WHERE NOT (q % 11 = 3 AND a = 2) UNION ALL SELECT q, 3, 'success', l FROM s WHERE q % 17 = 4 AND a = 1 UNION ALL SELECT q, a, 'success', l FROM s WHERE q % 19 = 6 AND a = 1),
rk AS (SELECT q, a, CASE WHEN q % 13 = 5 AND a = 2 THEN 'failed' ELSE 'success' END AS st, CASE WHEN q % 23 = 7 THEN l + 1 ELSE l END AS l FROM s),
pl AS (SELECT k AS q, a, item FROM p, (SELECT unnest([1, 2]) AS a) x WHERE rank <= 3 AND NOT (k % 13 = 5 AND a = 2)),
od AS (SELECT o.k AS q, a, o.item FROM o, (SELECT unnest([1, 2]) AS a) x WHERE rank <= 3 AND NOT (o.k % 13 = 5 AND a = 2)),
pc AS (SELECT q, a, count(*) AS n, count(DISTINCT item) AS kinds, list_sort(list(item)) AS bag FROM pl GROUP BY 1, 2), oc AS (SELECT q, a, list_sort(list(item)) AS bag FROM od GROUP BY 1, 2)
SELECT q AS "query", CAST(a AS INT) AS attempt, problem FROM (
SELECT q, a, 'request missing' AS problem FROM s WHERE q % 11 = 3 AND a = 2 UNION SELECT q, a, 'request repeated' FROM s WHERE q % 19 = 6 AND a = 1 UNION SELECT q, 3, 'request not scheduled' FROM s WHERE q % 17 = 4
UNION SELECT rq.q, rq.a, 'ledgers disagree' FROM rq JOIN rk ON rk.q = rq.q AND rk.a = rq.a WHERE rq.st <> rk.st OR rq.l <> rk.l
UNION SELECT q, a, 'no pool' FROM rk WHERE st = 'success' AND NOT EXISTS (SELECT 1 FROM pc WHERE pc.q = rk.q AND pc.a = rk.a)
UNION SELECT q, a, 'pool size' FROM pc WHERE n <> 3 UNION SELECT q, a, 'repeated item' FROM pc WHERE kinds < n UNION SELECT q, a, 'forbidden item' FROM pl WHERE item % 29 = 1
UNION SELECT pc.q, pc.a, 'no permutation' FROM pc JOIN oc ON oc.q = pc.q AND oc.a = pc.a WHERE pc.bag <> oc.bag)"""
)
def ranking_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Two attempts an order: pools are its first three items, orders of them the observed ones; ledgers have gaps, repeats and changes."""
    q, a = F.col("query"), F.col("attempt")
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.col("o_totalprice").alias("latency"))
    broken = (q % 13 == 5) & (a == 2)
    kept = plan.withColumn("status", F.when(broken, "failed").otherwise("success"))
    more = kept.where((q % 17 == 4) & (a == 1)).withColumn("attempt", F.lit(3)).withColumn("status", F.lit("success"))
    again = kept.where((q % 19 == 6) & (a == 1)).withColumn("status", F.lit("success"))
    requests = kept.where(~((q % 11 == 3) & (a == 2))).unionByName(more).unionByName(again)
    rankings = kept.withColumn("latency", F.col("latency") + F.when(q % 23 == 7, 1).otherwise(0))
    whole, seen = pools(spark, sf)
    twice = lambda df: df.where("rank <= 3").select(F.col("question").alias("query"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), "rank", "item").where(~broken)
    allowed = whole.select("item").distinct().where("item % 29 <> 1")
    return ledgers.ranking_problems(requests, rankings, twice(whole), twice(seen), plan.select("query", "attempt"), allowed, 3)


@query(
    """WITH e AS (SELECT 'c' || user_id % 40 AS condition, user_id % 40 AS c, event_id // 2 AS slot, event_id % 2 AS side, 'g' || user_id AS g, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS st, value FROM events),
l AS (SELECT condition, c, slot, g, st, value FROM e WHERE side = 0 AND NOT (c = 1 AND slot % 50 = 3) UNION ALL SELECT condition, c, slot, g, st, value FROM e WHERE side = 0 AND c = 2 AND slot % 50 = 3),
r AS (SELECT condition, c, slot, CASE WHEN c = 5 THEN 'other' ELSE g END AS g, CASE WHEN c = 4 AND slot % 50 = 7 THEN 'not_executed' WHEN value > 90 THEN 'failed' ELSE 'success' END AS st, value * 1.5 AS value FROM e WHERE side = 0
  UNION ALL SELECT condition, c, -slot - 1, g, 'success', value FROM e WHERE side = 0 AND c = 3 AND slot % 50 = 3),
s AS (SELECT DISTINCT condition, c, slot FROM e WHERE side = 0),
f AS (SELECT condition, min(p) AS p FROM (SELECT condition, 0 AS p FROM r WHERE slot < 0 UNION ALL SELECT s.condition, 1 FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.condition = s.condition AND l.slot = s.slot)
  UNION ALL SELECT condition, 2 FROM l GROUP BY condition, slot HAVING count(*) > 1 UNION ALL SELECT condition, 3 FROM r WHERE st = 'not_executed' UNION ALL SELECT r.condition, 4 FROM r JOIN l ON l.condition = r.condition AND l.slot = r.slot WHERE l.g <> r.g) GROUP BY 1),
a AS (SELECT condition, avg(CASE WHEN st = 'failed' THEN 1.0 ELSE 0 END) AS err, quantile_cont(value, 0.5) FILTER (st = 'success') AS p50, quantile_cont(value, 0.95) FILTER (st = 'success') AS p95 FROM l GROUP BY 1),
b AS (SELECT condition, avg(CASE WHEN st = 'failed' THEN 1.0 ELSE 0 END) AS err, quantile_cont(value, 0.5) FILTER (st = 'success') AS p50, quantile_cont(value, 0.95) FILTER (st = 'success') AS p95 FROM r GROUP BY 1)
SELECT s.condition, count(*) AS scheduled, any_value(f.p) IS NULL AS complete, CASE any_value(f.p) WHEN 0 THEN 'not scheduled' WHEN 1 THEN 'missing' WHEN 2 THEN 'repeated' WHEN 3 THEN 'not executed' WHEN 4 THEN 'source groups differ' END AS reason,
  round(CASE WHEN any_value(f.p) IS NULL THEN any_value(a.err) - any_value(b.err) END, 6) AS error_rate, round(CASE WHEN any_value(f.p) IS NULL THEN any_value(a.p50) - any_value(b.p50) END, 6) AS p50, round(CASE WHEN any_value(f.p) IS NULL THEN any_value(a.p95) - any_value(b.p95) END, 6) AS p95
FROM s LEFT JOIN f ON f.condition = s.condition LEFT JOIN a ON a.condition = s.condition LEFT JOIN b ON b.condition = s.condition GROUP BY s.condition"""
)
def paired_operational(spark: SparkSession, sf: str) -> DataFrame:
    """Every second event is a slot of one of forty conditions; the right side is half as slow again and fails otherwise. Five conditions hold a fault each."""
    c, slot = F.col("c"), F.col("slot")
    e = table(spark, sf, "events").where("event_id % 2 = 0").select((F.col("user_id") % 40).alias("c"), F.floor(F.col("event_id") / 2).alias("slot"), F.concat(F.lit("g"), F.col("user_id")).alias("source_group"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("latency"))
    e = e.withColumn("condition", F.concat(F.lit("c"), c))
    left = e.where(~((c == 1) & (slot % 50 == 3))).unionByName(e.where((c == 2) & (slot % 50 == 3)))
    status = F.when((c == 4) & (slot % 50 == 7), "not_executed").when(F.col("latency") > 90, "failed").otherwise("success")
    right = e.withColumn("status", status).withColumn("latency", F.col("latency") * 1.5).withColumn("source_group", F.when(c == 5, "other").otherwise(F.col("source_group")))
    right = right.unionByName(e.where((c == 3) & (slot % 50 == 3)).withColumn("slot", -slot - 1).withColumn("status", F.lit("success")))
    out = ledgers.paired_operational(left, right, e.select("condition", "slot"))
    return out.select("condition", "scheduled", "complete", "reason", *[F.round(x, 6).alias(x) for x in ("error_rate", "p50", "p95")])


@query()
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted lists, about the root of the table's rows; as many are probed as a recall of 0.95 takes on a sample."""
    vectors, asked = asked_vectors(spark, sf)
    centroids = ann.fit(vectors, max(8, min(4_096, int(vectors.count() ** 0.5))))
    return ann.search(vectors, asked, centroids, DEPTH, ann.probes_for(vectors, centroids, DEPTH, 0.95))


@query(
    """SELECT 'record' AS kind, vec_id AS id, 'dimension' AS problem FROM embeddings WHERE vec_id % 17 = 3 UNION ALL SELECT 'record', vec_id, 'not finite' FROM embeddings WHERE vec_id % 17 <> 3 AND vec_id % 19 = 4
UNION ALL SELECT 'record', vec_id, 'zero vector' FROM embeddings WHERE vec_id % 17 <> 3 AND vec_id % 19 <> 4 AND vec_id % 23 = 5 UNION ALL SELECT 'record', vec_id, 'repeated id' FROM embeddings WHERE vec_id % 29 = 6
UNION ALL SELECT 'query', vec_id, 'no vector' FROM embeddings WHERE vec_id % 25 = 0 AND vec_id % 3 = 1 UNION ALL SELECT 'query', vec_id, 'unknown target' FROM embeddings WHERE vec_id % 25 = 0 AND vec_id % 4 = 1"""
)
def workload_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of which some are cut, hold NaN, are zero or come twice; every 25th asks for itself, some without vector or for nothing."""
    i, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    bad = F.concat(F.array(F.lit(float("nan"))), F.slice(e, 2, F.size(e)))
    vector = F.when(i % 17 == 3, F.slice(e, 1, F.size(e) - 1)).when(i % 19 == 4, bad).when(i % 23 == 5, F.transform(e, lambda x: F.lit(0.0))).otherwise(e)
    rows = table(spark, sf, "embeddings")
    records = rows.select(i.alias("id"), vector.alias("vector"))
    asked = rows.where(i % 25 == 0).select(i.alias("id"), F.when(i % 3 != 1, e).alias("vector"), F.when(i % 4 == 1, -i - 1).otherwise(i).alias("target"))
    return ledgers.workload_problems(records.unionByName(records.where("id % 29 = 6")), asked, 64)

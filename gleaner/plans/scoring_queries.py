"""Queries over contexts, citations, filters, schedules and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching, metrics, scoring
from .base import CHUNKS_SQL, GOLD_SQL, micros, query, table
from .ledger_queries import LEDGER_SQL, RESULT_SQL, ledger, results
from .retrieval_queries import BM25_SQL, COVER_SQL, DENSE_SQL, cover_frame, dense, hit_texts, lexical, lexical_hits


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events WHERE len(json_keys(props)) > 0")
def json_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("key", F.get(F.json_object_keys("props"), F.lit(0))).where("key is not null")
    return rows.select("event_id", F.expr("get_json_object(props, concat('$.', key))").alias("first_value"))


@query("SELECT doc_id, sha256(CASE WHEN trim(source) <> '' THEN source ELSE text END) AS source_id, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS format FROM documents WHERE trim(text) <> ''")
def ingest_normalize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(F.btrim("text") != "")
    return docs.select("doc_id", tx.source_id(F.col("source"), F.col("text")).alias("source_id"), F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("format"))


@query("SELECT conv_id, string_agg('[' || turn || '] source=' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1".replace("SELECT conv_id, string_agg", "SELECT conv_id AS query_id, string_agg"))
def context_render(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.render_context(table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("source"), "text"))


@query(f"WITH {CHUNKS_SQL}, {GOLD_SQL}, {COVER_SQL}, {BM25_SQL} SELECT query_id, 'E' || rank AS label, count(unit) AS gold_units, substr(sha256(CAST(position AS VARCHAR)), 1, 16) AS identity FROM bm LEFT JOIN cover ON question = query_id AND chunk = position WHERE rank <= 5 GROUP BY query_id, rank, position")
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    units = cover_frame(spark, sf).groupBy(F.col("question").alias("query_id"), F.col("chunk").alias("position")).agg(F.count("*").alias("gold_units"))
    rows = lexical(spark, sf).where("rank <= 5").join(units, ["query_id", "position"], "left")
    return rows.select("query_id", F.concat(F.lit("E"), "rank").alias("label"), F.coalesce("gold_units", F.lit(0)).alias("gold_units"), F.substring(F.sha2(F.col("position").cast("string"), 256), 1, 16).alias("identity"))


@query(f"WITH {DENSE_SQL} SELECT d.query_id, d.vec_id, e.label <> d.query_id % 10 AS violates FROM dense d JOIN embeddings e USING (vec_id) WHERE rank <= 10")
def hit_filter_violations(spark: SparkSession, sf: str) -> DataFrame:
    hits = scoring.filter_violations(dense(spark, sf, limit=10), table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", {"label": F.col("query_id") % 10})
    return hits.select("query_id", "vec_id", "violates")


@query()
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = lexical_hits(spark, sf)
    pool = hits.join(hit_texts(spark, sf, hits).withColumnRenamed("chunk", "text"), "position").join(F.broadcast(items) if items.count() <= 10_000 else items, "query_id")
    return scoring.rerank(pool.withColumnRenamed("position", "item")).select("query_id", "item", "rank", "new_rank")


@query(f"WITH {CHUNKS_SQL}, {BM25_SQL} SELECT query_id, count(*) AS pool, count(DISTINCT position) AS kinds FROM bm GROUP BY 1")
def rerank_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """A reranked pool holds the same items once each: counts of the full outer join of both."""
    pool = lexical(spark, sf).select("query_id", F.col("position").alias("item"))
    both = pool.join(reranked(spark, sf).select("query_id", "item", "new_rank"), ["query_id", "item"], "full_outer")
    return both.groupBy("query_id").agg(F.count("*").alias("pool"), F.countDistinct("item").alias("kinds"))


@query()
def embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.embed(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v), 4).alias("norm"))


@query("SELECT a.vec_id AS doc_id, i, similarity, CAST(sum(CASE WHEN similarity <= cut AND spread > 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY a.g ORDER BY i) AS BIGINT) AS part FROM (SELECT vec_id // 20 AS vec_id, vec_id // 20 AS g, vec_id % 20 AS i, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(lag(embedding) OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS DOUBLE[])), 6) AS similarity FROM embeddings) a JOIN (SELECT g, quantile_cont(similarity, 0.2) AS cut, max(similarity) - min(similarity) AS spread FROM (SELECT vec_id // 20 AS g, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(lag(embedding) OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS DOUBLE[])), 6) AS similarity FROM embeddings) GROUP BY g) c ON c.g = a.g")
def semantic_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stand for sentences: twenty of them make a document."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), (F.col("vec_id") % 20).alias("i"), F.col("embedding").alias("vector"))
    return scoring.semantic_breaks(rows)


@query("SELECT p.l_orderkey AS question, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS precision FROM lineitem p GROUP BY 1")
def cited_precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("block"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("unit"))
    gold = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("unit"))
    return scoring.citation_scores(rows, gold).select("question", F.round("precision", 6).alias("precision"))


@query("SELECT conv_id, count(*) FILTER (text LIKE '%.') AS closed, count(*) FILTER (text NOT LIKE '%.') AS open, round(avg(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END), 6) AS answered FROM conversations GROUP BY 1")
def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    closed = F.col("text").endswith(".")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.round(F.avg((F.col("role") == "assistant").cast("double")), 6).alias("answered"))


@query(f"WITH {LEDGER_SQL} SELECT event_type, source_group, count(*) AS requests, round(avg(latency), 6) AS mean, round(count(*) FILTER (status = 'failed') / count(*), 9) AS failed, count(DISTINCT win) AS windows FROM ledger GROUP BY GROUPING SETS ((event_type, source_group), (event_type), ())")
def condition_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf)
    aggregates = [F.count("*").alias("requests"), F.round(F.avg("latency"), 6).alias("mean"), F.round(F.count_if(F.col("status") == "failed") / F.count("*"), 9).alias("failed"), F.countDistinct("win").alias("windows")]
    return rows.groupingSets([["event_type", "source_group"], ["event_type"], []], "event_type", "source_group").agg(*aggregates).select("event_type", "source_group", "requests", "mean", "failed", "windows")


@query(f"WITH {LEDGER_SQL}, s AS (SELECT source_group, unnest(range((SELECT min(win) FROM ledger), (SELECT max(win) + 1 FROM ledger))) AS win FROM (SELECT DISTINCT source_group FROM ledger)) SELECT s.source_group, s.win FROM s LEFT JOIN ledger l ON l.source_group = s.source_group AND l.win = s.win WHERE l.win IS NULL")
def missing_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots without a request: every group is scheduled in every hour from the first to the last of the ledger."""
    rows = ledger(spark, sf)
    bounds = rows.agg(F.min("win").alias("first"), F.max("win").alias("last"))  # one row
    plan = rows.select("source_group").distinct().join(F.broadcast(bounds)).select("source_group", F.explode(F.sequence("first", "last")).alias("win"))
    return plan.join(rows.select("source_group", "win").distinct(), ["source_group", "win"], "left_anti")


@query(f"WITH {LEDGER_SQL} SELECT user_id, count(*) AS statements, count(DISTINCT attempt) AS attempts, count(DISTINCT attempt) = 3 AS complete FROM ledger GROUP BY 1")
def attempt_completeness(spark: SparkSession, sf: str) -> DataFrame:
    found = ledger(spark, sf).groupBy("user_id").agg(F.count("*").alias("statements"), F.sort_array(F.collect_set("attempt")).alias("a"))
    return found.select("user_id", "statements", F.size("a").cast("long").alias("attempts"), (F.col("a") == F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("complete"))


@query(
    """WITH c AS (SELECT conv_id, turn AS start, turn + CASE WHEN (conv_id + turn) % 5 = 1 THEN 2 WHEN (conv_id + turn) % 13 = 4 THEN 0 ELSE 1 END AS stop, CASE WHEN (2 * conv_id + turn) % 9 = 4 THEN ' ' ELSE text END AS text FROM conversations),
w AS (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
SELECT conv_id, start, 'empty span' AS problem FROM w WHERE stop <= start UNION ALL SELECT conv_id, start, 'overlap' FROM w WHERE start < reach UNION ALL SELECT conv_id, start, 'no text' FROM w WHERE trim(text) = ''"""
)
def segment_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments of time, of which some are empty, reach into the next or have no text."""
    c, t = F.col("conv_id"), F.col("turn")
    stop = t + F.when((c + t) % 5 == 1, 2).when((c + t) % 13 == 4, 0).otherwise(1)
    rows = table(spark, sf, "conversations").select("conv_id", t.alias("start"), stop.alias("stop"), F.when((2 * c + t) % 9 == 4, " ").otherwise(F.col("text")).alias("text"))
    reach = F.max("stop").over(Window.partitionBy("conv_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reach", reach)
    rules = {"empty span": F.col("stop") <= F.col("start"), "overlap": F.col("start") < F.col("reach"), "no text": F.btrim("text") == ""}
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select("conv_id", "start", F.explode(found).alias("problem"))


@query("SELECT p_brand AS metric, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) THEN 'required' ELSE 'descriptive' END AS direction FROM (SELECT DISTINCT p_brand FROM part)")
def metric_contract(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    required = part.where("p_size > 48").select("p_brand").distinct().withColumn("required", F.lit(True))
    rows = part.select("p_brand").distinct().join(required, "p_brand", "left")
    return rows.select(F.col("p_brand").alias("metric"), F.when(F.col("required"), "required").otherwise("descriptive").alias("direction"))


@query(f"WITH {RESULT_SQL}, m AS (SELECT candidate, avg(value) AS mean, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM res GROUP BY 1) SELECT candidate, name, round(value, 6) AS value FROM (UNPIVOT m ON mean, low, high INTO NAME name VALUE value) WHERE isfinite(value)")
def reported_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = results(spark, sf).groupBy("candidate").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.05)).alias("low"), F.percentile("value", F.lit(0.95)).alias("high"))
    long = m.unpivot(["candidate"], ["mean", "low", "high"], "name", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("candidate", "name", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, coalesce(o.n, 0) AS replies, CASE WHEN o.n IS NULL THEN 'missing' ELSE 'replayed' END AS state FROM customer LEFT JOIN (SELECT sha256('req|' || o_custkey) AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = sha256('req|' || c_custkey)")
def judge_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Stored replies looked up by the hash of the request."""
    key = lambda c: F.sha2(F.concat(F.lit("req|"), F.col(c).cast("string")), 256).alias("k")
    stored = table(spark, sf, "orders").groupBy(key("o_custkey")).agg(F.count("*").alias("n"))
    asked = table(spark, sf, "customer").select("c_custkey", key("c_custkey"))
    return asked.join(stored, "k", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("replies"), F.when(F.col("n").isNull(), "missing").otherwise("replayed").alias("state"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END END AS formula, coalesce(o_orderstatus = 'O', false) AS false_transcription FROM orders")
def formula_and_nonspeech(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    exact = F.when(F.col("o_totalprice") > 200000, F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return rows.select("o_orderkey", exact.alias("formula"), F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)).alias("false_transcription"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-z]+')) AS tags, len(list_distinct(regexp_extract_all(html, '<[a-z]+'))) AS kinds FROM pages")
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit("<[a-z]+"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", F.size(tags).alias("tags"), F.size(F.array_distinct(tags)).alias("kinds"))


@query("SELECT user_id, day, round(first_seconds, 2) AS first_seconds, n FROM (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, min(epoch(ts)) - 86400 * floor(epoch(min(ts)) / 86400) AS first_seconds, count(*) AS n FROM events GROUP BY 1, 2)".replace("epoch(min(ts))", "min(epoch(ts))"))
def frame_times(spark: SparkSession, sf: str) -> DataFrame:
    t = micros("ts")
    rows = table(spark, sf, "events").groupBy("user_id", F.floor(t / 86_400_000_000).alias("day")).agg(F.min(t).alias("m"), F.count("*").alias("n"))
    return rows.select("user_id", "day", F.round((F.col("m") - F.col("day") * 86_400_000_000) / 1_000_000, 2).alias("first_seconds"), "n")


@query("SELECT l_orderkey AS document, CAST(levenshtein(string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_linenumber), string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_extendedprice, l_linenumber)) AS DOUBLE) / count(*) AS distance FROM (SELECT * FROM lineitem WHERE l_linenumber < 10) GROUP BY 1".replace("/ count(*) AS distance", "/ count(*) AS d").replace("SELECT l_orderkey AS document, CAST", "SELECT document, round(d, 6) AS distance FROM (SELECT l_orderkey AS document, CAST") + ")")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of the order by place and the order by price, over the number of elements."""
    rows = table(spark, sf, "lineitem").where("l_linenumber < 10")
    named = F.col("l_linenumber").cast("string")
    order = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", named.alias("s")))).alias("a"), F.sort_array(F.collect_list(F.struct("l_extendedprice", "l_linenumber", named.alias("s")))).alias("b"))
    distance = F.levenshtein(F.array_join(F.col("a.s"), ""), F.array_join(F.col("b.s"), "")) / F.size("a")
    return order.select(F.col("l_orderkey").alias("document"), F.round(distance, 6).alias("distance"))


@query()
def visible_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Odd turns open the section in the prompt, every fifth in capitals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [matching.visible_answer(t or "", p) for t, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([s[i] for s in split], pa.string()) for i in (0, 1))], ["conv_id", "turn", "answer", "reasoning"])

    odd, tag = F.col("turn") % 2 == 1, F.when(F.col("turn") % 5 == 0, "THINK").otherwise("think")
    answer = F.concat(F.when(odd, F.lit("plan</")).otherwise(F.concat(F.lit("<"), tag, F.lit(">plan</"))), tag, F.lit("> "), "text")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("said"), F.when(odd, F.lit("assistant: <think>\n")).otherwise(F.lit("")).alias("prompt"))
    return rows.mapInArrow(run, "conv_id long, turn long, answer string, reasoning string")


@query()
def stable_uuids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", scoring.stable_uuid(F.col("vec_id").cast("string")).alias("uuid"))


@query(f"WITH {DENSE_SQL}, s AS (SELECT query_id, CASE WHEN query_id % 50 = 0 THEN 'inapplicable' WHEN query_id % 75 = 0 THEN 'incomplete' ELSE 'scored' END AS status, avg(score) AS v FROM dense WHERE rank <= 5 GROUP BY ALL) SELECT status, count(*) AS n, round(avg(v), 6) AS mean FROM s GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = dense(spark, sf, limit=5).groupBy("query_id").agg(F.avg("score").alias("v"))
    state = metrics.status(F.col("query_id") % 50 != 0, F.col("query_id") % 75 != 0, F.col("v"))
    return v.groupBy(state.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("WITH u AS (SELECT doc_id AS id, source AS split FROM documents UNION ALL SELECT item_id, 'bench' FROM benchmark) SELECT id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1")
def manifest_union_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")

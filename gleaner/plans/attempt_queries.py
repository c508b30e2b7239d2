"""Queries over attempts: transcripts, timings, coverage of measurements, statistics by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attempts, metrics
from .base import DEPTH, query, table
from .document_queries import TREE_SQL, tree
from .ledger_queries import LEDGER_SQL, ledger
from .retrieval_queries import DENSE_SQL, dense
from .text_queries import PROSE


@query(
    f"""WITH c AS (SELECT conv_id, turn, text, conv_id % 7 AS k, turn * 2.0 - CASE WHEN conv_id % 7 = 1 AND turn = 1 THEN 5 ELSE 0 END AS st, turn * 2.0 + CASE WHEN conv_id % 7 = 6 AND turn = 0 THEN -1 ELSE 1.5 END AS en FROM conversations),
d AS (SELECT conv_id, k, max(turn) * 2 + CASE WHEN k = 2 THEN 0.5 ELSE 1.25 END AS duration, string_agg(text, ' ' ORDER BY turn) AS t FROM c GROUP BY 1, 2),
p AS (SELECT conv_id, k, duration, CASE WHEN k = 4 THEN '' WHEN k = 5 THEN t || ' and more' ELSE t END AS transcript FROM d), g AS (SELECT * FROM c WHERE k <> 3),
w AS (SELECT p.conv_id, {PROSE.format("p.transcript")} AS own, (SELECT string_agg(x, ' ' ORDER BY turn) FROM (SELECT turn, {PROSE.format("g.text")} AS x FROM g WHERE g.conv_id = p.conv_id) WHERE x <> '') AS heard FROM p)
SELECT conv_id, 'unordered segments' AS problem FROM (SELECT *, lag(st) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM g) WHERE st < a UNION SELECT conv_id, 'segment ends before its start' FROM g WHERE en < st
UNION SELECT g.conv_id, 'segment beyond the end' FROM g JOIN p ON p.conv_id = g.conv_id WHERE en > duration + 0.5 UNION SELECT conv_id, 'segments missing' FROM w WHERE own <> '' AND heard IS NULL
UNION SELECT conv_id, 'segments without transcript' FROM w WHERE own = '' AND heard IS NOT NULL UNION SELECT conv_id, 'transcript contradicts segments' FROM w WHERE own <> '' AND own <> heard"""
)
def transcript_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts, turns as segments of two seconds; six of seven kinds hold a fault."""
    k, turn = F.col("conv_id") % 7, F.col("turn")
    rows = table(spark, sf, "conversations").select("conv_id", turn.alias("number"), "text", (turn * 2.0 - F.when((k == 1) & (turn == 1), 5).otherwise(0)).alias("start"), (turn * 2.0 + F.when((k == 6) & (turn == 0), -1.0).otherwise(1.5)).alias("end"))
    whole = rows.groupBy("conv_id").agg(F.max("number").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " ").alias("t"))
    said = F.when(k == 4, "").when(k == 5, F.concat("t", F.lit(" and more"))).otherwise(F.col("t"))
    predictions = whole.select("conv_id", said.alias("transcript"), (F.col("last") * 2 + F.when(k == 2, 0.5).otherwise(1.25)).alias("duration"))
    return attempts.transcript_problems(predictions, rows.where(k != 3), "conv_id", 0.5)


@query(
    f"""WITH {TREE_SQL} SELECT user_id, count(*) AS "references", count(*) FILTER (n % 5 <> 0) AS aligned, round(coalesce(sum(CASE WHEN n % 3 = 0 THEN 0.5 + 4 ELSE 0.5 + 0.25 END) FILTER (n % 5 <> 0), 0), 6) AS error, 2 * count(*) FILTER (n % 5 <> 0) AS boundaries FROM tree GROUP BY 1"""
)
def timestamp_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as spoken segments of eight seconds, predicted in two pieces; every third match has the first piece alone, every fifth segment none."""
    n = F.col("n")
    rows = tree(spark, sf)
    references = rows.select("user_id", n.alias("number"), (n * 10.0).alias("start"), (n * 10.0 + 8).alias("end"))
    pieces = rows.select("user_id", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    second = F.col("h") == 1
    predictions = pieces.select("user_id", (2 * n + F.col("h")).alias("number"), (n * 10.0 + F.when(second, 4.5).otherwise(0.5)).alias("start"), (n * 10.0 + F.when(second, 8.25).otherwise(4.0)).alias("end"))
    matches = rows.where(n % 5 != 0).select("user_id", n.alias("reference"), (2 * n).alias("first"), (2 * n + F.when(n % 3 == 0, 0).otherwise(1)).alias("last"))
    return attempts.timestamp_totals(references, predictions, matches, "user_id").withColumn("error", F.round("error", 6))


@query(
    """WITH e AS (SELECT event_id, event_id % 8 AS k, event_id % 5 AS n, value FROM events)
SELECT event_id, k <> 1 AND (k = 2 OR NOT ((k = 3 AND n >= 2) OR k = 4 OR (k = 5 AND n >= 2))) AS decode,
  k <> 1 AND CASE WHEN n = 0 AND k <> 4 THEN true WHEN k = 6 THEN false WHEN k = 5 AND n >= 2 THEN false ELSE true END AS ttft, k <> 1 AND k <> 7 AS latency FROM e"""
)
def measurement_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts with up to four tokens; kinds of them lack or contradict a measurement."""
    k, n, i = F.col("event_id") % 8, (F.col("event_id") % 5).cast("int"), F.col("event_id")
    rising = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: j * 1.0 + F.lit(0.25))).otherwise(F.array().cast("array<double>"))
    events = F.when((k == 5) & (n >= 2), F.reverse(rising)).when(k == 4, F.concat(rising, F.array(F.lit(99.0)))).otherwise(rising)
    outcome = F.when(k == 1, "not_executed").when(k == 2, "failed").otherwise("completed")
    none = F.lit(None).cast("double")
    first, last = F.get(rising, F.lit(0)), F.when(n > 0, F.element_at(rising, -1))
    ttft = F.when(k == 6, first + 1).otherwise(F.coalesce(first, F.lit(99.0)) - 0.25)
    made = attempts.measurement_coverage(outcome, events, n, ttft, F.lit(0.25), first, F.when(k == 3, last + 1).when(k == 4, 99.0).otherwise(last), F.when(k == 7, none).otherwise(F.lit(1.0)), i >= 0)
    return table(spark, sf, "events").select("event_id", made.alias("c")).select("event_id", "c.*")


@query(
    f"""WITH {LEDGER_SQL}, c AS (SELECT user_id AS question, 'latency' AS metric, CASE status WHEN 'success' THEN 'scored' WHEN 'failed' THEN 'unavailable' ELSE 'inapplicable' END AS status, CASE WHEN status = 'not_executed' AND event_id % 2 = 0 THEN 'no_generated_claims' END AS reason, latency AS value FROM ledger
  UNION ALL SELECT user_id, 'error_rate', CASE WHEN user_id % 4 = 1 AND status = 'not_executed' THEN 'incomplete' WHEN status = 'not_executed' THEN 'inapplicable' ELSE 'scored' END, NULL, CASE WHEN status <> 'not_executed' THEN CAST(status = 'failed' AS INT) END FROM ledger),
g AS (SELECT question, metric, avg(value) AS v, count(*) FILTER (status <> 'inapplicable' OR reason = 'no_generated_claims') AS eligible, count(value) AS contributing, count(*) FILTER (status IN ('unavailable', 'incomplete')) AS unavailable, count(*) FILTER (reason = 'no_generated_claims') AS claim_free FROM c GROUP BY 1, 2)
SELECT question, metric, round(CASE WHEN metric = 'latency' OR unavailable = 0 THEN v END, 6) AS value, eligible, contributing, unavailable, claim_free, unavailable = 0 AS complete FROM g"""
)
def question_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Users as questions, events as attempts: latency has what there is, the error rate needs all."""
    s = F.col("status")
    rows = ledger(spark, sf)
    idle = s == "not_executed"
    latency = rows.select(F.col("user_id").alias("question"), F.lit("latency").alias("metric"), F.when(s == "success", "scored").when(s == "failed", "unavailable").otherwise("inapplicable").alias("status"), F.when(idle & (F.col("event_id") % 2 == 0), "no_generated_claims").alias("reason"), F.col("latency").alias("value"))
    state = F.when(idle & (F.col("user_id") % 4 == 1), "incomplete").when(idle, "inapplicable").otherwise("scored")
    error = rows.select(F.col("user_id").alias("question"), F.lit("error_rate").alias("metric"), state.alias("status"), F.lit(None).cast("string").alias("reason"), F.when(~idle, (s == "failed").cast("double")).alias("value"))
    return attempts.question_statistics(latency.unionByName(error), ["error_rate"]).withColumn("value", F.round("value", 6))


@query(
    rf"""WITH e AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'code' WHEN 2 THEN 'table' ELSE 'formula' END AS kind, text || ' x_1+=f(y);' AS text FROM conversations),
t AS (SELECT conv_id, turn, kind, CASE WHEN kind IN ('code', 'formula') THEN regexp_extract_all(CASE WHEN kind = 'formula' AND conv_id % 2 = 0 THEN '\frac{{a}}{{b}} = ' || turn ELSE text END, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')
  ELSE list_filter(string_split({PROSE.format("CASE WHEN kind = 'table' AND conv_id % 3 = 0 THEN 'cell one' || ' ' || 'Cell-' || turn ELSE text END")}, ' '), lambda x: x <> '') END AS k FROM e)
SELECT conv_id, turn, kind, CAST(len(k) AS INT) AS n, md5(array_to_string(k, '|')) AS digest FROM t"""
)
def element_tokens(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("text", "code", "table", "formula"))), (turn % 4 + 1).cast("int"))
    latex = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(r"\frac{a}{b} = "), turn.cast("string")))
    cells = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("cell one"), F.concat(F.lit("Cell-"), turn.cast("string"))))
    k = tx.element_tokens(kind, F.concat("text", F.lit(" x_1+=f(y);")), latex, cells)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), k.alias("k"))
    return rows.select("conv_id", "turn", "kind", F.size("k").alias("n"), F.md5(F.array_join("k", "|")).alias("digest"))


@query(
    f"""WITH {LEDGER_SQL}, v AS (SELECT source_group, event_type, CASE WHEN event_id % 97 <> 0 THEN latency END AS latency, event_type <> 'login' AS due FROM ledger),
g AS (SELECT source_group, event_type, count(*) FILTER (due) AS e, count(latency) AS k, avg(latency) AS m, quantile_cont(latency, 0.95) AS p FROM v GROUP BY 1, 2)
SELECT source_group, event_type, CASE WHEN e = 0 THEN 'inapplicable' WHEN k = e THEN 'scored' WHEN k = 0 THEN 'unavailable' ELSE 'incomplete' END AS status, e > 0 AND k = e AS complete, e AS eligible, k AS contributing, e - k AS unavailable, round(m, 6) AS mean, round(p, 6) AS p95 FROM g"""
)
def latency_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Latency by group and kind of event: logins have none, errors lost theirs, some others were not measured."""
    by = ["source_group", "event_type"]
    rows = ledger(spark, sf).withColumn("latency", F.when(F.col("event_id") % 97 != 0, F.col("latency")))
    expected = rows.groupBy(*by).agg(F.count_if(F.col("event_type") != "login").alias("expected"))
    found = metrics.descriptor(rows, expected, by, "latency")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("p95", F.round("p95", 6))


@query(
    f"WITH {DENSE_SQL}, h AS (SELECT q.label, d.query_id, e.label AS found FROM dense d JOIN q ON q.query_id = d.query_id JOIN embeddings e ON e.vec_id = d.vec_id WHERE d.rank <= {DEPTH}) SELECT label, count(*) AS hits, count(*) FILTER (found IS DISTINCT FROM label) AS violations, round(count(*) FILTER (found IS DISTINCT FROM label) / count(*), 6) AS rate FROM h GROUP BY 1"
)
def filter_violation_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a search that did not filter by label, as violations of that filter, by the label asked for."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = dense(spark, sf).join(labels.withColumnRenamed("label", "found"), "vec_id").join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
    return metrics.violation_rate(hits, ["label"], ~F.col("found").eqNullSafe(F.col("label"))).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {LEDGER_SQL}, v AS (SELECT user_id, event_id, attempt, event_type, 'latency' AS metric, latency AS value FROM ledger UNION ALL SELECT user_id, event_id, attempt, event_type, 'error', CASE status WHEN 'failed' THEN 1.0 WHEN 'success' THEN 0.0 END FROM ledger),
s AS (SELECT *, unnest(list_distinct(list_filter(['overall', 'attempt:' || attempt, CASE WHEN event_type <> 'login' THEN 'kind:' || event_type END, 'third:' || event_id % 3, 'third:' || user_id % 3], lambda x: x IS NOT NULL))) AS slice FROM v WHERE value IS NOT NULL),
i AS (SELECT slice, metric, user_id, avg(value) AS m FROM s GROUP BY ALL), a AS (SELECT slice, metric, count(*) AS "groups", avg(m) AS macro FROM i GROUP BY 1, 2)
SELECT s.slice, s.metric, count(*) AS observations, any_value(a."groups") AS "groups", round(any_value(a.macro), 6) AS macro, round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS pooled, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM s JOIN a ON a.slice = s.slice AND a.metric = s.metric GROUP BY 1, 2"""
)
def sliced_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Latency and errors overall, by attempt, by kind of event and by two thirds that a row may both belong to."""
    s = F.col("status")
    rows = ledger(spark, sf)
    error = F.when(s == "failed", 1.0).when(s == "success", 0.0)
    cells = rows.select("user_id", "event_id", "attempt", "event_type", F.explode(F.array(F.struct(F.lit("latency").alias("metric"), F.col("latency").cast("double").alias("value")), F.struct(F.lit("error").alias("metric"), error.alias("value")))).alias("c"))
    cells = cells.select("user_id", "event_id", "attempt", "event_type", "c.*", (1 + F.col("event_id") % 4).cast("double").alias("weight"))
    slices = {"attempt": F.col("attempt"), "kind": F.when(F.col("event_type") != "login", F.col("event_type")), "third": F.array(F.col("event_id") % 3, F.col("user_id") % 3)}
    out = metrics.sliced_aggregate(cells, slices, "user_id", "metric", "value", "weight")
    return out.select("slice", "metric", "observations", "groups", *[F.round(x, 6).alias(x) for x in ("macro", "pooled", "p50", "p95")])


@query(
    """WITH c AS (SELECT conv_id AS response, 'c' || turn AS id, turn, (conv_id + 3 * turn) % 13 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT response, CASE WHEN k = 1 THEN '' ELSE id END AS id, 'no id or text' AS problem FROM c WHERE k = 1 UNION ALL SELECT response, id, 'no spans' FROM c WHERE k = 2 UNION ALL SELECT response, id, 'span outside the answer' FROM c WHERE k = 3 AND response % 9 <> 4
UNION ALL SELECT response, id, 'unknown support' FROM c WHERE k = 4 UNION ALL SELECT response, id, 'unknown cited support' FROM c WHERE k = 5 UNION ALL SELECT response, id, 'unknown verification' FROM c WHERE k = 6
UNION ALL SELECT response, id, 'positive without source' FROM c WHERE k = 7 UNION ALL SELECT response, id, 'cited support alone' FROM c WHERE k = 8 UNION ALL SELECT response, id, 'gold match' FROM c WHERE k IN (9, 10)
UNION ALL SELECT response, CASE WHEN k = 1 THEN '' ELSE id END, 'claim of a refusal' FROM c WHERE response % 9 = 4"""
)
def label_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as claims of their conversation's answer, by kinds of which most break a rule; every ninth answer is the refusal."""
    k = F.pmod(F.col("conv_id") + 3 * F.col("turn"), F.lit(13))
    named = F.concat(F.lit("c"), F.col("turn").cast("string"))
    strings = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    of = lambda kind, odd, usual: F.when(k == kind, odd).otherwise(usual)
    rows = table(spark, sf, "conversations")
    span = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
    claims = rows.select(
        F.col("conv_id").alias("response"), F.when(k == 1, "").otherwise(named).alias("id"), F.concat_ws(" ", named, "text").alias("text"),
        F.when(k == 2, F.filter(span(0, 1), lambda x: F.lit(False))).when(k == 3, span(2, 60)).otherwise(span(0, 20)).alias("spans"),
        of(8, F.lit(False), F.lit(True)).alias("supported"), (k != 7).alias("cited_supported"), of(10, F.lit(False), F.lit(True)).alias("correct"),
        F.when(k == 4, strings("b1", "b9")).when(k == 7, strings()).otherwise(strings("b1", "b2")).alias("support_sources"), of(5, strings("b2"), strings("b1")).alias("cited_sources"),
        of(6, strings("m1", "m1"), strings("m1")).alias("verification_sources"), F.when(k == 9, strings("g1", "g7")).when(k == 10, strings("g1")).otherwise(strings()).alias("gold_matches"),
    )
    answer = F.when(F.col("conv_id") % 9 == 4, attempts.REFUSAL).otherwise(F.lit("an answer of just forty letters, or so it"))
    responses = rows.select("conv_id").distinct().select(F.col("conv_id").alias("response"), answer.alias("answer"), strings("b1", "b2").alias("blocks"), strings("b1", "b9").alias("citations"), strings("m1", "m2").alias("material"), strings("g1", "g2").alias("gold"))
    return attempts.label_problems(claims, responses)

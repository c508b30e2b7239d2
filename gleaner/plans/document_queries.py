"""Queries over documents as segments, structured content, pages and hierarchies, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structured
from ..functions import text as tx
from ..operators import documents
from .base import query, table
from .text_queries import PROSE

MINIMAL = "regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\\r\\n?', chr(10), 'g'), '[­]', '', 'g'), '^\\s+|\\s+$', '', 'g')"
FULL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\\r\\n?', chr(10), 'g'), '[­]', '', 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'),"
    " '[\\t\\f\\x0B]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
)


def raw_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments that need cleaning: every seventh a formula, every fifth a table, some blank."""
    t = F.col("turn") + F.col("conv_id")
    kind = F.when(t % 7 == 3, "formula").when(t % 5 == 2, "table").otherwise("text")
    body = F.when(t % 11 == 4, " \t\r\n ").otherwise(F.concat(F.lit("\r\n "), F.regexp_replace("text", ", ", ",\t  "), F.lit(" co-\nop\r\n\r\n\r\n\r\ne\u0301nd\u00ad.")))
    return table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), body.alias("text"), F.array(F.split(body, "[.]")).alias("cells"))


SEGMENTS_SQL = f"""raw AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 7 = 3 THEN 'formula' WHEN (turn + conv_id) % 5 = 2 THEN 'table' ELSE 'text' END AS kind,
  CASE WHEN (turn + conv_id) % 11 = 4 THEN ' ' || chr(9) || chr(13) || chr(10) || ' ' ELSE chr(13) || chr(10) || ' ' || replace(text, ', ', ',' || chr(9) || '  ') || ' co-' || chr(10) || 'op' || repeat(chr(13) || chr(10), 4) || 'e' || chr(769) || 'nd' || chr(173) || '.' END AS body FROM conversations),
seg AS (SELECT * FROM (SELECT conv_id, turn, kind, body, CASE WHEN kind = 'formula' THEN {MINIMAL.format("body")} ELSE {FULL.format("body")} END AS t FROM raw) WHERE t <> ''),
placed AS (SELECT *, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM seg)"""


@query(
    f"""WITH {SEGMENTS_SQL} SELECT conv_id, turn, kind, md5(t) AS digest, s AS start, CAST(s + length(t) AS INT) AS "end",
  CASE WHEN kind = 'table' THEN md5(array_to_string(list_transform(string_split(body, '.'), lambda x: {FULL.format("x")}), '|')) END AS cells FROM placed"""
)
def normalized_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.normalize_segments(raw_segments(spark, sf), "conv_id", "turn", "text", "kind", "conservative", "cells")
    return rows.select("conv_id", "turn", "kind", F.md5("text").alias("digest"), "start", "end", F.when(F.col("kind") == "table", F.md5(F.array_join(F.get("cells", F.lit(0)), "|"))).alias("cells"))


@query(f"WITH {SEGMENTS_SQL} SELECT conv_id, sha256(string_agg(t, chr(10) ORDER BY turn)) AS digest, CAST(length(string_agg(t, chr(10) ORDER BY turn)) AS INT) AS n, CAST(max(s + length(t)) AS INT) AS last_end FROM placed GROUP BY 1")
def normalized_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.normalize_segments(raw_segments(spark, sf), "conv_id", "turn", "text", "kind")
    text = documents.text_of(rows, "conv_id", "turn", "text")
    ends = rows.groupBy("conv_id").agg(F.max("end").alias("last_end"))
    return text.join(ends, "conv_id").select("conv_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"), "last_end")


@query(
    """WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '' WHEN turn % 4 = 2 THEN text || chr(10) || chr(10) ELSE text END AS t FROM conversations),
p AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
s AS (SELECT *, CASE WHEN t <> '' AND prev IS NOT NULL AND NOT ends_with(prev, chr(10) || chr(10)) THEN 2 ELSE 0 END AS sep FROM p),
o AS (SELECT *, CAST(coalesce(sum(sep + length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sep AS INT) AS st, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS i FROM s)
SELECT conv_id, turn, sep, st AS start, CAST(st + length(t) AS INT) AS "end", CASE WHEN turn % 3 = 0 THEN CAST(turn AS INT) + 100 ELSE i END AS "order" FROM o"""
)
def structured_document(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    text = F.when(turn % 4 == 1, "").when(turn % 4 == 2, F.concat("text", F.lit("\n\n"))).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"), F.when(turn % 3 == 0, turn + 100).alias("native"))
    out = documents.structured_segments(rows, "conv_id", "turn", "text", "native")
    return out.select("conv_id", "turn", F.length("separator").alias("sep"), "start", "end", "order")


@query(
    """WITH seg AS (SELECT conv_id // 4 AS doc, conv_id % 4 AS part, conv_id, turn, role, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM conversations),
part AS (SELECT doc, part, any_value(conv_id) AS conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM seg GROUP BY 1, 2),
pl AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS shift, CASE WHEN part = 0 THEN 'audio' ELSE 'frame-' || (part - 1) END AS identity FROM part),
a AS (SELECT pl.doc, pl.part, identity, shift, turn, role, s AS ns, CAST(s + length(seg.text) AS INT) AS ne, seg.text FROM pl JOIN seg ON seg.conv_id = pl.conv_id WHERE pl.conv_id % 5 <> 1
  UNION ALL SELECT doc, part, identity, shift, NULL, NULL, 0, CAST(length(text) AS INT), text FROM pl WHERE conv_id % 5 = 1 AND text <> '')
SELECT doc, identity, row_number() OVER (PARTITION BY doc ORDER BY part, turn) - 1 AS "order", md5(text) AS digest, shift + ns AS start, shift + ne AS "end", identity || ':e' || turn AS element, CASE WHEN turn > 0 THEN identity || ':e' || (turn - 1) END AS parent,
  CASE WHEN role = 'assistant' THEN 'table' WHEN part = 0 THEN 'audio' ELSE 'visual_text' END AS kind, CASE WHEN part > 0 THEN part * 1.5 ELSE CAST(turn AS DOUBLE) END AS t_start FROM a"""
)
def joined_document(spark: SparkSession, sf: str) -> DataFrame:
    """Four conversations make a document: the first is its sound, the others frames 1.5 seconds apart."""
    rows = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 4).alias("doc"), F.col("conv_id") % 4, "conv_id", "turn", "role", "text").toDF("doc", "part", "conv_id", "turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    name = lambda t: F.concat(F.lit("e"), t.cast("string"))
    segments = rows.where("conv_id % 5 <> 1").select(
        "doc", "part", F.col("turn").alias("number"), "text", start.alias("start"), (start + F.length("text")).alias("end"), name(F.col("turn")).alias("element"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), F.when(F.col("role") == "assistant", "table").otherwise("text").alias("kind"),
        F.col("turn").cast("double").alias("t_start"), (F.col("turn") + 1).cast("double").alias("t_end"),
    )
    text = documents.text_of(rows, "conv_id", "turn", "text").select(F.floor(F.col("conv_id") / 4).alias("doc"), (F.col("conv_id") % 4).alias("part"), "text")
    sound = F.col("part") == 0
    parts = text.select("doc", "part", F.when(sound, "audio").otherwise(F.concat(F.lit("frame-"), (F.col("part") - 1).cast("string"))).alias("identity"), F.when(sound, "audio").otherwise("visual").alias("modality"), (F.col("part") * 1.5).alias("stamp"), "text")
    out = documents.joined_parts(parts, segments, "doc")
    return out.select("doc", "identity", "order", F.md5("text").alias("digest"), "start", "end", "element", "parent", "kind", "t_start")


TREE_SQL = """tree AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user, numbered from 1: the nodes of a binary heap."""
    return table(spark, sf, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))


@query(
    f"""WITH {TREE_SQL}, r AS (SELECT user_id, n, CASE WHEN n > 1 THEN n // 2 END AS parent, CAST(floor(log2(n)) AS INT) AS level FROM tree),
p AS (SELECT user_id, n, CASE WHEN n % 7 = 0 THEN 1 ELSE parent END AS parent, level + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS level, n % 13 <> 0 AS says FROM r WHERE n % 4 <> 3),
j AS (SELECT r.user_id, r.n, (p.n IS NOT NULL) AND (r.n % 5 = 0 OR (p.says AND CASE WHEN r.parent IS NULL THEN p.parent IS NULL ELSE r.parent % 4 <> 3 AND r.parent % 9 <> 5 AND r.parent IS NOT DISTINCT FROM p.parent END)) AND (r.n % 3 <> 0 OR r.level = p.level) AS good
  FROM r LEFT JOIN p ON p.user_id = r.user_id AND p.n = r.n AND r.n % 9 <> 5 WHERE r.n % 5 <> 0 OR r.n % 3 = 0)
SELECT user_id, count(*) AS eligible, count(*) FILTER (good) AS preserved FROM j GROUP BY 1"""
)
def hierarchy_preserved(spark: SparkSession, sf: str) -> DataFrame:
    """A heap as reference; its prediction lacks nodes, mixes up parents and levels, and is matched in part."""
    n = F.col("n")
    r = tree(spark, sf).select("user_id", n.alias("element"), F.when(n > 1, F.floor(n / 2)).alias("parent"), F.floor(F.log2(n)).cast("int").alias("level"), (n % 5 != 0).alias("has_parent"), (n % 3 == 0).alias("has_level"))
    e, other = F.col("element"), lambda x: x + 1000
    seen = r.where(e % 4 != 3)
    p = seen.select("user_id", other(e).alias("element"), F.when(e % 7 == 0, other(F.lit(1))).otherwise(other(F.col("parent"))).alias("parent"), (F.col("level") + F.when(e % 11 == 0, 1).otherwise(0)).alias("level"), (e % 13 != 0).alias("has_parent"))
    matches = seen.where(e % 9 != 5).select("user_id", e.alias("reference"), other(e).alias("prediction"))
    return documents.hierarchy_preservation(r, p, matches, "user_id")


@query(
    f"""WITH RECURSIVE {TREE_SQL}, m AS (SELECT user_id, max(n) AS last FROM tree GROUP BY 1),
x AS (SELECT t.user_id, CASE WHEN n % 41 = 0 THEN 2 ELSE n END AS element, CASE WHEN n % 37 = 0 THEN 1 ELSE n END AS ord, n // 20 AS page,
  CASE t.user_id % 3 WHEN 0 THEN CASE WHEN n = last THEN 3 ELSE n + 1 END WHEN 1 THEN nullif(n - 1, 0) ELSE CASE WHEN n % 29 = 0 THEN -n ELSE nullif(n // 2, 0) END END AS parent FROM tree t JOIN m ON m.user_id = t.user_id),
u AS (SELECT user_id, element, min(parent) AS parent FROM (SELECT * FROM x WHERE NOT (element = 2 AND ord <> 2)) GROUP BY 1, 2),
w AS (SELECT user_id, element AS origin, parent AS cur, 1 AS d FROM u WHERE user_id % 3 = 0 AND parent IS NOT NULL
  UNION ALL SELECT w.user_id, origin, u.parent, d + 1 FROM w JOIN u ON u.user_id = w.user_id AND u.element = w.cur WHERE w.cur <> w.origin AND d < 2000 AND u.parent IS NOT NULL)
SELECT user_id, element, 'repeated element' AS problem FROM x GROUP BY 1, 2 HAVING count(*) > 1
UNION SELECT user_id, element, 'repeated order' FROM (SELECT *, count(*) OVER (PARTITION BY user_id, ord) AS c FROM x) WHERE c > 1
UNION SELECT user_id, element, 'unknown page' FROM x WHERE page > 2
UNION SELECT user_id, element, 'unknown parent' FROM x WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x y WHERE y.user_id = x.user_id AND y.element = x.parent)
UNION SELECT user_id, origin, 'cycle' FROM w WHERE cur = origin"""
)
def annotation_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as annotations: deep chains, rings, repeated numbers, pages and parents that are not there."""
    n, user = F.col("n"), F.col("user_id")
    last = F.max("n").over(Window.partitionBy("user_id"))
    ring = F.when(n == last, F.lit(3)).otherwise(n + 1)
    heap = F.when(n % 29 == 0, -n).otherwise(F.nullif(F.floor(n / 2).cast("int"), F.lit(0)))
    parent = F.when(user % 3 == 0, ring).when(user % 3 == 1, F.nullif(n - 1, F.lit(0))).otherwise(heap)
    rows = tree(spark, sf).select("user_id", F.when(n % 41 == 0, 2).otherwise(n).cast("long").alias("element"), F.when(n % 37 == 0, 1).otherwise(n).cast("long").alias("order"), F.floor(n / 20).alias("page"), parent.cast("long").alias("parent"))
    pages = rows.select("user_id", "page").where("page <= 2").distinct()
    return documents.annotation_problems(rows, pages, "user_id")


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '\\p{{P}}', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS k FROM conversations),
r AS (SELECT conv_id, turn AS page, k FROM t WHERE turn % 5 <> 4), p AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN turn ELSE turn - 1 END AS page, turn, k FROM t WHERE turn % 3 <> 2),
pp AS (SELECT conv_id, page, flatten(list(k)) AS k FROM p GROUP BY 1, 2),
c AS (SELECT a.conv_id, a.page, sum(least(a.c, b.c)) AS common FROM (SELECT conv_id, page, x, count(*) AS c FROM (SELECT conv_id, page, unnest(k) AS x FROM r) GROUP BY ALL) a JOIN (SELECT conv_id, page, x, count(*) AS c FROM (SELECT conv_id, page, unnest(k) AS x FROM pp) GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.page = b.page AND a.x = b.x GROUP BY 1, 2),
f AS (SELECT coalesce(r.conv_id, pp.conv_id) AS conv_id, coalesce(r.page, pp.page) AS page, len(r.k) AS a, CASE WHEN r.k IS NULL OR pp.k IS NULL THEN 0.0 WHEN len(r.k) + len(pp.k) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (len(r.k) + len(pp.k)) END AS f1
  FROM r FULL JOIN pp ON pp.conv_id = r.conv_id AND pp.page = r.page LEFT JOIN c ON c.conv_id = r.conv_id AND c.page = r.page)
SELECT conv_id, count(*) AS pages, round(avg(f1), 6) AS content_f1, round(count(*) FILTER (a > 0 AND f1 >= 0.5) / nullif(count(*) FILTER (a > 0), 0), 6) AS coverage FROM f GROUP BY 1"""
)
def page_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages; in the prediction some are missing and some run into the page before, which may be one too many."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tx.prose_tokens(F.col("text")).alias("tokens"))
    reference = rows.where("turn % 5 <> 4").select("conv_id", F.col("turn").alias("page"), "tokens")
    page = F.when(F.col("turn") % 3 == 0, F.col("turn")).otherwise(F.col("turn") - 1)
    predicted = rows.where("turn % 3 <> 2").withColumn("page", page).groupBy("conv_id", "page").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    out = documents.page_scores(reference, predicted, "conv_id", 0.5)
    return out.select("conv_id", "pages", F.round("content_f1", 6).alias("content_f1"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {TREE_SQL} SELECT user_id, count(*) AS expected, count(*) FILTER (n % 4 <> 3 AND n % 9 <> 5 AND n % 8 <> 0) AS attributed FROM tree WHERE n % 6 <> 1 GROUP BY 1")
def page_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Elements with a page, twenty a page; every eighth is predicted a page late, others not at all or without a match."""
    n = F.col("n")
    page = F.floor(n / 20)
    references = tree(spark, sf).select("user_id", n.alias("element"), F.when(n % 6 != 1, page).alias("page"))
    predictions = tree(spark, sf).where(n % 4 != 3).select("user_id", (n + 1000).alias("element"), (page + F.when(n % 8 == 0, 1).otherwise(0)).alias("page"))
    matches = tree(spark, sf).where((n % 4 != 3) & (n % 9 != 5)).select("user_id", n.alias("reference"), (n + 1000).alias("prediction"))
    return documents.page_attribution(references, predictions, matches, "user_id")


@query(
    f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, event_type FROM events)
SELECT event_id, k = 42 AS number, user_id % 5 = 3 AS nested, event_type = 'click' AS entry, event_id % 4 = 2 AND event_id % 3 = 2 AS object_in_array, event_id % 2 = 0 AS null_value, user_id = 7 AND event_type = 'view' AS both, false AS wrong_kind, true AS empty FROM e"""
)
def json_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Properties with more levels around them, against patterns of each kind."""
    k = F.get_json_object("props", "$.k")
    number = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".0"))).otherwise(k)
    made = F.concat(
        F.lit('{"k": '), number, F.lit(', "user": {"id": '), F.col("user_id"), F.lit(', "group": "g'), F.col("user_id") % 5, F.lit('"}, "tags": ["'), F.col("event_type"), F.lit('", {"b": '), F.col("event_id") % 4,
        F.lit(', "c": [1, '), F.col("event_id") % 3, F.lit(']}], "none": '), F.when(F.col("event_id") % 2 == 0, "null").otherwise("0"), F.lit("}"),
    )
    patterns = {
        "number": {"k": 42}, "nested": {"user": {"group": "g3"}}, "entry": {"tags": ["click"]}, "object_in_array": {"tags": [{"b": 2, "c": [2]}]}, "null_value": {"none": None},
        "both": {"user": {"id": 7}, "tags": ["view"]}, "wrong_kind": {"k": "42"}, "empty": {},
    }
    rows = table(spark, sf, "events").select("event_id", made.alias("j"))
    return rows.select("event_id", *[structured.json_contains(F.col("j"), p).alias(name) for name, p in patterns.items()])


@query(
    """WITH r AS (SELECT event_id % 9 AS kind, event_id, value FROM events)
SELECT event_id, CASE WHEN kind = 0 THEN 'answered' WHEN kind = 1 THEN 'insufficient_evidence' END AS status, CASE WHEN kind = 0 THEN 'v' || event_id WHEN kind = 1 THEN '' END AS answer, CASE WHEN kind = 0 THEN 2 WHEN kind = 1 THEN 0 END AS n_citations,
CASE kind WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'repeated key' WHEN 3 THEN 'other keys' WHEN 4 THEN 'status or answer' WHEN 5 THEN 'citations' WHEN 6 THEN 'not JSON' WHEN 7 THEN 'other keys' ELSE 'status or answer' END AS reason FROM r"""
)
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that events stand for, most of them broken in one of seven ways."""
    i = F.col("event_id")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = (
        F.when(i % 9 == 0, said('{"status": "answered", "answer": "v', i, '", "citations": ["c', i, '", "d"]}'))
        .when(i % 9 == 1, said(' {"citations": [], "answer": "", "status": "insufficient_evidence"}'))
        .when(i % 9 == 2, said('{"status": "answered", "answer": "v', i, '", "citations": [], "answer": "w"}'))
        .when(i % 9 == 3, said('{"status": "answered", "answer": "v"}'))
        .when(i % 9 == 4, said('{"status": "maybe", "answer": "v', i, '", "citations": []}'))
        .when(i % 9 == 5, said('{"status": "answered", "answer": "v", "citations": ["c", ', i, "]}"))
        .when(i % 9 == 6, said('{"status": "answered", "answer": "v', i))
        .when(i % 9 == 7, said("[", i, "]"))
        .otherwise(said('{"status": "answered", "answer": NaN, "citations": []}'))
    )
    rows = table(spark, sf, "events").select("event_id", structured.parse_answer(made).alias("a"))
    return rows.select("event_id", "a.status", "a.answer", F.when(F.col("a.citations").isNotNull(), F.size("a.citations")).alias("n_citations"), "a.reason")


def order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """An HTML table for each order, a row a line item; by order some are broken: a cell outside a row, a row that stays open, a span of nothing."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("l"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    k = F.col("l_orderkey")
    cells = lambda x: F.concat(F.lit("<tr class=x><th colspan="), (x["l_linenumber"] % 3 + 1).cast("string"), F.lit("><b>p"), x["l_partkey"].cast("string"), F.lit("</b></th><td>s &amp; "), x["l_suppkey"].cast("string"), F.lit("</td></tr>"))
    body = F.array_join(F.transform("ls", cells), "\n")
    head = F.when(k % 7 == 1, "<td>lost</td>").when(k % 7 == 2, "<tr><td>open</td>").when(k % 7 == 3, "<tr><td rowspan=0>none</td></tr>").otherwise("")
    return rows.select("l_orderkey", "ls", F.concat(F.lit("<p>before</p><TABLE border=1><tbody>"), head, body, F.lit("</tbody></TABLE>")).alias("html"))


@query(
    """SELECT l_orderkey, CASE WHEN l_orderkey % 7 IN (1, 2, 3) THEN NULL ELSE md5('table,tbody,' || string_agg('tr,th 1 ' || (l_linenumber % 3 + 1) || ',/th,td 1 1,/td,/tr', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ',/tbody,/table') END AS events FROM lineitem GROUP BY 1"""
)
def table_structures(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_tables(spark, sf)
    return rows.select("l_orderkey", F.md5(F.array_join(structured.table_structure(F.col("html")), ",")).alias("events"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'formula' ELSE 'text' END AS kind, list_filter(string_split({PROSE.format("text")}, ' '), lambda x: x <> '') AS k FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN 'figure' ELSE kind END AS kind, CASE WHEN turn % 2 = 0 THEN list_slice(k, 1, len(k) // 2) ELSE k END AS k FROM t WHERE (conv_id + turn) % 5 <> 2),
m AS (SELECT t.conv_id, t.turn, t.kind, t.k AS a, p.k AS b FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.turn AND p.kind = t.kind WHERE t.turn % 7 <> 6),
f AS (SELECT conv_id, kind, count(*) AS matched, sum(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(b) / (len(a) + len(b)) END) AS content FROM m GROUP BY 1, 2),
r AS (SELECT conv_id, kind, count(*) AS expected FROM t GROUP BY 1, 2), q AS (SELECT conv_id, kind, count(*) AS found FROM p GROUP BY 1, 2),
j AS (SELECT coalesce(r.conv_id, q.conv_id) AS conv_id, coalesce(r.kind, q.kind) AS kind, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM r FULL JOIN q ON q.conv_id = r.conv_id AND q.kind = r.kind)
SELECT j.conv_id, j.kind, expected, found, coalesce(matched, 0) AS matched, round(coalesce(matched / nullif(found, 0), 0), 6) AS precision, round(coalesce(matched / nullif(expected, 0), 0), 6) AS recall,
  round(coalesce(2.0 * matched / nullif(expected + found, 0), 0), 6) AS f1, round(coalesce(content, 0) / nullif(expected, 0), 6) AS content_f1 FROM j LEFT JOIN f ON f.conv_id = j.conv_id AND f.kind = j.kind"""
)
def structured_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as elements of three kinds; predictions lack some, mistake the kind in a quarter of the conversations and halve every other text."""
    c, t = F.col("conv_id"), F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("table", "formula", "text"))), (t % 3 + 1).cast("int"))
    references = table(spark, sf, "conversations").select("conv_id", t.alias("element"), kind.alias("kind"), tx.prose_tokens(F.col("text")).alias("tokens"))
    e = F.col("element")
    half = F.slice("tokens", F.lit(1), F.floor(F.size("tokens") / 2).cast("int"))
    predictions = references.where((c + e) % 5 != 2).select("conv_id", "element", F.when(c % 4 == 1, "figure").otherwise(F.col("kind")).alias("kind"), F.when(e % 2 == 0, half).otherwise(F.col("tokens")).alias("tokens"))
    matches = predictions.where((c % 4 != 1) & (e % 7 != 6)).select("conv_id", e.alias("reference"), e.alias("prediction"))
    out = documents.kind_scores(references, predictions, matches, "conv_id")
    return out.select("conv_id", "kind", "expected", "found", "matched", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "content_f1")])

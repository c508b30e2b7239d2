"""Queries over sources, text and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, spans, store
from .base import CHUNKS_SQL, chunk_frame, chunk_rows, query, table

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query("SELECT kind, count(*) AS samples, count(DISTINCT id) AS ids FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'question', item_id FROM benchmark) GROUP BY kind")
def manifest_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    both = docs.unionByName(table(spark, sf, "benchmark").select(F.lit("question").alias("kind"), F.col("item_id").alias("id")))
    return both.groupBy("kind").agg(F.count("*").alias("samples"), F.countDistinct("id").alias("ids"))


@query("SELECT item_id, coalesce(b.text, '') <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS answerable FROM benchmark b")
def answerable_filter(spark: SparkSession, sf: str) -> DataFrame:
    from .base import gold_frame

    held = gold_frame(spark, sf).select(F.col("question").alias("item_id"), F.lit(True).alias("answerable")).distinct()
    items = table(spark, sf, "benchmark").select("item_id")
    return items.join(held, "item_id", "left").select("item_id", F.coalesce("answerable", F.lit(False)).alias("answerable"))


@query("SELECT source, count(*) AS rejected FROM documents WHERE source NOT IN ('src0','src1','src2') GROUP BY source")
def split_gate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where(~F.col("source").isin("src0", "src1", "src2"))
    return docs.groupBy("source").agg(F.count("*").alias("rejected"))


@query("SELECT p_brand AS component, p_name AS candidate, p_size AS revision FROM part WHERE p_size > 25 AND p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_name)")
def included_candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    first = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")
    kept = part.where("p_size > 25").join(first, "p_partkey", "left_semi")
    return kept.select(F.col("p_brand").alias("component"), F.col("p_name").alias("candidate"), F.col("p_size").alias("revision"))


#: Kinds by file extension, fixed values.
KINDS = {".html": "page", ".htm": "page", ".pdf": "pdf", ".docx": "docx", ".png": "image", ".jpg": "image", ".mp3": "audio", ".mp4": "video"}


@query(r"SELECT page_id, CASE regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\.[a-z0-9]+$') WHEN '.html' THEN 'page' WHEN '.htm' THEN 'page' WHEN '.pdf' THEN 'pdf' ELSE 'unknown' END AS kind FROM pages")
def file_classes(spark: SparkSession, sf: str) -> DataFrame:
    extension = F.regexp_extract(F.lower(F.regexp_replace("url", "[?#].*$", "")), r"\.[a-z0-9]+$", 0)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(spark, sf, "pages").select("page_id", F.coalesce(kinds[F.nullif(extension, F.lit(""))], F.lit("unknown")).alias("kind"))


@query("SELECT d.doc_id, sha256('v1|' || d.text || '|' || d.lang) AS cache_key FROM documents d WHERE sha256('v1|' || d.text || '|' || d.lang) NOT IN (SELECT sha256('v1|' || text || '|' || lang) FROM documents WHERE source IN ('src0','src1'))")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.concat(F.lit("v1|"), "text", F.lit("|"), "lang"), 256).alias("cache_key"))
    cached = keyed.where(F.col("source").isin("src0", "src1")).select("cache_key")
    return keyed.select("doc_id", "cache_key").join(cached, "cache_key", "left_anti")


@query(r"""SELECT doc_id, md5(out) AS digest, length(out) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[­]', '', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[\t\f\x0B]+', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS o2,
  regexp_replace(o2, '^\s+|\s+$', '', 'g') AS out FROM documents)""")
def normalize_conservative(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("out"))
    return out.select("doc_id", F.md5("out").alias("digest"), F.length("out").alias("n"))


PROSE = r"trim(regexp_replace(regexp_replace(lower({0}), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS kinds, t[1] AS first_token FROM (SELECT doc_id, list_filter(string_split({PROSE.format('text')}, ' '), lambda x: x <> '') AS t FROM documents)")
def prose_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", tx.prose_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("kinds"), F.get("t", F.lit(0)).alias("first_token"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    per = terms.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(f"SELECT doc_id, len(l) AS n_lines, len(list_distinct(l)) AS n_distinct FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {PROSE.format('x')}), lambda x: x <> '') AS l FROM documents)")
def normalized_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tx.lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.size(F.array_distinct("l")).alias("n_distinct"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the next one of its conversation, as reference and hypothesis."""
    rows = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.withColumn("hypothesis", F.lead("text").over(w)).where("hypothesis is not null")
    return pairs.select("conv_id", "turn", F.col("text").alias("reference"), "hypothesis")


PAIRS_SQL = "pairs AS (SELECT conv_id, turn, text AS reference, h AS hypothesis FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations) WHERE h IS NOT NULL)"


# DuckDB compares bytes, so each pair's letters beyond ASCII become control characters, of which 28 are free.
CONTROLS = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 11, 127))


@query(
    f"""WITH {PAIRS_SQL}, m AS (SELECT conv_id, turn, coalesce(reference, '') AS r, hypothesis AS h, array_to_string(list_distinct(regexp_extract_all(coalesce(reference, '') || hypothesis, '[^\\x00-\\x7F]')), '') AS odd FROM pairs),
n AS (SELECT conv_id, turn, CASE WHEN odd = '' THEN r ELSE translate(r, odd, substr({CONTROLS}, 1, length(odd))) END AS r, CASE WHEN odd = '' THEN h ELSE translate(h, odd, substr({CONTROLS}, 1, length(odd))) END AS h FROM m)
SELECT conv_id, turn, round(levenshtein(r, h) / greatest(1, length(r)), 6) AS cer FROM n"""
)
def cer_by_pair(spark: SparkSession, sf: str) -> DataFrame:
    cer = tx.character_error_rate(F.coalesce("reference", F.lit("")), F.col("hypothesis"))
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(cer, 6).alias("cer"))


@query()
def wer_by_pair(spark: SparkSession, sf: str) -> DataFrame:
    p = turn_pairs(spark, sf).withColumn("r", tx.prose_tokens(F.col("reference"))).withColumn("h", tx.prose_tokens(F.col("hypothesis")))
    return p.select("conv_id", "turn", F.round(tx.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN source ELSE text END) AS source_id, doc_id || ':0-' || length(text) || ':' || substr(sha256(text), 1, 12) AS chunk_id FROM documents")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    logical = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit(" "))
    whole = tx.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.length("text"), F.col("text"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, tx.source_id(logical, F.col("text"))).otherwise(F.sha2("text", 256)).alias("source_id"), whole.alias("chunk_id"))


@query("SELECT event_id, list_bool_and(list_transform(c, lambda x: CAST(x AS INT) BETWEEN 1 AND 5)) AS valid, len(c) AS cited FROM (SELECT event_id, regexp_extract_all('see [' || (event_id % 7) || '] and [' || (user_id % 6 + 1) || ']', '\\[(\\d+)\\]', 1) AS c FROM events)".replace("\\\\", "\\"))
def citations_valid(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit("see ["), F.col("event_id") % 7, F.lit("] and ["), F.col("user_id") % 6 + 1, F.lit("]"))
    rows = table(spark, sf, "events").select("event_id", answer.alias("answer"))
    return rows.select("event_id", tx.citations_valid(F.col("answer"), F.lit(5), "no evidence").alias("valid"), F.size(tx.citations(F.col("answer"))).alias("cited"))


@query("SELECT DISTINCT 'part_' || translate(lower(p_type), '- ', '__') AS label, p_brand FROM part")
def group_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(tx.group_label(F.lit("part"), F.col("p_type")).alias("label"), "p_brand").distinct()


@query("SELECT p_partkey, CAST(floor(p_size * 1024 * 1024) AS BIGINT) AS bytes FROM part")
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.bytes_of(F.concat(F.col("p_size").cast("string"), F.lit(".0MiB"))).alias("bytes"))


@query("SELECT event_type, max(value) AS peak, max(value * 2) AS peak_other, count(*) AS samples FROM events GROUP BY event_type")
def peak_resources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("value").alias("peak"), F.max(F.col("value") * 2).alias("peak_other"), F.count("*").alias("samples"))


@query("SELECT source_id, string_agg(page, ',' ORDER BY f, k) AS pages FROM (SELECT l_orderkey AS source_id, l_suppkey AS k, CAST(l_suppkey AS VARCHAR) AS page, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def page_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    return rows.select(F.col("l_orderkey").alias("source_id"), F.array_join(F.array_distinct(F.col("l.l_suppkey")), ",").alias("pages"))


# Chunks and spans


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, s AS start, e AS \"end\", tokens, count(*) OVER (PARTITION BY doc_id) AS total_chunks, doc_id || ':' || s || '-' || e || ':' || substr(sha256(chunk), 1, 12) AS chunk_id FROM chunk")
def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf).select("doc_id", "chunk_index", "start", "end", "tokens", "total_chunks", "chunk_id")


# Sentence bodies, and runs of marks and line ends that belong to none, cover a text, so that running lengths are offsets. A
# sentence runs from the end of the body before it to the end of its own.
SENTENCES_SQL = r"""piece AS (SELECT doc_id, i, p, size, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e0 FROM (
  SELECT doc_id, size, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
    SELECT doc_id, length(text) AS size, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n|$)|[.!?\n]+') AS ps FROM documents))),
body AS (SELECT doc_id, size, e0, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM piece WHERE NOT regexp_matches(p, '^[.!?\n]')),
sent AS (SELECT doc_id, i, n, CAST(coalesce(lag(e0) OVER (PARTITION BY doc_id ORDER BY i), 0) AS INT) AS s, CAST(CASE WHEN i = n THEN size ELSE e0 END AS INT) AS e FROM body
  UNION ALL SELECT doc_id, 1, 1, 0, CAST(length(text) AS INT) FROM documents WHERE regexp_full_match(text, '[.!?\n]*[.!?][.!?\n]*'))"""


@query(f'WITH {SENTENCES_SQL} SELECT doc_id, i - 1 AS chunk_index, s AS start, e AS "end" FROM sent')
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.explode_spans(table(spark, sf, "documents"), chunking.sentence_spans).select("doc_id", "chunk_index", "start", "end")


@query(f'WITH {SENTENCES_SQL}, w AS (SELECT doc_id, n, unnest(range(0, CAST(1 + ceil(greatest(0, n - 8) / 6.0) AS BIGINT))) AS c FROM (SELECT DISTINCT doc_id, n FROM sent)) SELECT w.doc_id, c AS chunk_index, a.s AS start, b.e AS "end" FROM w JOIN sent a ON a.doc_id = w.doc_id AND a.i = 6 * c + 1 JOIN sent b ON b.doc_id = w.doc_id AND b.i = least(w.n, 6 * c + 8)')
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.explode_spans(table(spark, sf, "documents"), chunking.sentence_windows).select("doc_id", "chunk_index", "start", "end")


def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_linenumber") * 7 + F.col("l_suppkey") % 5
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), start.cast("int").alias("start"), F.round(start + F.col("l_quantity") / 4).cast("int").alias("end"))


@query("WITH s AS (SELECT l_orderkey AS k, CAST(l_linenumber * 7 + l_suppkey % 5 AS INT) AS s, CAST(round(l_linenumber * 7 + l_suppkey % 5 + l_quantity / 4) AS INT) AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT k, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY k, i")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return spans.union_spans(line_spans(spark, sf), ["k"])


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_linenumber * 7 + l_suppkey % 5 AS INT) AS s, CAST(round(l_linenumber * 7 + l_suppkey % 5 + l_quantity / 4) AS INT) AS e FROM lineitem) SELECT a.k, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS common FROM s a JOIN s b ON a.k = b.k AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e GROUP BY a.k")
def span_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = line_spans(spark, sf)
    a, b = s.select("k", F.col("start").alias("l_start"), F.col("end").alias("l_end")), s.select("k", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = spans.bucketed_overlap(a, b, "k", 16)
    return pairs.groupBy("k").agg(F.count("*").alias("pairs"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("common"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(*) FILTER (s < 0 OR e > length(d.text) OR s >= e) AS out_of_range, count(*) FILTER (len(regexp_extract_all(chunk, '[\\p{{L}}\\p{{N}}_]+')) <> tokens) AS miscounted, count(*) - count(DISTINCT position) AS repeated, (SELECT count(*) FROM documents x WHERE x.doc_id NOT IN (SELECT doc_id FROM chunk)) AS omitted FROM chunk c JOIN documents d USING (doc_id)")
def chunk_integrity(spark: SparkSession, sf: str) -> DataFrame:
    c, docs = chunk_frame(spark, sf, texts=True), table(spark, sf, "documents")
    rows = c.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    recount = F.size(F.regexp_extract_all("chunk", F.lit(tx.TOKEN), F.lit(0)))
    found = rows.agg(F.count("*").alias("chunks"), F.count_if((F.col("start") < 0) | (F.col("end") > F.col("n")) | (F.col("start") >= F.col("end"))).alias("out_of_range"), F.count_if(recount != F.col("tokens")).alias("miscounted"), (F.count("*") - F.countDistinct("position")).alias("repeated"))
    omitted = docs.join(c.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("omitted"))
    return found.join(omitted)  # one row each


@query("SELECT conv_id, turn, CAST(s AS INT) AS start, CAST(s + length(text) AS INT) AS \"end\" FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)")
def offset_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans.rebuild_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2)
    return rows.select("conv_id", "turn", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("WITH p AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s FROM conversations) SELECT conv_id, turn, greatest(s, 100) AS clip_start, least(s + length(text), 400) AS clip_end, md5(substr(text, CAST(greatest(s, 100) - s + 1 AS BIGINT), CAST(least(s + length(text), 400) - greatest(s, 100) AS BIGINT))) AS clip FROM p WHERE s < 400 AND s + length(text) > 100")
def project_locations(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans.rebuild_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2)
    rows = rows.select("conv_id", "turn", F.col("start").cast("int").alias("seg_start"), F.col("end").cast("int").alias("seg_end"), F.col("text").alias("seg_text"))
    return spans.project(rows, F.lit(100), F.lit(400)).select("conv_id", "turn", "clip_start", "clip_end", F.md5("clip").alias("clip"))


@query("SELECT o_orderkey AS k, unnest(range(0, CAST(1 + greatest(0, ceil((d - 30) / 28.0)) AS BIGINT))) * 28 AS start FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS INT) + 1 AS d FROM orders)")
def sliding_media_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.floor(F.col("o_totalprice") / 1000) + 1).cast("int").alias("d"))
    return rows.select("k", F.explode(spans.windows(30, 28, F.col("d"))).alias("start"))


@query("WITH RECURSIVE item AS (SELECT p_partkey AS item, p_partkey // 3 AS parent, p_size % 3 = 0 AS kept FROM part), up AS (SELECT item, parent AS place FROM item UNION SELECT u.item, i.parent FROM up u JOIN item i ON i.item = u.place WHERE NOT i.kept) SELECT item, max(CASE WHEN a.kept THEN place END) AS ancestor FROM up LEFT JOIN (SELECT item AS x, kept FROM item) a ON a.x = place GROUP BY item")
def nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.floor(F.col("p_partkey") / 3).alias("parent"), (F.col("p_size") % 3 == 0).alias("kept"))
    return spans.nearest_kept_ancestor(items)


@query("SELECT l_orderkey AS k, r, c, max(l_partkey) AS cell FROM (SELECT l_orderkey, l_partkey, unnest(range(l_linenumber, l_linenumber + 1 + l_suppkey % 2)) AS r, l_linenumber % 2 AS c0, l_suppkey % 3 AS w FROM lineitem), LATERAL (SELECT unnest(range(c0, c0 + 1 + w)) AS c) GROUP BY 1, 2, 3")
def table_grid(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", F.explode(F.sequence(n, n + (s % 2).cast("int"))).alias("r"), n, s)
    cells = cells.select("k", "l_partkey", F.col("r").cast("long").alias("r"), F.explode(F.sequence((n % 2).cast("long"), (n % 2 + s % 3).cast("long"))).alias("c"))
    return cells.groupBy("k", "r", "c").agg(F.max("l_partkey").alias("cell"))


@query("SELECT p_partkey, round(least(1, greatest(0, (p_size - 5) / 40.0)), 6) AS x1, round(least(1, greatest(0, 1 - p_retailprice / 2000)), 6) AS y1 FROM part")
def box_normalize(spark: SparkSession, sf: str) -> DataFrame:
    clamp = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)
    return table(spark, sf, "part").select("p_partkey", clamp((F.col("p_size") - 5) / 40.0).alias("x1"), clamp(1 - F.col("p_retailprice") / 2000).alias("y1"))


@query("SELECT conv_id, sha256(string_agg(role || '|' || text, chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
def document_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit("|"), "text").alias("p")))).alias("all"))
    return rows.select("conv_id", F.sha2(F.array_join(F.col("all.p"), "\n"), 256).alias("fingerprint"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 10 = 3")
def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("user_id") % 10 == 3)).select("event_id", "value")


# The record store: id, source_id and text of documents.

RECORDS = "rec AS (SELECT doc_id AS id, source AS source_id, n_chars AS n FROM documents), new AS (SELECT id, source_id, n + 1 AS n FROM rec WHERE id % 4 = 0 UNION ALL SELECT id + 1000000, source_id, n FROM rec WHERE id % 10 = 1)"


def records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rec = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("n_chars").alias("n"))
    new = rec.where("id % 4 = 0").withColumn("n", F.col("n") + 1).unionByName(rec.where("id % 10 = 1").withColumn("id", F.col("id") + 1_000_000))
    return rec, new


@query(f"WITH {RECORDS} SELECT * FROM rec WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return store.upsert(*records(spark, sf))


@query(f"WITH {RECORDS}, picked AS (SELECT * FROM new WHERE source_id IN ('src1', 'src2')) SELECT * FROM rec WHERE source_id NOT IN (SELECT source_id FROM picked) UNION ALL SELECT * FROM picked")
def replace_document(spark: SparkSession, sf: str) -> DataFrame:
    rec, new = records(spark, sf)
    return store.replace_document(rec, new.where(F.col("source_id").isin("src1", "src2")))


@query(f"WITH {RECORDS} SELECT source_id, count(*) AS n_left FROM rec WHERE id NOT IN (SELECT id FROM new) GROUP BY source_id")
def delete_records(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete(*records(spark, sf)).groupBy("source_id").agg(F.count("*").alias("n_left"))


@query(f"WITH {RECORDS} SELECT coalesce(r.id, n.id) AS id, CASE WHEN r.id IS NULL THEN 'unexpected' WHEN n.id IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM rec r FULL JOIN new n ON r.id = n.id WHERE r.id IS NULL OR n.id IS NULL OR r.n <> n.n")
def inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    rec, new = records(spark, sf)
    return store.inventory_diff(new, rec, "id", ["source_id", "n"])


@query("SELECT name, id, checksum FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ready DESC, id DESC) AS r FROM (SELECT source AS name, doc_id AS id, md5(text) AS checksum, doc_id % 3 > 0 AS ready FROM documents)) WHERE r = 1")
def upload_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("source").alias("name"), F.struct((F.col("doc_id") % 3 > 0).alias("ready"), F.col("doc_id").alias("id"), F.md5("text").alias("checksum")).alias("s"))
    return rows.groupBy("name").agg(F.max("s").alias("s")).select("name", "s.id", "s.checksum")

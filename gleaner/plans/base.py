"""Registry of queries, and the frames that many of them start from."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.chunking import chunks, first_places
from ..sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Frames of the query that is being built.
_FRAMES: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("frames", default=None)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with the SQL that says the same if there is any."""

    def add(f: Query) -> Query:
        @wraps(f)
        def build(spark: SparkSession, sf: str) -> DataFrame:
            if _FRAMES.get() is not None:  # a query within another one shares its frames
                return f(spark, sf)
            token = _FRAMES.set({})
            try:
                return f(spark, sf)
            finally:
                _FRAMES.reset(token)

        QUERIES[f.__name__] = build
        if sql is not None:
            SQL[f.__name__] = sql
        return build

    return add


def once(tag: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Build a frame once within a query, however often it is asked for; with a tag it is written and read again."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def frame(spark: SparkSession, sf: str, *more: object, **named: object) -> DataFrame:
            made, key = _FRAMES.get(), (f.__name__, sf, more, tuple(sorted(named.items())))
            if made is None:
                return f(spark, sf, *more, **named)
            if key not in made:
                made[key] = written(f(spark, sf, *more, **named), tag) if tag else f(spark, sf, *more, **named)
            return made[key]

        return frame

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table below this for each core, and of fewer files than half the cores, is dealt out anew, as it often lies in one row
#: group and would be one task.
SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small and of few files; other tables have splits enough and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES and 2 * len(df.inputFiles()) < cores else df


#: Chunk size and overlap in tokens, ranking depth and cut-offs of the retrieval queries.
SIZE, OVERLAP, DEPTH = 64, 16, 20


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token chunks with a position that orders them: doc_id, chunk_index, start, end, tokens, chunk, position, ...

    The position holds the document in its upper and the index in its lower 32 bits; a doc_id beyond 31 bits is an error.
    """
    found = chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), SIZE, OVERLAP)
    return found.withColumn("position", F.col("doc_id") * (1 << 32) + F.col("chunk_index"))


@once("chunks")
def _chunk_words(spark: SparkSession, sf_dir: str, texts: bool) -> DataFrame:
    """chunk_rows with their terms as one string, which takes less room than an array: no term holds a space."""
    found = chunk_rows(spark, sf_dir).withColumn("words", F.concat_ws(" ", tokens(F.col("chunk")))).drop("chunk_id")
    return found if texts else found.drop("chunk")


def chunk_frame(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """chunk_rows with their terms, written once for a query that looks at them several times; with their texts if it needs these."""
    terms = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
    return _chunk_words(spark, sf_dir, texts).withColumn("terms", terms).drop("words")


CHUNKS_SQL = rf"""
tok AS (SELECT doc_id, tk, gp, unnest(range(1, len(tk) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS tk, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') AS gp FROM documents)),
pos AS (SELECT doc_id, i, len(tk) AS n, sum(length(gp[i]) + length(tk[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(tk[i]) AS l FROM tok),
cut AS (SELECT doc_id, n, unnest(range(0, CAST(1 + ceil(greatest(0, n - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT))) AS c FROM (SELECT DISTINCT doc_id, n FROM pos)),
chunk AS (SELECT cut.doc_id, cut.c AS chunk_index, a.e - a.l AS s, b.e AS e, b.i - a.i + 1 AS tokens,
  substr(d.text, CAST(a.e - a.l + 1 AS BIGINT), CAST(b.e - a.e + a.l AS BIGINT)) AS chunk, cut.doc_id * 4294967296 + cut.c AS position
  FROM cut JOIN pos a ON a.doc_id = cut.doc_id AND a.i = {SIZE - OVERLAP} * cut.c + 1
  JOIN pos b ON b.doc_id = cut.doc_id AND b.i = least(cut.n, {SIZE - OVERLAP} * cut.c + {SIZE}) JOIN documents d ON d.doc_id = cut.doc_id)"""


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    since = F.col(ts) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    whole = F.extract(F.lit("DAY"), since) * 86_400 + F.extract(F.lit("HOUR"), since) * 3600 + F.extract(F.lit("MINUTE"), since) * 60
    return whole.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


@once("gold")
def gold_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence: the first place of each benchmark item in each document that holds it: question, doc_id, unit, u_start, u_end."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("item"))
    found = first_places(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), items, "question", "item")
    return found.select("question", "doc_id", F.concat("question", F.lit(":"), "doc_id").alias("unit"), "u_start", "u_end")


GOLD_SQL = r"""
gold AS (SELECT b.item_id AS question, d.doc_id, b.item_id || ':' || d.doc_id AS unit, instr(d.text, b.text) - 1 AS u_start, instr(d.text, b.text) - 1 + length(b.text) AS u_end
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"""

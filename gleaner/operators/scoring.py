"""Scores of answers, contexts and hits: reranking hooks, embedding hooks, contexts, citations, labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import tokens
from .retrieval import rank


def lexical_score(query: str, text: str) -> float:
    """Share of the query's distinct words that the text holds: the deterministic default of rerank()."""
    words = set(query.lower().split())
    return len(words & set(text.lower().split())) / len(words) if words else 0.0


def rerank(pool: DataFrame, score: Callable[[str, str], float] = lexical_score, longest: int = 100_000) -> DataFrame:
    """Order pools (query_id, query, item, rank, text) anew by score, ties by the former rank; too long texts raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if (b.text.str.len() > longest).any():
                raise ValueError("a text is too long to be scored whole")
            b["score"] = [round(float(score(q, t)), 9) for q, t in zip(b["query"], b.text, strict=True)]
            yield b[["query_id", "item", "rank", "score"]]

    scored = pool.select("query_id", "query", "item", F.col("rank").cast("int").alias("rank"), "text").mapInPandas(run, "query_id long, item long, rank int, score double")
    return rank(scored, ["query_id"], [F.desc("score"), F.asc("rank")], name="new_rank")


def embed(texts: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """key and a unit vector of hashed token counts: the deterministic default where no model is plugged in."""
    counts = texts.select(key, F.explode(tokens(F.col(text))).alias("t")).groupBy(key, F.pmod(F.xxhash64("t"), F.lit(dimension)).cast("int").alias("d")).agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return maps.select(key, vector.alias("embedding"))


def render_context(hits: DataFrame) -> DataFrame:
    """query_id and the context text: "[rank] source" and the text of each hit, parted by blank lines."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source="), F.col("source"), F.lit("\n"), F.col("text"))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("all"))
    return rows.select("query_id", F.array_join(F.col("all.b"), "\n\n").alias("context"))


def filter_violations(hits: DataFrame, trusted: DataFrame, key: str, expected: dict[str, Column]) -> DataFrame:
    """Hits whose trusted metadata misses an expected value, whatever the hit itself says; unknown keys violate too."""
    wrong = F.lit(False)
    for name, value in sorted(expected.items()):
        wrong = wrong | ~F.col(f"t_{name}").eqNullSafe(value)
    own = trusted.select(key, *[F.col(c).alias(f"t_{c}") for c in expected])
    return hits.join(own, key, "left").withColumn("violates", wrong).drop(*[f"t_{c}" for c in expected])


def citation_scores(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """question, precision, recall, f1 of cited blocks: cited (question, block, unit or null), gold (question, unit)."""
    blocks = cited.groupBy("question", "block").agg(F.max(F.col("unit").isNotNull().cast("int")).alias("good"))
    p = blocks.groupBy("question").agg(F.avg("good").alias("precision"))
    hit = cited.where("unit is not null").select("question", "unit").distinct().join(gold.distinct(), ["question", "unit"]).groupBy("question").agg(F.count("*").alias("hit"))
    total = gold.distinct().groupBy("question").agg(F.count("*").alias("units"))
    rows = total.join(hit, "question", "left").join(p, "question", "left").select("question", F.coalesce("precision", F.lit(0.0)).alias("precision"), (F.coalesce("hit", F.lit(0)) / F.col("units")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def semantic_breaks(sentences: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, i, similarity to the sentence before, and the group that a break starts.

    sentences: doc_id, i, vector (unit). A break is a similarity within the lowest `share` of the document's; none if
    they are all alike.
    """
    w = Window.partitionBy("doc_id").orderBy("i")
    dot = F.aggregate(F.zip_with("vector", "before", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    rows = sentences.withColumn("before", F.lag("vector").over(w)).withColumn("similarity", F.when(F.col("before").isNotNull(), F.round(dot, 6)))
    cut = rows.groupBy("doc_id").agg(F.percentile("similarity", F.lit(share)).alias("cut"), (F.max("similarity") - F.min("similarity")).alias("spread"))
    broken = rows.join(cut, "doc_id").withColumn("breaks", (F.col("similarity") <= F.col("cut")) & (F.col("spread") > 1e-9))
    group = F.sum(F.coalesce(F.col("breaks"), F.lit(False)).cast("int")).over(w)
    return broken.withColumn("part", group).select("doc_id", "i", "similarity", "part")


@F.pandas_udf(StringType())
def stable_uuid(values: pd.Series) -> pd.Series:
    """Version 5 UUIDs of ids."""
    return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_URL, v)))

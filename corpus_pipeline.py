"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import bpe, jaccard, mixing, quality, suffixes
from gleaner.llm.common import materialise, table
from gleaner.llm.queries import TOKENIZER, quality_machine


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject."""
    scored = quality.score(docs, quality_machine(spark, sf_dir, docs))
    return scored.where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last), then the smallest print of its text.

    Rows are told apart by doc_id and print, so a doc_id with several texts is several documents. Texts without words are
    in no group and stay; rows equal in doc_id and text count once, and the one whose other columns come first stays.
    """
    printed = docs.withColumn("__print", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = materialise(jaccard.join(printed.select("doc_id", "text", "__print"), carry=("__print",)), "pipeline-groups")
    named = found.select(F.col("doc_id").alias("__doc"), "__print", F.coalesce(F.col("group_id").cast("string"), F.concat_ws(":", F.lit("alone"), "doc_id", "__print")).alias("__group"))
    first = named.groupBy("__group").agg(F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", "__print")).alias("f"))
    stay = materialise(first.select("f.__doc", F.col("f.__print").alias("__print2")).distinct(), "pipeline-stay")
    one = printed.join(stay, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__print") == F.col("__print2")), "left_semi")
    repeated = found.groupBy("doc_id", "__print").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return one.select(*docs.columns)  # no row twice, so texts need not meet again
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id", "__print").orderBy(F.col("text").isNull(), *others))
    return one.withColumn("__place", place).where("__place = 1").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents hold, cut at whole characters; n_chars follows."""
    left = suffixes.remove(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    left = left.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return left.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.mix(docs).where("copies > 0")
    return copies.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__copy")).drop("__copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    path = public_tokenizers.path(TOKENIZER)
    printed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("print"))
    coded = bpe.encode(printed, path, public_tokenizers.PATTERN, carry=["doc_id", "print"])
    same = F.sha2(bpe.decode(F.col("ids"), path), 256) == F.col("print")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


#: In this order; all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]

#: None of the first three stages can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sources and sinks: manifests, selection tables, mirrored result tables. Schemas are declared, never inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that a manifest must have, fixed values.
HEADER = ("name", "version", "task", "split", "source", "license", "revision", "checksum", "preprocessing_version", "split_seed", "samples")
INTERVAL = "struct<document_id: string, start: int, end: int>"
SAMPLE = f"id string, kind string, document_id string, source string, text string, question string, answer string, answerable boolean, answer_type string, evidence_type string, evidence array<struct<id: string, document_id: string, start: int, end: int, evidence_type: string, intervals: array<{INTERVAL}>>>"


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checksum(samples: list) -> str:
    return hashlib.sha256(canonical_json(samples).encode()).hexdigest()


def _problem(whole: object, splits: tuple[str, ...] | None) -> str | None:
    """What is wrong with a parsed manifest; null if nothing is."""
    if not isinstance(whole, dict):
        return "the manifest is no object"
    if missing := [f for f in HEADER if f not in whole]:
        return f"manifest without {', '.join(missing)}"
    if unknown := sorted(set(whole) - set(HEADER)):
        return f"manifest with unknown {', '.join(unknown)}"
    samples = whole["samples"]
    ids = [s.get("id") if isinstance(s, dict) else None for s in samples] if isinstance(samples, list) else []
    if not ids or not all(isinstance(i, str) and i for i in ids) or len(set(ids)) < len(ids):
        return "samples need unique ids"
    if checksum(samples) != whole["checksum"]:
        return "the checksum does not match the samples"
    if splits is not None and whole["split"] not in splits:
        return f"split {whole['split']!r} is not allowed here"
    return None


def read_manifest(spark: SparkSession, path: str, splits: tuple[str, ...] | None = None) -> tuple[dict, DataFrame]:
    """Header and samples of a manifest (one JSON file), both checked: fields, unique ids, checksum, split.

    The file is parsed and checked in a task, since a checksum is over the whole of it; the driver sees the header or the
    first problem (a ValueError), and samples go on as rows of a declared schema.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    whole = json.loads(text)
                except ValueError:
                    whole = None
                problem = _problem(whole, splits)
                rows = [] if problem else [json.dumps(s) for s in whole["samples"]]
                header = None if problem else json.dumps({k: v for k, v in whole.items() if k != "samples"})
                first = ["header", problem, header]
                kinds = [["sample"] * len(rows), [None] * len(rows), rows]
                yield pa.RecordBatch.from_arrays([pa.array([x, *more], pa.string()) for x, more in zip(first, kinds, strict=True)], ["part", "problem", "value"])

    parsed = spark.read.text(path, wholetext=True).mapInArrow(parse, "part string, problem string, value string")
    header = parsed.where("part = 'header'").first()
    if header is None or header.problem:
        raise ValueError(header.problem if header else "the manifest is empty")
    return json.loads(header.value), parsed.where("part = 'sample'").select(F.from_json("value", SAMPLE).alias("s")).select("s.*")


def seal_manifest(spark: SparkSession, header: dict, samples: list, path: str) -> None:
    """Write a manifest with the checksum of its samples, then read it back to check it."""
    text = canonical_json(header | {"checksum": checksum(samples), "samples": samples})
    jvm = spark.sparkContext._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(staged, target)
    read_manifest(spark, path)


#: Columns of the selection table, fixed values.
SELECTION = "component string, candidate string, revision string, decision string, reason string, source string, metric string, approx_params_b double, public_score double"


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Included candidates of a selection CSV; repeated keys and included rows without revision are errors."""
    rows = spark.read.schema(SELECTION).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if not rows.groupBy("component", "candidate").count().where("count > 1").isEmpty():
        raise ValueError("a candidate is there twice")
    kept = rows.where("decision = 'include'")
    if not kept.where("revision is null or trim(revision) = ''").isEmpty():
        raise ValueError("an included candidate has no revision")
    return kept


def evidence_problems(samples: DataFrame) -> DataFrame:
    """id and rule of everything that is wrong with the evidence of questions."""
    docs = samples.where("kind = 'document'").select(F.col("id").alias("document_id"), F.col("text").alias("body"))
    units = samples.where("kind = 'question'").select("id", "evidence_type", F.explode_outer("evidence").alias("e"))
    one = F.array(F.struct(F.col("e.document_id").alias("document_id"), F.col("e.start").alias("start"), F.col("e.end").alias("end")))
    spans = units.select("id", "e", F.posexplode(F.coalesce("e.intervals", one)).alias("n", "i")).where("e is not null")
    spans = spans.select("id", F.col("e.id").alias("unit"), F.col("e.document_id").alias("unit_document"), "n", "i.*")
    placed = spans.join(docs, "document_id", "left")
    rules = [
        (placed.where("body is null"), "unknown_document"),
        (placed.where("body is not null and (start < 0 or end > length(body) or start >= end)"), "out_of_range"),
        (placed.where("document_id <> unit_document"), "several_documents"),
        (spans.where("n = 0").groupBy("id", "unit").count().where("count > 1").select("id"), "repeated_unit"),
        (spans.alias("a").join(spans.alias("b"), ["id", "unit"]).where("b.n = a.n + 1 and b.start < a.end").select("id"), "overlapping_intervals"),
    ]
    out = None
    for rows, name in rules:
        found = rows.select("id", F.lit(name).alias("rule")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def write_mirrors(rows: DataFrame, folder: str, order: list[str]) -> str:
    """Parquet and CSV of one table; both are read again and must hold the same rows. Returns the table's hash."""
    spark, columns = rows.sparkSession, rows.columns
    rows.write.mode("overwrite").parquet(f"{folder}/parquet")
    saved = spark.read.schema(rows.schema).parquet(f"{folder}/parquet")
    text = saved.select(*[F.col(c).cast("string").alias(c) for c in columns])
    text.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("nullValue", "\\N").csv(f"{folder}/csv")
    again = spark.read.schema(text.schema).option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(f"{folder}/csv")
    if not text.exceptAll(again).isEmpty() or not again.exceptAll(text).isEmpty():
        raise ValueError("the mirrors differ")
    digest = F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")
    # Order-free: the hash of the sorted counts of row hashes, folded by 256 prefixes so that no task holds all rows.
    part = text.select(digest).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return hashlib.sha256("".join(r.h for r in sorted(part.collect())).encode()).hexdigest()

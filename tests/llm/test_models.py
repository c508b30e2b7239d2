"""Results of registered queries against brute-force versions: scores of all pairs of features, rates by bisection, copies by sorting."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language, mixing, quality, queries


def test_scores_of_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = queries.quality_machine(spark, sf_dir, docs)
    rows = docs.collect()
    held = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out(F.col("doc_id"), 3, 1).alias("h")).collect()}
    ends, buckets, values, stats = quality.features(pa.array([r.text for r in rows], pa.string()), np.array([float(r.n_chars or 0) for r in rows]))
    x = np.zeros((len(rows), quality.BUCKETS + quality.N_STATS))
    for i in range(len(rows)):
        for b, v in zip(buckets[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]], strict=True):
            x[i, b] += v
    x[:, quality.BUCKETS :] = machine.standard(stats)
    v = machine.factors.astype(np.float64)
    want = []
    for row in x:
        on = np.flatnonzero(row)
        gram = (v[on] @ v[on].T) * np.outer(row[on], row[on])  # every pair of features, one by one
        z = machine.bias + machine.weights[on].astype(np.float64) @ row[on] + np.triu(gram, 1).sum()
        want.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert g.score == pytest.approx(w, abs=1e-4) and g.predicted == int(g.score >= 0.5) and g.held_out == held[r.doc_id]


def test_one_label_and_none(spark):
    kind = "doc_id long, text string, n_chars long, quality int"
    rows = [(i, f"some words {i}", 12, 1) for i in range(5)] + [(None, "no key", 6, 1), (9, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    good = quality.score(docs, quality.train(docs)).collect()
    assert {r.predicted for r in good} == {1} and len({r.score for r in good}) == 1
    none = quality.score(docs, quality.train(docs.limit(0))).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(rows)


def test_rates_and_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    draw = {r.doc_id: r.d for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 1).alias("d")).collect()}
    got = queries.QUERIES["op2_mixing"](spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    by = defaultdict(list)
    for r in got:
        by[source[r.doc_id]].append(r)
    for rows in by.values():
        total, target = sum(r.size for r in rows), rows[0].target
        mean = total / len(rows)
        if 0 < target < 2 * total * (1 - 1e-12):
            # The tilt that meets the target, by bisection of the tilted total.
            low, high = -1e3, 1e3
            rate = lambda r, t, mean=mean: 2 / (1 + math.exp(-max(-700, min(700, t * r.size / mean))))
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if sum(r.size * rate(r, middle) for r in rows) < target else (low, middle)
            assert all(r.rate == pytest.approx(rate(r, low), abs=1e-6) for r in rows)
        groups = defaultdict(list)
        for r in rows:
            groups[r.size].append(r)
        run = 0.0
        for size in sorted(groups, reverse=True):
            group = groups[size]
            part = (group[0].rate - math.floor(group[0].rate)) * len(group)
            extra = min(len(group), math.floor(run + part + 0.5) - math.floor(run + 0.5))
            run += part
            if abs((run + 0.5) % 1 - 0.5) > 0.4999 or size == 0:
                continue  # the order of additions may decide
            order = sorted(group, key=lambda r: draw[r.doc_id])
            assert [r.copies - math.floor(r.rate) for r in order] == [1] * extra + [0] * (len(group) - extra)
            assert all(r.taken == r.copies * r.size for r in order)
    assert mixing.MOST_COPIES == 2 and max(r.copies for r in got) <= 2

"""Approximate search against exact search, fingerprints and paired ledgers on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import ann, ledgers, retrieval
from gleaner.plans import base, integrity_queries  # noqa: F401


def test_recall_of_approximate_search(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        found, exact = base.QUERIES["ann_topk"](spark, sf), base.QUERIES["dense_topk"](spark, sf)
        shares = [r.recall for r in ann.recall(found, exact).collect()]
        assert np.mean(shares) >= 0.9, (sf, np.mean(shares))


def test_all_lists_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_ROWS", 20)
    rng = np.random.default_rng(5)
    # A third of all vectors are in one list.
    x = np.vstack((rng.normal(size=(120, 6)), np.array([3.0, 0, 0, 0, 0, 0]) + 0.01 * rng.normal(size=(60, 6))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0]), (903, [None] * 6), (904, [float("nan")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = frame.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    centres = ann.fit(frame, 7)
    assert centres.shape == (7, 6) and np.allclose(np.linalg.norm(centres, axis=1), 1) and (centres == ann.fit(frame.repartition(2), 7)).all()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(frame, asked, centres, 5, 7).collect()}
    want = {(r.query_id, r.rank): (r.vec_id, r.score) for r in retrieval.cosine_top(frame, asked, 5).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and max(abs(got[k][1] - want[k][1]) for k in got) < 1e-8
    some = ann.recall(ann.search(frame, asked, centres, 5, 2), retrieval.cosine_top(frame, asked, 5)).agg(F.avg("recall")).first()[0]
    assert 0.3 < some <= 1
    # Tight clusters need few lists for most neighbours, even directions need many.
    near = np.repeat(np.eye(6), 40, axis=0) + 0.01 * rng.normal(size=(240, 6))
    tight = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")
    assert ann.probes_for(tight, ann.fit(tight, 6), 5, 0.95) == 1 < ann.probes_for(frame, centres, 5, 0.95)
    assert len(ann.fit(frame.limit(0), 4)) == 0 and ann.search(frame.limit(0), asked.limit(0), ann.fit(frame.limit(0), 4), 5, 2).count() == 0


def test_fingerprints(spark):
    rows = [("a", 1, 7), ("a", 2, 8), ("b", 1, 8), ("b", 2, 7), ("c", 1, 7), ("c", 2, 8), ("d", 1, 7), ("d", 2, 7), ("e", 1, 7)]
    got = {r.q: r for r in ledgers.fingerprints(spark.createDataFrame(rows, "q string, rank int, item long").repartition(3), ["q"]).collect()}
    assert got["a"].bag == got["b"].bag == got["c"].bag and len({got[q].bag for q in "ade"}) == 3
    assert got["a"].ordered == got["c"].ordered != got["b"].ordered
    assert [got[q].kinds for q in "ade"] == [2, 1, 1]


def test_paired_ledgers(spark):
    kind = "condition string, slot int, source_group string, status string, latency double"
    left = [("x", i, "g", "success", float(i)) for i in range(5)] + [("y", 0, "g", "success", 1.0), ("z", 0, "g", "success", 1.0)]
    right = [("x", i, "g", "failed" if i == 4 else "success", 2.0 * i) for i in range(5)] + [("z", 0, "g", "success", 1.0), ("w", 3, "g", "success", 1.0)]
    plan = spark.createDataFrame([(c, s) for c, s, *_ in left] + [("z", 0), ("empty", 1)], "condition string, slot int")
    got = {r.condition: r for r in ledgers.paired_operational(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), plan).collect()}
    assert (got["x"].complete, got["x"].error_rate, got["x"].p50, got["x"].scheduled) == (True, -0.2, 2.0 - 3.0, 5)
    assert {c: (r.reason, r.p50) for c, r in got.items() if c != "x"} == {"y": ("missing", None), "z": (None, 0.0), "empty": ("missing", None), "w": ("not scheduled", None)}


def test_workload_problems(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (8, None), (None, [1.0, 1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0])]
    q = [(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 77), (3, [1.0, 1.0], None), (3, None, 9)]
    got = ledgers.workload_problems(spark.createDataFrame(v, "id long, vector array<double>"), spark.createDataFrame(q, "id long, vector array<double>, target long"), 2)
    want = {("record", 2, "zero vector"), ("record", 3, "not finite"), ("record", 4, "not finite"), ("record", 5, "not finite"), ("record", 6, "dimension"), ("record", 7, "dimension"), ("record", 8, "no vector"), ("record", None, "no id"), ("record", 9, "repeated id")}
    want |= {("query", 2, "zero vector"), ("query", 2, "unknown target"), ("query", 3, "repeated id"), ("query", 3, "no vector")}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("name", ["pool_violations", "pool_differences", "ranking_problems"])
def test_lines_of_pools_are_ranked_once(spark, sf_dir, name, monkeypatch):
    """Pools are read from one written table, so lines are scanned and exchanged once."""
    from gleaner.plans import base

    plans, keep = [], base.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(base, "written", lambda df, tag: plans.append(plan(df)) or keep(df, tag))
    plans.append(plan(base.QUERIES[name](spark, sf_dir)))
    assert sum(p.count("lineitem.parquet") for p in plans) == 1

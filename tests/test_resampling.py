"""Bootstraps against direct resampling with the same draws."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import resampling as rs

B = 300


@pytest.fixture(scope="module")
def ledger():
    rng = random.Random(8)
    rows = []
    for s in range(90):
        for _ in range(rng.randrange(1, 9)):
            v = None if rng.random() < 0.1 else round(rng.expovariate(0.1), rng.choice([0, 6]))
            rows.append((f"s{s}", "ab"[s % 2], f"t{s % 3}", v, None if v is None or rng.random() < 0.2 else v + rng.gauss(1, 2)))
    return rows + [(None, "a", "t0", 5.0, 5.0), ("alone", "c", "t0", 7.0, 9.0), ("void", "d", "t0", None, None), ("void2", "d", "t0", None, None)]


@pytest.fixture
def frame(spark, ledger, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_SOURCES", 7)
    monkeypatch.setattr(rs, "GROUP_ROWS", 25)
    return spark.createDataFrame(ledger, "source string, kind string, stratum string, v double, w double").repartition(4)


def counts(frame, stratum=None):
    return {(r.kind, r.source): rs.counts_of(r.counts) for r in rs.draws(frame, "source", ["kind"], stratum, B).collect()}


@pytest.mark.parametrize("stratum", [None, "stratum"])
def test_draws_are_multinomial(frame, ledger, stratum):
    drawn = counts(frame, stratum)
    strata = defaultdict(list)
    for s, k, t, *_ in {r[:3]: r for r in ledger if r[0]}.values():
        strata[k, t if stratum else "all"].append(drawn[k, s])
    for each in strata.values():
        # Each resample draws as many sources as the stratum has; counts have the moments of a multinomial.
        assert (np.sum(each, axis=0) == len(each)).all()
        if len(each) > 10:
            assert abs(np.var(each) - (1 - 1 / len(each))) < 0.1
    again = counts(frame.repartition(9), stratum)
    assert all((again[k] == c).all() for k, c in drawn.items())
    assert not (drawn["a", "s0"] == drawn["a", "s2"]).all()


def bounds(values):
    return np.quantile(values, [0.025, 0.975]) if len(values) else (None, None)


def test_ratios(frame, ledger):
    metrics = {"mean": (F.col("v"), F.when(F.col("v").isNotNull(), 1)), "paired": (F.col("w") - F.col("v"), F.when(F.col("w").isNotNull(), 1))}
    got = {(r.kind, r.metric): r for r in rs.bootstrap_ratios(frame, "source", metrics, ["kind"], "stratum", B, least={"mean": 2, "paired": None}).collect()}
    drawn = counts(frame, "stratum")
    for kind in "abcd":
        rows = [(s, v) for s, k, _, v, _ in ledger if k == kind and s and v is not None]
        r = got[kind, "mean"]
        if not rows:
            assert r.reason == "no_contributing_sources" and r.estimate is None and r.contributing == 0 and r.sources == 2
            continue
        assert r.estimate == pytest.approx(np.mean([v for _, v in rows]))
        if kind == "c":
            assert (r.reason, r.low, r.high, r.sources) == ("insufficient_independent_sources", None, None, 1)
            continue
        means = []
        for b in range(B):
            copies = [v for s, v in rows for _ in range(drawn[kind, s][b])]
            if copies:
                means.append(np.mean(copies))
        assert (r.low, r.high) == pytest.approx(tuple(bounds(means))) and r.reason is None and r.defined == len(means)
        assert got[kind, "paired"].reason == "ci_support_not_frozen" and got[kind, "paired"].low is None


def test_percentiles_and_paired_percentiles(frame, ledger):
    drawn = counts(frame)
    one = {(r.kind, r.percentile): r for r in rs.bootstrap_percentiles(frame, "source", "v", ["kind"], (0.5, 0.95), resamples=B).collect()}
    two = {(r.kind, r.percentile): r for r in rs.paired_percentiles(frame, "source", "v", "w", ["kind"], (0.5, 0.95), resamples=B).collect()}
    for kind in "ab":
        rows = [r for r in ledger if r[1] == kind and r[0]]
        for p in (0.5, 0.95):
            single, paired = [], []
            for b in range(B):
                v = [r[3] for r in rows for _ in range(drawn[kind, r[0]][b]) if r[3] is not None]
                w = [r[4] for r in rows for _ in range(drawn[kind, r[0]][b]) if r[4] is not None]
                single.append(np.quantile(v, p))
                paired.append(np.quantile(w, p) - np.quantile(v, p))
            r = one[kind, p]
            assert (r.low, r.high) == pytest.approx(tuple(bounds(single))) and r.defined == B and r.reason is None
            assert r.estimate == pytest.approx(np.quantile([x[3] for x in rows if x[3] is not None], p))
            r = two[kind, p]
            assert (r.low, r.high) == pytest.approx(tuple(bounds(paired))) and r.reason is None
    assert one["c", 0.5].reason == "insufficient_independent_sources" and one["c", 0.5].low is None and one["c", 0.5].estimate == 7
    assert two["d", 0.5].reason == "no_contributing_sources" and two["d", 0.5].defined == 0


def test_source_in_two_strata_and_no_rows(spark):
    frame = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "source string, stratum string, v double")
    metrics = {"m": (F.col("v"), F.lit(1))}
    with pytest.raises(Exception, match="separately resampled strata"):
        rs.bootstrap_ratios(frame, "source", metrics, [], "stratum", 10).collect()
    assert rs.bootstrap_ratios(frame.limit(0), "source", metrics, [], None, 10).count() == 0
    assert rs.bootstrap_percentiles(frame.limit(0), "source", "v", []).count() == 0
    got = rs.bootstrap_ratios(frame, "source", metrics, [], None, 10, least=1).first()
    assert (got.estimate, got.low, got.high, got.sources) == (1.5, 1.5, 1.5, 1)


def test_draws_are_made_once_and_values_sent_where_looked_up(spark, monkeypatch):
    """Both sides of a pair read one table of draws; weights of values meet the ranges that are asked for."""
    tags, keep = [], rs.written

    def seen(df, tag):
        tags.append(tag)
        return keep(df, tag)

    monkeypatch.setattr(rs, "written", seen)
    rows = spark.createDataFrame([(f"u{i % 9}", float(i), float(i * i)) for i in range(60)], "u string, x double, y double")
    found = rs.paired_percentiles(rows, "u", "x", "y", [], (0.5,), resamples=50)
    assert tags == ["draws", "requests", "requests"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2 and found.count() == 1


def test_drawn_sums_are_those_of_the_draws():
    """With a row a source the sums are those of source_draws; rows that stand for many sources have the moments of the draws."""
    values, n = np.random.default_rng(1).normal(size=(40, 2)), rs.block_draws(np.array([40, 3]), 0, 700, 5, 9)
    want = np.concatenate([c @ values for c in rs.source_draws(n, 40, 3, 5, 9)])
    assert np.allclose(rs.drawn_sums(n, values, np.ones(40, int), 3, 5, 9), want)
    assert not rs.drawn_sums(n * 0, values, np.ones(40, int), 3, 5, 9).any()
    for times in (np.array([300, 500, 200]), np.array([3, 5, 2])):
        n, v, p = np.full(4000, times.sum()), np.array([[1.0, 0.0], [0.0, 1.0], [5.0, 0.0]]), times / times.sum()
        found = rs.drawn_sums(n, v, times, 0, 5, 9)
        assert np.allclose(found.mean(axis=0), n[0] * (p @ v), rtol=0.02)
        assert np.allclose(found.var(axis=0), n[0] * (p @ v**2 - (p @ v) ** 2), rtol=0.15)


def test_equal_sources_of_large_strata_are_one_row(spark, monkeypatch):
    rows = [(f"s{i}", "a", float(i % 3)) for i in range(600)] + [(f"s{i}", "b", float(i % 3)) for i in range(20)]
    frame = spark.createDataFrame(rows, "source string, kind string, v double").repartition(3)
    mean = {"mean": (F.col("v"), F.lit(1.0))}
    before = {r.kind: r for r in rs.bootstrap_ratios(frame, "source", mean, ["kind"], None, 3000).collect()}
    seen, keep = [], rs._over_blocks
    monkeypatch.setattr(rs, "_over_blocks", lambda units, *more: seen.append(units) or keep(units, *more))
    monkeypatch.setattr(rs, "LARGE_SOURCES", 100)
    after = {r.kind: r for r in rs.bootstrap_ratios(frame, "source", mean, ["kind"], None, 3000).collect()}
    assert sorted((r.kind, r["__m"]) for r in seen[0].collect()) == [("a", 200)] * 3 + [("b", 1)] * 20
    assert after["b"] == before["b"] and after["a"].sources == 600 and after["a"].estimate == pytest.approx(1)
    assert [after["a"].low, after["a"].high] == pytest.approx([before["a"].low, before["a"].high], abs=0.01)


def test_paired_interval_brings_samples_together_once(spark):
    from gleaner.operators import stats

    rows = [("x", 1, 5.0, "g"), ("y", 1, 3.0, "h"), ("z", 1, 1.0, "g"), ("x", 2, 1.0, "h"), ("y", 2, None, "h"), ("x", None, 1.0, "g"), ("y", None, 1.0, "g"), ("y", 3, 2.0, None), ("z", 3, 1.0, None)]
    frame = spark.createDataFrame(rows, "c string, s long, v double, g string")
    found = stats.paired_interval(frame, "c", "s", "v", "g", resamples=20)
    assert {(r.left, r.right): (r.estimate, r.groups) for r in found.collect()} == {("x", "y"): (2, 1), ("x", "z"): (4, 1), ("y", "z"): (2, 1)}
    assert "SortMergeJoin [s" not in found._jdf.queryExecution().executedPlan().toString()


def test_percentiles_send_no_counts_and_cut_wide_ranges(spark, monkeypatch):
    """The table of draws is a row a block, whatever the resamples; values of few sources, whose ranks move far, are cut finer."""
    monkeypatch.setattr(rs, "GROUP_ROWS", 20)
    for name, least in (("WIDE", 500), ("NARROW", 2)):
        monkeypatch.setattr(rs, name, least, raising=False)
    seen, keep = [], rs.written

    def kept(df, tag):
        seen.append((tag, keep(df, tag)))
        return seen[-1][1]

    monkeypatch.setattr(rs, "written", kept)
    rng = random.Random(2)
    rows = [(f"s{i % 12}", (i % 12) * 5 + round(rng.expovariate(0.1), 2 if i % 3 else 0)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "source string, v double").repartition(3)
    drawn = {r.source: rs.counts_of(r.counts) for r in rs.draws(frame.withColumn("__all", F.lit(0)), "source", ["__all"], None, 200).collect()}
    values = {s: np.array([v for x, v in rows if x == s]) for s in drawn}
    for r in rs.bootstrap_percentiles(frame, "source", "v", [], (0.5, 0.95), resamples=200).collect():
        each = [np.quantile(np.concatenate([np.repeat(values[s], drawn[s][b]) for s in values]), r.percentile) for b in range(200)]
        assert (r.low, r.high) == pytest.approx(tuple(bounds(each))) and r.estimate == pytest.approx(np.quantile([v for _, v in rows], r.percentile)) and r.defined == 200
    tables = dict(seen)
    assert "counts" not in tables["draws"].columns and tables["draws"].count() == 1
    assert [t for t, _ in seen].count("edges") > 1


def test_paired_query_reads_its_ledger_once(spark, sf_dir):
    from gleaner.plans.ledger_queries import paired_percentile_intervals

    found = paired_percentile_intervals(spark, sf_dir)
    assert not any("events" in f for f in found.inputFiles()) and found.count() == 2


def test_percentiles_of_a_missing_key(spark):
    frame = spark.createDataFrame([(f"s{i}", None if i % 2 else "a", float(i // 2)) for i in range(40)], "source string, kind string, v double")
    one, two = rs.bootstrap_percentiles(frame, "source", "v", ["kind"], (0.5,), resamples=50), rs.paired_percentiles(frame, "source", "v", "v", ["kind"], (0.5,), resamples=50)
    assert [(r.estimate, r.defined, r.reason) for r in one.collect()] == [(9.5, 50, None)] * 2
    assert [(r.estimate, r.low, r.high, r.reason) for r in two.collect()] == [(0, 0, 0, None)] * 2

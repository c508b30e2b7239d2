"""Transcripts, timings and question statistics on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import attempts


def test_transcripts(spark):
    p = spark.createDataFrame([(1, "Hello, world!", 4.0), (2, "a b", 4.0), (3, "", 4.0), (4, None, 4.0), (5, "a", 4.0), (6, "b a", 4.0)], "id int, transcript string, duration double")
    s = spark.createDataFrame([(1, 0, "hello", 0.0, 1.0), (1, 1, " ... ", 1.0, 1.0), (1, 2, "WORLD", 1.0, 4.4), (2, 0, "a", 2.0, 1.0), (2, 1, "b", 1.0, 9.0), (3, 0, "x", 0.0, 1.0), (5, 0, "!", 0.0, 1.0), (6, 1, "a", 0.0, 1.0), (6, 0, "b", 0.0, 1.0)], "id int, number int, text string, start double, end double")
    got = {(r.id, r.problem) for r in attempts.transcript_problems(p, s, "id", 0.5).collect()}
    assert got == {(2, "unordered segments"), (2, "segment ends before its start"), (2, "segment beyond the end"), (3, "segments without transcript"), (5, "segments missing")}
    changed = attempts.transcript_problems(p.where("id = 6"), s.where("id = 6").withColumn("number", -F.col("number")), "id", 0.5)
    assert [r.problem for r in changed.collect()] == ["transcript contradicts segments"]


def test_timestamps(spark):
    kind = "id int, number int, start double, end double"
    r = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (2, 0, 0.0, 1.0)], kind)
    p = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 1, 1.0, 1.5), (1, 2, 3.0, 4.0)], kind)
    m = spark.createDataFrame([(1, 0, 0, 1)], "id int, reference int, first int, last int")
    got = {x.id: (x.references, x.aligned, x.error, x.boundaries) for x in attempts.timestamp_totals(r, p, m, "id").collect()}
    assert got == {1: (2, 1, 1.0, 2), 2: (1, 0, 0.0, 0)}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("completed", [1.0, 2.0], 2, 0.5, 0.5, 1.0, 2.0, 3.0, True), (True, True, True)),
        (("completed", [2.0, 1.0], 2, 1.5, 0.5, 2.0, 1.0, 3.0, True), (False, True, True)),
        (("completed", [1.0], 1, 1.0, None, None, None, None, False), (True, True, True)),
        (("completed", [], 0, None, None, None, None, None, True), (True, True, False)),
        (("completed", None, 0, None, None, None, None, 1.0, True), (False, False, True)),
        (("completed", [1.0, math.nan], 2, 1.0, 0.0, 1.0, 1.0, math.inf, True), (False, True, False)),
        (("failed", [], None, None, None, None, None, None, False), (True, True, True)),
        (("not_executed", [1.0], 1, 1.0, 0.0, 1.0, 1.0, 1.0, True), (False, False, False)),
    ],
)
def test_coverage(spark, row, want):
    df = spark.createDataFrame([row], "o string, e array<double>, n int, t double, s double, a double, b double, l double, r boolean")
    got = df.select(attempts.measurement_coverage(*[F.col(c) for c in ("o", "e", "n", "t", "s", "a", "b", "l", "r")]).alias("c")).first().c
    assert tuple(got) == want


def test_question_statistics(spark):
    rows = [("q", "m", "scored", None, 1.0), ("q", "m", "unavailable", None, None), ("q", "m", "inapplicable", "no_generated_claims", None), ("q", "m", "inapplicable", "other", None), ("q", "rate", "scored", None, 1.0), ("q", "rate", "incomplete", None, None), ("p", "rate", "scored", None, 0.5)]
    got = {(r.question, r.metric): tuple(r)[2:] for r in attempts.question_statistics(spark.createDataFrame(rows, "question string, metric string, status string, reason string, value double"), ["rate"]).collect()}
    assert got == {("q", "m"): (1.0, 3, 1, 1, 1, False), ("q", "rate"): (None, 2, 1, 1, 0, False), ("p", "rate"): (0.5, 1, 1, 0, 0, True)}


def test_element_tokens(spark):
    rows = [("text", "A-b, c_d", None, None), ("code", "f(x)+= y1", None, None), ("formula", "t", "a^2", None), ("formula", "t u", "", None), ("table", "x", None, ["One two", "3"]), ("table", "X y", None, None), ("text", None, None, None)]
    df = spark.createDataFrame(rows, "k string, t string, l string, c array<string>")
    got = [r[0] for r in df.select(tx.element_tokens(F.col("k"), F.col("t"), F.col("l"), F.col("c"))).collect()]
    assert got[1:6] == [["f", "(", "x", ")", "+", "=", "y1"], ["a", "^", "2"], ["t", "u"], ["one", "two", "3"], ["x", "y"]] and got[0][:2] == ["a", "b"] and not got[6]


def test_descriptor_and_violations(spark):
    from gleaner.operators import metrics

    rows = spark.createDataFrame([("full", 1.0), ("full", 3.0), ("gap", 2.0), ("gap", None), ("none", None)], "k string, v double")
    due = spark.createDataFrame([("full", 2), ("gap", 2), ("none", 1), ("not due", 0), ("unseen", 4)], "k string, expected long")
    got = {r.k: tuple(r)[1:] for r in metrics.descriptor(rows, due, ["k"], "v").collect()}
    assert got == {"full": ("scored", True, 2, 2, 0, 2.0, 2.9), "gap": ("incomplete", False, 2, 1, 1, 2.0, 2.0), "none": ("unavailable", False, 1, 0, 1, None, None), "not due": ("inapplicable", False, 0, 0, 0, None, None), "unseen": ("unavailable", False, 4, 0, 4, None, None)}
    hits = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, f int")
    assert {r.k: (r.hits, r.violations, r.rate) for r in metrics.violation_rate(hits, ["k"], ~F.col("f").eqNullSafe(F.lit(1))).collect()} == {"a": (2, 1, 0.5), "b": (1, 1, 1.0)}


def test_kind_scores(spark):
    from gleaner.operators import documents

    r = spark.createDataFrame([(1, 1, "table", ["a", "b", "b"]), (1, 2, "table", ["c"]), (1, 3, "formula", []), (2, 1, "table", ["x"])], "d int, element int, kind string, tokens array<string>")
    p = spark.createDataFrame([(1, 7, "table", ["b", "b", "z"]), (1, 8, "formula", []), (1, 9, "figure", ["q"])], "d int, element int, kind string, tokens array<string>")
    m = spark.createDataFrame([(1, 1, 7), (1, 3, 8)], "d int, reference int, prediction int")
    got = {(x.d, x.kind): (x.expected, x.found, x.matched, round(x.f1, 6), x.content_f1) for x in documents.kind_scores(r, p, m, "d").collect()}
    assert got == {(1, "table"): (2, 1, 1, 0.666667, pytest.approx(1 / 3)), (1, "formula"): (1, 1, 1, 1.0, 1.0), (1, "figure"): (0, 1, 0, 0.0, None), (2, "table"): (1, 0, 0, 0.0, 0.0)}


def test_sliced_aggregate(spark):
    from gleaner.operators import metrics

    rows = [("d1", "m", 1.0, 1.0, "x", ["p", "q"]), ("d1", "m", 3.0, 3.0, None, ["p", None]), ("d2", "m", 8.0, 1.0, "x", None), ("d2", "m", None, 1.0, "x", ["p"]), ("d3", "k", 5.0, 0.0, "y", [])]
    df = spark.createDataFrame(rows, "d string, metric string, v double, w double, s string, g array<string>")
    got = {(r.slice, r.metric): (r.observations, r.groups, r.macro, r.pooled, r.p50) for r in metrics.sliced_aggregate(df, {"s": F.col("s"), "g": F.col("g")}, "d", "metric", "v", "w").collect()}
    assert got == {
        ("overall", "m"): (3, 2, 5.0, 18 / 5, 3.0), ("s:x", "m"): (2, 2, 4.5, 4.5, 4.5), ("g:p", "m"): (2, 1, 2.0, 2.5, 2.0), ("g:q", "m"): (1, 1, 1.0, 1.0, 1.0),
        ("overall", "k"): (1, 1, 5.0, None, 5.0), ("s:y", "k"): (1, 1, 5.0, None, 5.0),
    }


def test_label_problems(spark):
    claim = "response int, id string, text string, spans array<struct<start: int, end: int>>, supported boolean, cited_supported boolean, correct boolean, support_sources array<string>, cited_sources array<string>, verification_sources array<string>, gold_matches array<string>"
    fine = ([(0, 3)], True, False, True, ["b"], [], ["m"], ["g"])
    rows = [(1, "a", "One", *fine), (1, "b", "ONE", *fine), (1, "c", "two", *fine), (1, "c", "three", *fine), (1, None, "four", *fine), (1, "e", "five", None, None, None, None, None, None, None, None), (2, "a", "One", *fine), (3, "a", "x", *fine), (1, "z", "six", [(0, 3), (3, 3)], True, False, True, ["b", "b"], [], ["m"], [])]
    responses = spark.createDataFrame([(1, "abcdef", ["b"], ["b"], ["m"], ["g"]), (2, "abcdef", ["b"], [], ["m"], ["g"]), (3, attempts.REFUSAL, ["b"], [], ["m"], ["g"])], "response int, answer string, blocks array<string>, citations array<string>, material array<string>, gold array<string>")
    got = sorted((r.response, r.id or "", r.problem) for r in attempts.label_problems(spark.createDataFrame(rows, claim).repartition(3), responses).collect())
    assert got == sorted([(1, "a", "repeated claim"), (1, "b", "repeated claim"), (1, "c", "repeated claim"), (1, "c", "repeated claim"), (1, "", "no id or text"), (1, "e", "no spans"), (3, "a", "claim of a refusal"), (1, "z", "span outside the answer"), (1, "z", "unknown support")])

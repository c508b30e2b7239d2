"""Documents as segments, hierarchies and structured content against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import structured
from gleaner.operators import documents
from gleaner.plans import document_queries


def test_normalized_offsets_select_their_text(spark, sf_dir):
    rows = documents.normalize_segments(document_queries.raw_segments(spark, sf_dir), "conv_id", "turn", "text", "kind", "conservative", "cells").collect()
    whole = {r.conv_id: r.text for r in documents.text_of(spark.createDataFrame(rows), "conv_id", "turn", "text").collect()}
    assert {r.kind for r in rows} == {"text", "formula", "table"}
    for r in rows:
        assert whole[r.conv_id][r.start : r.end] == r.text != ""
        assert ("  " in r.text) == (r.kind == "formula" and "  " in r.text) and "\r" not in r.text and "­" not in r.text
    assert not any("\t" in c for r in rows if r.kind == "table" for row in r.cells for c in row)


def test_structured_offsets_select_their_text(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice([None, "", "a", "b\n\n", "\n\n", "c d\n"]), rng.choice([None, 50 + i])) for d in range(12) for i in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(rows, "doc long, i long, text string, native long").repartition(3)
    got = documents.structured_segments(frame, "doc", "i", "text", "native").orderBy("doc", "i").collect()
    for d in {r[0] for r in rows}:
        own, pieces = [r for r in got if r.doc == d], []
        for place, r in enumerate(own):
            if r.text and pieces and not pieces[-1].endswith("\n\n"):
                pieces.append("\n\n")
            pieces += [r.text] * bool(r.text)
            assert r.order == (place if r.native is None else r.native)
        text = "".join(pieces)
        assert "".join(r.separator + r.text for r in own) == text and all(text[r.start : r.end] == r.text for r in own)


def test_joined_parts(spark):
    parts = spark.createDataFrame([(1, 0, "audio", "audio", None, "ab cd"), (1, 1, "frame-0", "visual", 1.5, "xyz"), (1, 2, "frame-1", "visual", 3.0, ""), (1, 3, "frame-2", "visual", 4.5, "q")], "doc int, part int, identity string, modality string, stamp double, text string")
    segments = spark.createDataFrame([(1, 0, 0, "ab", 0, 2, "e0", None, "text", 0.0, 1.0), (1, 0, 1, "cd", 3, 5, "e1", "e0", "table", 1.0, 2.0), (1, 3, 0, "q", 0, 1, "", "", None, 9.0, 9.0)], "doc int, part int, number int, text string, start int, end int, element string, parent string, kind string, t_start double, t_end double")
    got = documents.joined_parts(parts, segments, "doc").orderBy("order").collect()
    text = "ab cd\nxyz\n\nq"
    assert [(r.element, r.parent, r.kind, r.t_start, r.native_start) for r in got] == [("audio:e0", None, "audio", 0.0, 0), ("audio:e1", "audio:e0", "table", 1.0, 3), (None, None, "visual_text", 1.5, 0), (None, None, "visual_text", 4.5, 0)]
    assert all(text[r.start : r.end] == r.text for r in got) and [r.order for r in got] == [0, 1, 2, 3]


def test_cycles(spark):
    rng = random.Random(6)
    rows = [(0, i, i - 1 if i else None) for i in range(300)]  # a deep chain
    rows += [(1, i, (i + 1) % 257) for i in range(257)]  # one ring
    for d in range(2, 8):
        n = rng.randrange(1, 40)
        rows += [(d, i, rng.choice([None, rng.randrange(n), rng.randrange(n), 999])) for i in range(n)]
    want = set()
    up = {(d, i): p for d, i, p in rows}
    for d, i, _ in rows:
        seen, at = [i], up[d, i]
        while at is not None and (d, at) in up and at not in seen:
            seen.append(at)
            at = up[d, at]
        if at == i:
            want.add((d, i, min(seen)))
    frame = spark.createDataFrame(rows, "doc long, element long, parent long").repartition(5)
    assert {(r.doc, r.element, r.cycle) for r in documents.cycles(frame, "doc").collect()} == want and len(want) > 257
    assert documents.cycles(frame.limit(0), "doc").count() == 0


def test_hierarchy(spark):
    kind = "doc int, element string, parent string, level int, has_parent boolean, has_level boolean"
    r = spark.createDataFrame([(1, "a", None, 0, True, True), (1, "b", "a", 1, True, True), (1, "c", "a", 1, True, False), (1, "d", "b", 2, False, True), (1, "e", "d", None, True, False), (1, "f", None, None, False, False)], kind)
    p = spark.createDataFrame([(1, "1", None, 0, True, True), (1, "2", "1", 1, True, True), (1, "3", "1", 5, True, True), (1, "4", "9", 2, True, True), (1, "5", None, None, True, False)], kind)
    m = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "3"), (1, "d", "4"), (1, "e", "5")], "doc int, reference string, prediction string")
    got = documents.hierarchy_preservation(r, p, m, "doc").first()
    # e has a parent whose match is not its match's parent; f is not annotated.
    assert (got.eligible, got.preserved) == (5, 4)
    assert documents.hierarchy_preservation(r, p, m.limit(0), "doc").first().preserved == 0


def holds(document, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(document, dict) and all(k in document and holds(document[k], v, False) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(document, list) and all(any(holds(e, s, False) for e in document) for s in pattern)
    if top and isinstance(document, list):
        return any(holds(e, pattern, False) for e in document)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return document == pattern and (type(document) is type(pattern) or (number(document) and number(pattern)))


def test_json_containment(spark):
    rng = random.Random(2)

    def value(depth):
        leaf = [None, True, False, 0, 1, 1.0, 2.5, "1", "x", "", {}, []]
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaf)
        if rng.random() < 0.5:
            return {k: value(depth - 1) for k in rng.sample(["a", "b", "it's", 'q"', "a.b"], rng.randrange(0, 4))}
        return [value(depth - 1) for _ in range(rng.randrange(0, 4))]

    made = [value(3) for _ in range(150)]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(made)] + [(-1, None), (-2, "{bad"), (-3, "")], "i long, d string")
    patterns = [value(2) for _ in range(25)] + [{"a": {}}, [[]], {"a": [1]}, [None], None, {"a": None}]
    got = frame.select("i", *[structured.json_contains(F.col("d"), p).alias(f"p{j}") for j, p in enumerate(patterns)]).collect()
    for r in got:
        for j, p in enumerate(patterns):
            want = None if r.i == -1 else r.i >= 0 and holds(made[r.i], p)
            assert r[f"p{j}"] is want, (r.i, made[r.i], p)


def test_answers():
    good = '{"status": "answered", "answer": "a", "citations": ["x", "y"]}'
    assert structured.read_answer(good) == ("answered", "a", ["x", "y"], None)
    reasons = {
        None: "not JSON", "": "not JSON", "{": "not JSON", "[" * 100_000: "not JSON", "3": "other keys", "[]": "other keys", "null": "other keys", '{"status": "answered"}': "other keys",
        good[:-1] + ', "more": {"k": 1, "k": 2}}': "repeated key", good[:-1] + ', "status": "answered"}': "repeated key", good[:-1] + ', "more": 1}': "other keys",
        good.replace('"answered"', '"Answered"'): "status or answer", good.replace('"answered"', "[]"): "status or answer", good.replace('"a"', "1"): "status or answer", good.replace('"a"', "NaN"): "status or answer",
        good.replace('["x", "y"]', '"x"'): "citations", good.replace('"y"', "null"): "citations",
    }
    for text, reason in reasons.items():
        assert structured.read_answer(text) == (None, None, None, reason)


@pytest.mark.parametrize(
    ("html", "events"),
    [
        ("<table><tr><td>x<td>y</tr></table>", None),
        ("a<table><TR><td colspan='2'>x <b>y</b></td></tr></table>b", ["table", "tr", "td 1 2", "/td", "/tr", "/table"]),
        ("<table><thead><tr><th rowspan=3></th></tr></thead></table>", ["table", "thead", "tr", "th 3 1", "/th", "/tr", "/thead", "/table"]),
        ("<table></table>", None), ("<table><tr></tr></table>", None), ("", None), (None, None), ("<table><tr><td>", None), ("</table>", None), ("<td>x</td>", None),
        ("<table><tr><td>1</td></tr></table><table><tr><td>1</td></tr></table>", None), ("<table><tr><td><table></table></td></tr></table>", None),
        ("<table><tr><td rowspan=0>1</td></tr></table>", None), ("<table><tr><td colspan=x>1</td></tr></table>", None), ("<table><tr><td colspan>1</td></tr></table>", None),
    ],
)
def test_table_events(html, events):
    assert structured.table_events(html) == events

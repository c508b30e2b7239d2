"""Queries over whole inputs, against brute force on the same tables."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__  # noqa: F401
from gleaner.functions import text as tx
from gleaner.operators import matching, retrieval
from gleaner.plans import base


def turn_pairs(spark, sf_dir):
    rows = sorted((r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    return {(a[0], a[1]): (a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]}


def distance(a, b):
    """(edits, -substitutions) of the best edit, by the plain recurrence."""
    last = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, 0)]
        for j, y in enumerate(b, 1):
            s = last[j - 1] if x == y else (last[j - 1][0] + 1, last[j - 1][1] - 1)
            row.append(min(s, (last[j][0] + 1, last[j][1]), (row[-1][0] + 1, row[-1][1])))
        last = row
    return last[-1]


def by_pair(spark, sf_dir, name):
    return {(r.conv_id, r.turn): r for r in base.QUERIES[name](spark, sf_dir).collect()}


def test_edits_of_whole_texts(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    prose = {}
    for side in (0, 1):
        df = spark.createDataFrame([(c, t, p[side]) for (c, t), p in pairs.items()], "c long, t long, x string")
        for r in df.select("c", "t", tx.prose_tokens(df.x).alias("w")).collect():
            prose.setdefault((r.c, r.t), []).append(r.w)
    cer, wer, ops = (by_pair(spark, sf_dir, n) for n in ("cer_by_pair", "wer_by_pair", "edit_operations"))
    assert set(cer) == set(wer) == set(ops) == set(pairs) and any(min(map(len, p)) > 200 for p in pairs.values())
    for k, (r, h) in pairs.items():
        a, b = prose[k]
        n = distance(a, b)[0]
        assert wer[k].wer == pytest.approx(n / max(1, len(a)), abs=1e-6)
        assert ops[k].substitutions + ops[k].deletions + ops[k].insertions == n
        assert len(a) - ops[k].deletions + ops[k].insertions == len(b)
    for k in [k for k, p in pairs.items() if min(map(len, p)) > 200][:8]:
        r, h = pairs[k]
        assert cer[k].cer == pytest.approx(distance(r, h)[0] / max(1, len(r)), abs=1e-6)


def test_edit_operations_of_random_lists():
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        s, x, y = matching.edit_operations(a, b)
        assert s + x + y == distance(a, b)[0] and len(a) - x + y == len(b)


def test_bags_of_all_turns(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    f1, rate = by_pair(spark, sf_dir, "bag_f1"), by_pair(spark, sf_dir, "duplicate_content_rate")
    assert set(f1) == set(rate) == set(pairs) and any(t > 0 for _, t in pairs)
    for k, (r, h) in pairs.items():
        x, y = (Counter(re.findall(r"\w+", t.lower())) for t in (r, h))
        total = x.total() + y.total()
        assert f1[k].f1 == pytest.approx(2 * (x & y).total() / total if total else 1, abs=1e-6)
        assert rate[k].rate == pytest.approx(sum(max(0, n - x[t]) for t, n in y.items() if n > 1) / max(1, y.total()), abs=1e-6)


def sentences(text):
    """Sentence bounds by a scan of characters."""
    out, at, n = [], 0, len(text)
    while at < n:
        if text[at] in ".!?\n":
            at += 1
            continue
        end = at
        while end < n and text[end] not in ".!?\n":
            end += 1
        if end < n and text[end] == "\n":
            end += 1
        else:
            while end < n and text[end] in ".!?":
                end += 1
        out.append(end)
        at = end
    out = out or [n] * bool(text.strip())
    return list(zip([0, *out[:-1]], [*out[:-1], n], strict=True)) if out else []


def test_sentences_of_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = {(d, i, *s) for d, t in texts.items() for i, s in enumerate(sentences(t))}
    assert {tuple(r) for r in base.QUERIES["sentence_spans"](spark, sf_dir).collect()} == want
    chunks = set()
    for d, t in texts.items():
        s = sentences(t)
        for i, first in enumerate(range(0, max(1, len(s) - 2), 6) if s else ()):
            chunks.add((d, i, s[first][0], s[min(len(s), first + 8) - 1][1]))
    assert {tuple(r) for r in base.QUERIES["sentence_chunks"](spark, sf_dir).collect()} == chunks


def test_missing_slots_of_all_hours(spark, sf_dir):
    seen = {(f"g{r.user_id % 20}", int((r.ts - r.ts.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0, microsecond=0)).total_seconds() // 3600)) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts").collect()}
    hours = {w for _, w in seen}
    want = {(g, w) for g in {g for g, _ in seen} for w in range(min(hours), max(hours) + 1)} - seen
    got = [tuple(r) for r in base.QUERIES["missing_slots"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w % 24 for _, w in want} != {0}


def test_ties_beyond_the_first_ranks(spark):
    # 3 copies nearer than 100 equal ones: the cut at 10 falls into the latter.
    rows = [(i, [1.0, 0.0], 0) for i in range(3)] + [(i, [1.0, 1.0], i % 2) for i in range(3, 103)] + [(200, [0.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    ref = retrieval.tie_reference(vectors, asked, 10)
    assert [(r.effective, r.strict, r.boundary, r.slots) for r in ref.collect()] == [(10, 3, 100, 7)]
    # Hits at the cut count whichever their id is, as far as there are slots.
    hits = retrieval.cosine_top(vectors.where("vec_id < 2 or vec_id > 90"), asked, 10)
    assert retrieval.tie_recall(hits, ref).first().recall == pytest.approx(0.9)
    small = vectors.where("vec_id in (0, 1, 200)")
    ref = retrieval.tie_reference(small, asked, 10)
    assert [(r.effective, r.strict, r.boundary, r.slots) for r in ref.collect()] == [(3, 2, 1, 1)]
    assert retrieval.tie_recall(retrieval.cosine_top(small, asked, 10), ref).first().recall == 1
    by_label = retrieval.tie_reference(vectors, vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), 10)
    assert [(r.strict, r.boundary) for r in by_label.collect()] == [(3, 50)]


def test_matches_after_midnight(spark, tmp_path):
    from datetime import datetime

    at = lambda d, h, m, s=0: datetime(2024, 1, d, h, m, s)
    rows = [(1, 7, "purchase", at(1, 23, 50)), (2, 7, "click", at(2, 0, 10)), (3, 7, "purchase", at(2, 0, 5)), (4, 7, "click", at(2, 1, 0)), (5, 7, "click", at(2, 9, 0)), (6, 8, "click", at(1, 5, 0)), (7, 8, "purchase", at(1, 5, 0)), (8, 9, "purchase", at(1, 5, 0)), (9, 9, "click", at(1, 6, 0))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in base.QUERIES["occurrence_matching"](spark, str(tmp_path)).collect())
    assert got == [(7, 1, 2), (7, 3, 4), (8, 7, 6)]


def test_ties_in_large_groups():
    from fractions import Fraction

    # All delays equal: the smaller column for the smaller row, in every row; the last row has a choice of many.
    n = 20
    allowed = [[(j, Fraction(1)) for j in range(n, -1, -1)] for _ in range(n)]
    assert matching.earliest_matching(allowed, n + 1) == [(i, i) for i in range(n)]


def test_sample_sets_of_equal_sum(spark, tmp_path):
    sets = {"NO": (1, 4), "AF": (2, 3), "RF": (1, 4), "NF": (1, 4, 5), "RO": (1,)}
    rows = [(c[0], c[1], s, 0.1) for c, ids in sets.items() for s in ids]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.candidate for r in base.QUERIES["completion_problems"](spark, str(tmp_path)).collect()) == ["AF", "NF", "RO"]


def test_bootstrap_resamples(spark, sf_dir, monkeypatch):
    from gleaner.plans import ledger_queries

    asked = {}
    monkeypatch.setattr(ledger_queries.stats, "bootstrap_mean", lambda *a, **k: asked.update(k))
    base.QUERIES["bootstrap_interval"](spark, sf_dir)
    assert asked["resamples"] == 10_000


def test_keyframes_of_whole_histories(spark, sf_dir):
    from gleaner.operators import matching

    by_user = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value", "ts").collect():
        by_user.setdefault(r.user_id, []).append((r.ts.timestamp(), r.event_id, r.value))
    want = set()
    for user, rows in by_user.items():
        rows.sort()
        want |= {(user, rows[i][1]) for i in matching.keyframes([r[0] for r in rows], [r[2] for r in rows], 3600.0, 95.0, "hybrid")}
    assert {tuple(r) for r in base.QUERIES["keyframes"](spark, sf_dir).collect()} == want


def test_keyframes_pass_stretches_through(spark, sf_dir, tmp_path):
    """No group is handed to Python on its own; the picks are those of matching.keyframes for each user, missing values too."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 5 = 0")
    odd = rows.limit(40).withColumn("value", F.lit(None).cast("double")).withColumn("event_id", F.col("event_id") + 10_000_000)
    rows.unionByName(odd).write.parquet(f"{tmp_path}/events.parquet")
    found = base.QUERIES["keyframes"](spark, str(tmp_path))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    users = {}
    for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect():
        users.setdefault(r.user_id, []).append((r.ts.timestamp(), r.event_id, -1.0 if r.value is None else r.value))
    want = set()
    for user, rows_ in users.items():
        rows_.sort()
        want |= {(user, rows_[i][1]) for i in matching.keyframes([r[0] for r in rows_], [r[2] for r in rows_], 3600.0, 95.0, "hybrid")}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("name", "most"), [("sample_pivot", 1), ("completion_problems", 2)])
def test_results_are_exchanged_once(spark, sf_dir, tmp_path, name, most):
    """One exchange of lines by sample (and one of a row a candidate); missing keys and candidates as the SQL has them."""
    import duckdb

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lines_whole")
    kept = "l_orderkey % 20 = 3"
    cases = {"all": kept, "no first": f"{kept} AND concat(l_returnflag, l_linestatus) <> 'NO'", "first only": f"{kept} AND concat(l_returnflag, l_linestatus) = 'NO'"}
    for k, (case, where) in enumerate(cases.items()):
        for odd in ("", " UNION ALL SELECT null, 'NO', 0.5", " UNION ALL SELECT 3, null, 0.5"):
            path = f"{tmp_path}/{k}{len(odd)}"
            spark.sql(f"SELECT l_orderkey, l_returnflag, l_linestatus, l_discount FROM lines_whole WHERE {where}" + odd.replace("'NO'", "'N', 'O'").replace("3, null", "3, null, 'O'").replace("0.5", "0.5D")).write.parquet(f"{path}/lineitem.parquet")
            found = base.QUERIES[name](spark, path)
            db = duckdb.connect()
            db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
            rows = lambda x: sorted((tuple(map(str, r)) for r in x))
            assert rows(tuple(r) for r in found.collect()) == rows(db.execute(base.SQL[name]).fetchall()), (case, odd)
    executed = base.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?:l_orderkey|sample)", executed)) <= most and not re.search(r"hashpartitioning\(_?[a-z_]*groupingexpression|hashpartitioning\([^,)]*, sample", executed)

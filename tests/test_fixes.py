"""Cases that earlier versions got wrong, against direct versions."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import chunking, spans


def test_nearest_kept_ancestor_climbs_any_chain(spark):
    rng = random.Random(3)
    parent = {i: (rng.randrange(i) if rng.random() < 0.9 else None) if i > 300 else i - 1 for i in range(1, 600)} | {0: None, 900: 901, 901: 900, 902: 77777}
    kept = {i: i == 0 or rng.random() < 0.1 for i in parent} | dict.fromkeys(range(1, 300), False) | {900: False, 901: False}
    items = spark.createDataFrame([(i, parent[i], kept[i]) for i in parent], "item long, parent long, kept boolean")

    def brute(i):
        at, seen = parent[i], set()
        while at in parent and not kept[at] and at not in seen:
            seen.add(at)
            at = parent[at]
        return at if at in parent and kept[at] else None

    assert {r.item: r.ancestor for r in spans.nearest_kept_ancestor(items).collect()} == {i: brute(i) for i in parent}
    assert spans.nearest_kept_ancestor(items.limit(0)).count() == 0


def test_refusal_inside_an_answer(spark):
    rows = spark.createDataFrame([("Sorry, I DON'T have enough evidence.", False), ("see [1]", True), ("see [9]", False), ("none", False)], "a string, b boolean")
    got = [r.v for r in rows.select(tx.citations_valid(F.col("a"), F.lit(5), "don't have enough evidence").alias("v")).collect()]
    assert got == [True, True, False, False]


def test_recursive_windows_against_a_scan():
    rng = random.Random(5)
    for n in (0, 1, 5, 40, 400):
        for _ in range(30):
            text = "".join(rng.choices(["a", "b. ", ". ", " ", "\n", "\n\n", "word"], k=n))
            size, overlap = rng.randint(5, 60), rng.randint(0, 4)
            want, start = [], 0
            while start < len(text):
                stop = min(len(text), start + size)
                if stop < len(text):
                    places = [max((i for i in range(start, stop - len(s) + 1) if text.startswith(s, i)), default=-1) + len(s) for s in ("\n\n", "\n", ". ", " ")]
                    good = [p for p, s in zip(places, (2, 1, 2, 1), strict=True) if p - s > start + size * 0.5]
                    stop = good[0] if good else stop
                if text[start:stop].strip():
                    want.append((start, stop))
                start = len(text) if stop == len(text) else max(start + 1, stop - overlap)
            assert chunking.recursive_windows(text, size, overlap) == want


def test_merge_spans_against_points():
    rng = random.Random(7)
    for _ in range(200):
        found = [(a, a + rng.randint(1, 6)) for a in rng.choices(range(40), k=rng.randint(0, 9))]
        cover = {x for a, b in found for x in range(2 * a, 2 * b + 1)}
        want = [(a // 2, max(x for x in range(a, 200) if set(range(a, x + 1)) <= cover) // 2) for a in sorted(cover) if a - 1 not in cover]
        assert chunking.merge_spans(found) == want


def test_near_duplicates_tokenise_each_text_once(spark, sf_dir):
    """No filter that the optimiser made may hold the tokeniser."""
    from gleaner.plans.ledger_queries import near_duplicate_leakage

    plan = near_duplicate_leakage(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Filter" in x]
    assert lines and not any("xxhash64" in x or "array_distinct" in x for x in lines)


def test_best_match_ties_and_nulls(spark):
    from gleaner.operators import spans

    rows = [(1, 0.9, 5, "b"), (1, 0.9, 5, "a"), (1, 0.9, 6, "c"), (1, 0.5, 0, "d"), (2, 0.4, 0, "a"), (3, None, 0, "a"), (4, 0.5, 1, "x"), (4, 0.5, 1, "x")]
    pairs = spark.createDataFrame(rows, "d long, sim double, start long, id string")
    got = spans.best_match(pairs, ["d"], "sim", 0.5, ["start", "id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.9, 5, "a"), (4, 0.5, 1, "x")]
    assert spans.best_match(pairs.limit(0), ["d"], "sim", 0.5, ["start", "id"]).count() == 0


def test_paired_interval_counts_groups_by_size(spark):
    from gleaner.operators import stats

    # Group 0 has 9 paired samples of difference 1, group 1 one of difference 0; sample 99 is not paired.
    rows = [(c, i, 0 if i < 9 else 1, (1.0 if i < 9 else 0.0) if c == "a" else 0.0) for c in "ab" for i in range(10)] + [("a", 99, 2, 50.0), ("b", 98, 2, None)]
    df = spark.createDataFrame(rows, "c string, s long, g long, v double")
    got = stats.paired_interval(df, "c", "s", "v", "g", resamples=200).first()
    assert (got.left, got.right, got.groups, got.reason) == ("a", "b", 2, None) and abs(got.estimate - 0.9) < 1e-12
    assert got.low == 0 and got.high == 1 and got == stats.paired_interval(df.repartition(3), "c", "s", "v", "g", resamples=200).first()
    alone = stats.paired_interval(df.where("g = 0"), "c", "s", "v", "g", resamples=50).first()
    assert (alone.low, alone.high, alone.reason) == (None, None, "insufficient_independent_sources")


def test_interval_union_as_its_sql_on_odd_rows(spark, tmp_path):
    """Missing quantities, which Spark sorts first and SQL last, and equal spans that end before they start."""
    import duckdb

    from gleaner.plans import base, text_queries  # noqa: F401

    rng = random.Random(8)
    rows = [(k, rng.choice([None, 1, 2, 3, 3]), rng.choice([None, 1, 2, 4]), rng.choice([None, -40.0, -40.0, -3.0, 0.0, 10.0, 30.0])) for k in range(60) for _ in range(6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    key = lambda r: [(x is None, x or 0) for x in r]
    got = [(r.k, r.start, r.end) for r in base.QUERIES["interval_union"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(con.execute(f"SELECT k, start, \"end\" FROM ({base.SQL['interval_union']})").fetchall(), key=key)


@pytest.mark.parametrize("most", [500_000, 0])
def test_near_duplicates_exchange_shingles_once(spark, sf_dir, most, monkeypatch):
    """Whole sets stay where they are while ids are few; rows are the same if they are many."""
    from gleaner.plans import ledger_queries

    plans, keep = [], ledger_queries.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, ledger_queries.near_duplicate_leakage(spark, sf_dir).collect()))
    monkeypatch.setattr(ledger_queries, "SENT_IDS", most)
    monkeypatch.setattr(ledger_queries, "written", lambda df, tag: plans.append((tag, plan(df))) or keep(df, tag))
    assert sorted(map(tuple, ledger_queries.near_duplicate_leakage(spark, sf_dir).collect())) == want and want
    tags = dict(plans)
    assert ("sets" in tags) == (not most) and (not most or "SortMergeJoin [doc_id" not in tags["pairs"] + tags["candidates"])


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_are_all_pairs(spark, tmp_path, block, monkeypatch):
    """Copies come out as all their pairs, also with each copy of a near text, as in the SQL."""
    import duckdb

    from gleaner.plans import base, ledger_queries

    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    texts = [" ".join(words[0])] * 7 + [" ".join([*words[0], "end"]).upper()] * 5 + [" ".join([*words[0], "end"])] + [" ".join(words[1])] * 3 + [" ".join(words[2]), "short one", ""]
    rows = list(zip(random.Random(4).sample(range(100), len(texts)), texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    monkeypatch.setattr(ledger_queries, "CLASS_BLOCK", block, raising=False)
    got = sorted(map(tuple, base.QUERIES["near_duplicate_leakage"](spark, str(tmp_path)).select("a", "b", "jaccard").collect()))
    assert got == sorted(con.execute(base.SQL["near_duplicate_leakage"]).fetchall()) and len(got) == 13 * 12 // 2 + 3

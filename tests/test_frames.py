"""Frames of retrieval queries are made once; evidence is found in one pass; blocks of queries meet blocks of vectors."""

import random
import re

import numpy as np
import pytest

from gleaner.operators import chunking, retrieval
from gleaner.plans import base, retrieval_queries, scoring_queries  # noqa: F401

LEXICAL = ["bm25_topk", "context_pack", "covered_units", "ndcg_at_5", "unit_recall_at_5", "alpha_dcg_at_5", "evidence_matches", "retrieved_tokens", "token_precision_at_3", "document_macro", "context_blocks", "rerank_permutation"]


@pytest.mark.parametrize("name", LEXICAL)
def test_documents_are_read_and_cut_once(spark, sf_dir, name, monkeypatch):
    """At most one chunker and two scans of documents, over the written frames and the plan that reads them."""
    plans = []
    keep = base.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(base, "written", seen)
    plans.append(base.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    scans = sum(len(re.findall(r"FileScan parquet [^\n]*documents\.parquet", p)) for p in plans)
    python = sum(len(re.findall(r"MapInArrow (?:run|\()", p)) for p in plans)
    assert scans <= 2 and python <= (3 if name in ("token_precision_at_3", "rerank_permutation") else 2), (scans, python)


def test_chunk_terms_and_tables_of_several_files(spark, tmp_path, monkeypatch):
    """Terms are written as one string and come back as they were; a table of several files is cut without an exchange."""
    texts = ["Ab c_d  e\u0301 \u0130x " * 40, "one", "...", "", None, "\u65e5\u672c x\u00dfy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def kept(df, tag, f=base.written):
        seen.append((dict(df.dtypes), df._jdf.queryExecution().executedPlan().toString()))
        return f(df, tag)

    monkeypatch.setattr(base, "written", kept)
    token = base._FRAMES.set({})
    try:
        got = {r.position: r.terms for r in base.chunk_frame(spark, str(tmp_path)).collect()}
    finally:
        base._FRAMES.reset(token)
    want = {r.position: r.terms for r in base.chunk_rows(spark, str(tmp_path)).withColumn("terms", base.tokens(base.F.col("chunk"))).collect()}
    assert got == want and len(got) > 3
    ((kinds, plan),) = seen
    assert "terms" not in kinds and kinds["words"] == "string" and "Exchange" not in plan


def test_first_places(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é日", k=rng.randrange(0, 60))) for _ in range(80)] + ["", None]
    items = sorted({"".join(rng.choices("ab é日", k=rng.randrange(1, 5))) for _ in range(50)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(900, ""), (901, None), (902, items[3])], "question long, item string")
    want = {(i, d, t.find(x), t.find(x) + len(x)) for i, x in [*enumerate(items), (902, items[3])] for d, t in enumerate(texts) if t and x in t}
    for most in (4 << 20, 20):
        monkeypatch.setattr(chunking, "ITEM_CHARS", most)
        got = [tuple(r) for r in chunking.first_places(docs, asked, "question", "item").collect()]
        assert len(got) == len(want) and set(got) == want
    assert chunking.first_places(docs, asked.limit(0), "question", "item").count() == 0


@pytest.mark.parametrize("blocks", [(16_384, 2_048, 1_024), (30, 9, 4)])
def test_cosine_grid(spark, monkeypatch, blocks):
    for name, value in zip(("VECTOR_ROWS", "SMALL_ROWS", "QUERY_ROWS"), blocks, strict=True):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(500, None, 0), (501, [1.0, 2.0], 0), (502, [0.0] * 4, 0), (503, [1.0, None, 1.0, 1.0], 0), (505, [2.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").repartition(4)
    asked = frame.where("vec_id % 10 = 0 or vec_id = 505").withColumnRenamed("vec_id", "query_id")
    good = [(i, np.array(v), c) for i, v, c in rows if v and None not in v and any(v)]
    for filtered in (False, True):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in retrieval.cosine_top(frame, asked if filtered else asked.drop("label"), 5).collect()}
        want, ties = {}, {}
        for i, v, c in [g for g in good if g[0] % 10 == 0 or g[0] == 505]:
            scores = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w, k in good if len(w) == len(v) and (not filtered or k == c)]
            for place, (s, j) in enumerate(sorted(scores)[:5]):
                want[i, place + 1] = (j, pytest.approx(-s, abs=1e-8))
            cut = sorted(scores)[:5][-1][0]
            ties[i] = (min(5, len(scores)), sum(s < cut for s, _ in scores), sum(s == cut for s, _ in scores))
        assert got == want
        reference = retrieval.tie_reference(frame, asked if filtered else asked.drop("label"), 5).collect()
        assert {r.query_id: (r.effective, r.strict, r.boundary) for r in reference} == ties


@pytest.mark.parametrize("most", [50_000, 7])
def test_exact_percentiles(spark, monkeypatch, most):
    from gleaner.operators import metrics

    monkeypatch.setattr(metrics, "RANGE_VALUES", most)
    rng = random.Random(7)
    rows = [("a", rng.gauss(0, 5)) for _ in range(201)] + [("b", float(rng.randrange(4))) for _ in range(100)] + [("c", 3.0)] + [("d", None)] * 3 + [(None, 1.0), (None, 2.0)]
    rows += [("hot", 1.0)] * 300 + [("hot", float(i)) for i in range(20)]
    got = {r.k: r for r in metrics.exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", 0.0, 0.25, 0.5, 0.95, 1.0).collect() if r.k}
    for k in ("a", "b", "c", "hot"):
        v = [x for g, x in rows if g == k]
        assert [got[k][f"p{p}"] for p in (0, 25, 50, 95, 100)] == pytest.approx(np.quantile(v, [0, 0.25, 0.5, 0.95, 1]).tolist()) and got[k].n == len(v)
    assert set(got) == {"a", "b", "c", "hot"}


@pytest.mark.parametrize("blocks", [(16_384, 2_048, 1_024, 2_048), (9, 5, 2, 3)])
def test_bm25_in_blocks(spark, monkeypatch, blocks):
    """Rankings against a plain loop, also where idf falls below 0; pairs of a query and a chunk are not exchanged."""
    for name, value in zip(("VECTOR_ROWS", "SMALL_ROWS", "QUERY_ROWS", "CHUNK_ROWS"), blocks, strict=True):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(3)
    chunks = [(3 * i, rng.choices(["a", "b", "c", "d", "e", "f"], [9, 9, 3, 2, 1, 1], k=rng.randrange(0, 9))) for i in range(40)]
    queries = [(1, "a b b"), (2, "f e"), (3, ""), (4, "zz"), (5, "c d a"), (6, "e")]
    n, mean = len(chunks), sum(len(t) for _, t in chunks) / len(chunks)
    df = {w: sum(w in t for _, t in chunks) for w in "abcdef"}
    raw = {w: np.log(n - k + 0.5) - np.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    heads, want = {p for p, _ in sorted(chunks)[:4]}, []
    for q, text in queries:
        scores = []
        for p, t in chunks:
            words = [w for w in text.split() if w in t]
            s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in words)
            scores += [(-round(s, 9), p)] if words or p in heads else []
        want += [(q, p, place + 1, pytest.approx(-s, abs=1e-8)) for place, (s, p) in enumerate(sorted(scores)[:4])]
    frame = spark.createDataFrame(chunks, "position long, terms array<string>").repartition(3).withColumn("chunk_id", retrieval.F.col("position"))
    found = retrieval.bm25_top(frame, spark.createDataFrame(queries, "query_id long, query string"), 4)
    assert sorted((r.query_id, r.position, r["rank"], r.score) for r in found.collect()) == sorted(want, key=lambda w: w[:2])
    assert not re.search(r"hashpartitioning\(query_id[^,)]*, (chunk_id|position)", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("terms", [1 << 20, 5])
def test_bm25_exchanges_no_chunks(spark, monkeypatch, terms):
    """Chunks are scored where they are read, in as many passes as the queries' terms take; blocks and passes change no row."""
    rng = random.Random(4)
    chunks = [(i, rng.choices("abcdefgh", k=rng.randrange(0, 9))) for i in range(300)]
    queries = [(i, " ".join(rng.choices("abcdefghz", k=3))) for i in range(12)]
    frame = spark.createDataFrame(chunks, "position long, terms array<string>").repartition(4).withColumn("chunk_id", retrieval.F.col("position"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    want = sorted(map(tuple, retrieval.bm25_top(frame, asked, 7).collect()))
    for name, value in (("PASS_TERMS", terms), ("QUERY_ROWS", 5), ("CHUNK_ROWS", 11)):
        monkeypatch.setattr(retrieval, name, value)
    found = retrieval.bm25_top(frame, asked, 7)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 12 * 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and not re.search(r"Exchange hashpartitioning\(_*cell", plan)
    assert retrieval.bm25_top(frame, asked.limit(0), 7).count() == 0 and retrieval.bm25_top(frame.limit(0), asked, 7).count() == 0


@pytest.mark.parametrize("name", ["reranked", "rerank_permutation", "token_precision_at_3"])
def test_no_frame_holds_all_chunk_texts(spark, sf_dir, name, monkeypatch):
    """Texts of found chunks are cut from their documents; the frame of all chunks is one, without texts."""
    seen, keep = [], base.written
    monkeypatch.setattr(base, "written", lambda df, tag: seen.append((tag, df.columns)) or keep(df, tag))
    base.QUERIES[name](spark, sf_dir)
    assert [tag for tag, _ in seen].count("chunks") == 1
    assert not any("chunk" in columns for _, columns in seen)


def test_hit_texts(spark, sf_dir):
    hits = base.chunk_frame(spark, sf_dir, texts=True).where("position % 3 = 0").select("position", "doc_id", "start", "end", "chunk")
    want = dict(hits.select("position", "chunk").collect())
    got = retrieval_queries.hit_texts(spark, sf_dir, hits.drop("chunk").union(hits.drop("chunk"))).collect()
    assert len(got) == len(want) > 50 and dict(got) == want

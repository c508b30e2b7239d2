from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, quality, queries
from gleaner.llm.common import materialise

from .test_jaccard import brute as brute_groups
from .test_suffixes import spans as brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(90)
    more = docs.limit(1)
    docs = docs.unionByName(more).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "mixing", "tokens"]
    step = lambda name, d: materialise(stages[name](spark, d, sf_dir), "test")

    one = step("quality", docs)
    want = quality.score(docs, queries.quality_machine(spark, sf_dir, docs)).where("score >= 0.5").count()
    assert one.columns == columns and one.count() == want

    two = step("near_duplicates", docs)
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(k for k, (_, c) in groups.items() if k == c)

    three = step("repeats", docs)
    want = Counter()
    for (k, t), spans in brute_spans([(r.doc_id, r.text) for r in docs.collect()]):
        raw, left, at = (t or "").encode(), b"", 0
        for a, b in spans:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b < len(raw) and a < b and raw[b] & 0xC0 == 0x80:
                b -= 1
            left, at = left + raw[at:a], b
        want[k, (left + raw[at:]).decode()] += 1
    got = Counter()
    for r in three.collect():
        assert r.n_chars == len(r.text or "")
        got[r.doc_id, r.text or ""] += 1
    assert three.columns == columns and got == want

    four = step("mixing", three)
    times = Counter(r.doc_id for r in four.collect())
    assert four.columns == columns and max(times.values()) <= 4 and set(times) <= {r.doc_id for r in docs.collect()}

    five = step("tokens", two)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.TOKENIZER)), special_tokens={})
    texts = {r.doc_id: r.text for r in two.collect()}
    assert five.count() == two.count()
    for r in five.collect():
        assert r.decodes and r.ids == enc.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_rows_of_one_doc_id(spark, sf_dir):
    """Rows are told apart by doc_id and text, and groups by what links them."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(3, text["b"] + " z", "s1"), (5, text["a"], "s1"), (5, text["b"], "s1"), (9, text["c"], "s2"), (9, text["c"], "s1"), (9, text["c"], None), (11, text["c"] + " z", "s1")]
    rows += [(20, None, "x"), (20, None, "x"), (20, "", "x"), (None, "", "x"), (None, text["d"], "s1"), (12, text["d"] + " z", "s1"), (None, "only here " + text["a"][::-1], "q")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert got.columns == docs.columns
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    found = sorted(((r.doc_id, r.text or "", r.source) for r in got.collect()), key=key)
    want = [(3, text["b"] + " z", "s1"), (5, text["a"], "s1"), (9, text["c"], None), (20, "", "x"), (None, "", "x"), (12, text["d"] + " z", "s1"), (None, "only here " + text["a"][::-1], "q")]
    assert found == sorted(want, key=key)


def test_run(spark, tmp_path, sf_dir):
    """run() gives what its stages give one after another, and nothing of a rejected, doubled or repeated text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 5"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = materialise(stage(spark, step, str(tmp_path)), "test")
    want = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decodes) for r in step.collect())
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decodes) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and all(k[3] for k in got)
    good = {r.doc_id for r in quality.score(docs, queries.quality_machine(spark, str(tmp_path), docs)).where("score >= 0.5").collect()}
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good])
    assert {k[0] for k in got} <= {k for k, (_, c) in groups.items() if k == c}


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0

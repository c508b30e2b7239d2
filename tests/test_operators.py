"""Operators without SQL, against hand-made values and brute force."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import chunking, matching, spans, stats, store
from gleaner.sources import manifests
from gleaner.streaming import ledger


@pytest.mark.parametrize("seed", range(30))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, 5, (rng.integers(1, 6), rng.integers(1, 6))) / 4
    n, m = score.shape
    best = max(sum(score[i, j] for i, j in zip(r, c, strict=True)) for k in range(min(n, m) + 1) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
    pairs = matching.assignment(score)
    assert sum(score[i, j] for i, j in pairs) == pytest.approx(best)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


@pytest.mark.parametrize("seed", range(30))
def test_earliest_matching(seed):
    rng = random.Random(seed)
    rows, columns = rng.randrange(0, 5), rng.randrange(0, 5)
    allowed = [[(j, Fraction(rng.randrange(6), 2)) for j in range(columns) if rng.random() < 0.6] for _ in range(rows)]
    cost = {(i, j): d for i, r in enumerate(allowed) for j, d in r}
    best = min((-len(p), sum((cost[x] for x in p), Fraction(0)), tuple(dict(p).get(i, 99) for i in range(rows))) for k in range(min(rows, columns) + 1) for p in itertools.combinations(cost, k) if len({i for i, _ in p}) == len({j for _, j in p}) == k)
    got = matching.earliest_matching(allowed, columns)
    assert (-len(got), sum((cost[x] for x in got), Fraction(0))) == best[:2]


def test_alignment_and_edits():
    ref, pred = [["a", "b"], ["c", "d"], ["e"]], [["a"], ["b"], ["x"], ["c", "d"], ["e", "f"]]
    assert matching.align_spans(ref, pred, 0.6) == [(0, 0, 2), (1, 3, 4), (2, 4, 5)]
    assert matching.align_spans([], pred, 0.6) == []
    assert matching.edit_operations(list("kitten"), list("sitting")) == (2, 0, 1)
    assert matching.edit_operations([], ["a"]) == (0, 0, 1) and matching.edit_operations(["a"], []) == (0, 1, 0)
    assert matching.stitch(list("abcab"), list("cabx")) == 3 and matching.stitch([], ["a"]) == 0
    assert matching.representatives([["a", "b"], ["a", "b"], ["c"]]) == [0, 0, 2]


def test_greedy_ideal_and_frames():
    assert matching.greedy_ideal([frozenset("ab"), frozenset("a"), frozenset("c")], 2) == pytest.approx(2 + 1 / np.log2(3))
    assert matching.keyframes([0, 1, 2, 3, 4], [0, 0, 9, 0, 0], 3, 5, "hybrid") == [0, 2]
    assert matching.keyframes([0, 1, 2, 3, 4], [0, 0, 9, 0, 0], 3, 5, "fixed") == [0, 3]
    assert matching.keyframes([0, 1, 2], [0, 0, 9], 3, 5, "scene") == [0, 2]
    assert matching.visible_answer("a<think>b<think>c</think>d</think> e") == ("a e", "bcd") and matching.visible_answer("x</think>y") == ("y", "x")
    assert matching.visible_answer("a<THINK>b</Think>c</think>d") == ("acd", "b") and matching.visible_answer("b</think>c", "go: <Think> \n") == ("c", "b")
    assert matching.visible_answer("") == ("", "") and matching.visible_answer("x", "<think>") == ("", "x")


def test_html_cells():
    cells = matching.html_cells("<table><tr><th colspan=2>a</th><td rowspan=2>b</td></tr><tr><td>c</td><td>d &amp; e</td></tr></table><table><tr><td>x</table>")
    assert cells == [(0, 0, 0, 1, 2, True, "a"), (0, 0, 2, 2, 1, False, "b"), (0, 1, 0, 1, 1, False, "c"), (0, 1, 1, 1, 1, False, "d & e"), (1, 0, 0, 1, 1, False, "x")]


def test_chunkers_cover_their_text():
    rng = random.Random(1)
    table = "| a | b |\n|---|---|\n| c | d |\n"
    for _ in range(60):
        text = "".join(rng.choice(["word ", "One two. ", "\n", "\n\n", "# Head line\n", "$$x + y$$", table, "<table><tr><td>q</td></tr></table>", "é日 ", "! "]) for _ in range(rng.randrange(0, 60)))
        for a, b, n in [*chunking.token_windows(text, 7, 2), *chunking.section_windows(text, 7, 2), *chunking.structure_windows(text, 12, 2)]:
            assert 0 <= a < b <= len(text) and n == len(chunking.token_spans(text[a:b]))
        assert all(n <= 12 for _, _, n in chunking.structure_windows(text, 12, 2))
        sentences = chunking.sentence_spans(text)
        assert [a for a, _ in sentences] + [len(text)] * bool(sentences) == [0] * bool(sentences) + [b for _, b in sentences]
        windows = chunking.recursive_windows(text, 30, 5)
        covered = set(itertools.chain.from_iterable(range(a, b) for a, b in windows))
        assert covered == set(range(len(text))) and all(b - a <= 30 for a, b in windows)
        protected = chunking.structured_spans(text)
        assert all(a < b for a, b in protected) and protected == chunking.merge_spans(protected)
    assert chunking.structured_spans("x\n" + table) == [(2, 2 + len(table))]


def test_structured_spans():
    for table in ("a | b\n---|---\n1 | 2\n", "|a|b|\n|:---|---:|\n|1|2|", "x | y\nz | w\n--- | ---"):
        assert chunking.structured_spans(table) == [(0, len(table))]
        assert chunking.structured_spans("text\n" + table + "\n\nmore")[0][0] == 5
    for no in ("a | b\n1 | 2\n", "a | b\n--|--\n", "---|---\n", "a | b\n\n---|---\n", "x | y\nz | w\nq | r\n---|---\n"):
        assert chunking.structured_spans(no) == []
    assert chunking.structured_spans("a $$x\ny$$$$z$$ \\[u\\] <TABLE x>|</table>") == [(2, 14), (15, 20), (21, 39)]


def test_sentences():
    assert chunking.sentence_spans("a.\n\nb.") == [(0, 2), (2, 6)] and chunking.sentence_spans("...") == [(0, 3)]
    assert chunking.sentence_spans("") == chunking.sentence_spans("\n\n") == [] and chunking.sentence_spans(" ?!a") == [(0, 3), (3, 4)]


def test_structure_ceiling():
    """No chunk is above the ceiling, whatever the units; what fits together is together."""
    row = "| " + " | ".join(f"c{i}" for i in range(300)) + " |\n"
    table = "| h | i |\n|---|---|\n" + "| a b | c |\n" * 40 + row
    for text in (table, "# One\n" + table + "# Two\n" + "w " * 500, "$$ " + "x " * 300 + "$$", "<table>" + "<td>q" * 200 + "</table>"):
        for size, overlap in ((64, 16), (5, 0), (1, 0)):
            got = chunking.structure_windows(text, size, overlap)
            assert all(0 <= n <= size and n == len(chunking.token_spans(text[a:b])) for a, b, n in got)
            covered = set(itertools.chain.from_iterable(range(a, b) for a, b, _ in got))
            assert covered >= {i for a, b in chunking.token_spans(text) for i in range(a, b)}
    # Rows of a table hold together until one is above the ceiling by itself.
    got = chunking.structure_windows(table, 64, 16)
    assert text_rows(table, got[0]) and got[0] == (0, 20 + 12 * 20, 62) and got[-1][2] <= 64
    # Sections merge up to the ceiling; a heading inside a formula is none.
    text = "# A\none two\n# B\nthree\n$$\n# C\n$$\n# D\nfour five six"
    assert [n for *_, n in chunking.structure_windows(text, 6, 0)] == [6, 4] and [n for *_, n in chunking.structure_windows(text, 3, 0)] == [3, 3, 3, 1]


def text_rows(text, chunk):
    return text[: chunk[1]].endswith("\n") and text[chunk[0]] == "|"


def test_text_functions(spark):
    rows = spark.createDataFrame([("áb\r\nco-\nop \t x­\n\n\n\nend  ", ["a", "b", "c"], ["a", "x", "c", "d"])], "t string, r array<string>, h array<string>")
    got = rows.select(tx.normalize(F.col("t")).alias("c"), tx.normalize(F.col("t"), "none").alias("n"), tx.word_error_rate(F.col("r"), F.col("h")).alias("w")).first()
    assert got.c == "áb\ncoop x\n\nend" and got.n.startswith("á") and got.w == pytest.approx(2 / 3)
    sizes = spark.createDataFrame([("12.5MiB",), ("3 kB",), ("x",)], "s string").select(tx.bytes_of(F.col("s")).alias("b")).collect()
    assert [r.b for r in sizes] == [13_107_200, 3000, None]


def test_overlap_join(spark):
    rng = random.Random(2)
    make = lambda p: [(rng.randrange(3), *sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(40)]
    left, right = make(0), make(1)
    got = spans.bucketed_overlap(spark.createDataFrame(left, "k int, l_start int, l_end int"), spark.createDataFrame(right, "k int, r_start int, r_end int"), "k", 7).count()
    assert got == sum(a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2] for a in left for b in right)


def test_bootstrap(spark):
    rng = random.Random(3)
    rows = [("m", g, 10 + g % 5 + rng.random()) for g in range(40) for _ in range(3)] + [("few", 1, 5.0)]
    df = spark.createDataFrame(rows, "metric string, g int, v double")
    got = {r.metric: r for r in stats.bootstrap_mean(df, "v", "g", ["metric"], resamples=400).collect()}
    assert got["m"].low < got["m"].estimate < got["m"].high and got["m"].high - got["m"].low < 1.5
    assert got["few"].low is None and got["few"].reason == "insufficient_independent_sources"
    again = stats.bootstrap_mean(df.repartition(5), "v", "g", ["metric"], resamples=400).where("metric = 'm'").first()
    assert again.low == pytest.approx(got["m"].low)


RECORD = "id string, source_id string, vector array<float>, text string, metadata map<string,string>"


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = store.SnapshotStore(spark, path, {"dimension": 2})
    rec = lambda *rows: spark.createDataFrame(list(rows), RECORD)
    s.upsert(rec(("a", "d1", [1.0, 0.0], "x", {"k": "1"}), ("b", "d1", [0.0, 1.0], "y", {"k": "2"}), ("c", "d2", [0.6, 0.8], "z", {"k": "1"})))
    s.upsert(rec(("b", "d1", [0.0, 2.0], "y2", {"k": "2"})))
    assert s.count() == 3 and s.fetch(spark.createDataFrame([("b",)], "id string")).first().text == "y2"
    assert [(r.id, r.rank) for r in s.search([0.0, 1.0], 2).collect()] == [("b", 1), ("c", 2)]
    assert [r.id for r in s.search([0.0, 1.0], 2, {"k": "1"}).collect()] == ["c", "a"]
    s.replace_document(rec(("e", "d1", [1.0, 1.0], "w", {})))
    assert sorted(r.id for r in s.table().collect()) == ["c", "e"]
    for bad in (("f", "d", [1.0], "t", {}), ("f", "d", [float("nan"), 1.0], "t", {}), (None, "d", [1.0, 1.0], "t", {})):
        with pytest.raises(ValueError):
            s.upsert(rec(bad))
    assert s.delete(spark.createDataFrame([("c",), ("q",)], "id string")) == 1
    assert store.SnapshotStore(spark, path, {"dimension": 2}).count() == 1
    with pytest.raises(ValueError):
        store.SnapshotStore(spark, path, {"dimension": 3})
    s.reset()
    assert s.count() == 0


def test_manifest(spark, tmp_path):
    samples = [{"id": "d", "kind": "document", "text": "some text"}, {"id": "q", "kind": "question", "question": "?", "answerable": True, "evidence": [{"id": "u", "document_id": "d", "start": 0, "end": 4, "evidence_type": "text"}, {"id": "v", "document_id": "x", "start": 0, "end": 4, "evidence_type": "text"}, {"id": "v", "document_id": "d", "start": 3, "end": 40, "evidence_type": "text"}]}]
    header = {f: "x" for f in manifests.HEADER if f not in ("samples", "checksum")} | {"split": "dev", "split_seed": 1}
    path = f"file://{tmp_path}/m.json"
    manifests.seal_manifest(spark, header, samples, path)
    head, rows = manifests.read_manifest(spark, path, ("dev",))
    assert head["split"] == "dev" and rows.count() == 2
    problems = {(r.id, r.rule) for r in manifests.evidence_problems(rows).collect()}
    assert problems == {("q", "unknown_document"), ("q", "out_of_range"), ("q", "repeated_unit")}
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, path, ("locked",))
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace("some", "same"))
    (tmp_path / ".m.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, path)


def test_mirrors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\"b", 0.1), (2, None, None), (3, "", 2.5)], "k long, s string, v double")
    assert manifests.write_mirrors(rows, f"file://{tmp_path}/a", ["k"]) == manifests.write_mirrors(rows.orderBy(F.desc("k")), f"file://{tmp_path}/b", ["k"])


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ledger.window_rates(ledger.read_ledger(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " ")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert sorted((r.start, r.submitted) for r in spark.table("rates").collect()) == sorted((r.start, r.n) for r in want.collect())


def test_html_cells_of_plain_pages_are_those_of_the_parser(monkeypatch):
    """Pages of plain tags never reach the parser's own scanner; they, and pages that only look plain, give the cells that it gives."""
    rng = random.Random(6)

    def parsed(html):
        p = matching.TableParser()
        p.feed(html)
        p.close()
        p._close()
        return p.cells

    plain = ["<table>", "<TABLE border=1>", "</table>", "<tr class=x>", "</tr >", "<td>", "<th colspan=2>", '<td rowspan="2" colspan=3\n>', "<td rowspan=0>", '<td colspan="">', "<td COLSPAN=2 colspan=3>", "</td>", "</th>", "<b>", "</b>", "a &amp; b", "&am", "p;", " x\n y ", ">", "é", "&", "&#65"]
    odd = ["<!-- <td>c</td> -->", "<br/>", "<td colspan='2'>", "<td a>", "</td x=1>", "< td>", "<", "<script>", "</script>", "<title>", "</title>", "<?p>", "<td\x0bcolspan=2>", "</>", '<td x="<td>">', "<![CDATA[x]]>"]
    page = lambda parts: rng.choice(["", "<table><tr>"]) + "".join(rng.choices(parts, k=rng.randrange(1, 25)))
    pages = [page(plain) for _ in range(3000)] + [page(plain * 3 + odd) for _ in range(3000)]
    want = [parsed(p) for p in pages]
    assert [matching.html_cells(p) for p in pages] == want and sum(map(bool, want)) > 1000
    monkeypatch.setattr(matching.TableParser, "feed", lambda *_: 1 / 0)
    assert [matching.html_cells(p) for p in pages[:3000]] == want[:3000]
    assert matching.html_cells("<!-- no tables -->") == []

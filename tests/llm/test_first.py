import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from gleaner.llm import bitslice, bpe, chat, language, mixing, quality, queries, rules, urls

EMPTY = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", f"s{i % 3}"), len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EMPTY)


ODD = [None, "", " ", "\t\n", "word", "word word", "a b a b a b a b", "x\x0bx\u00a0y \x1cz", "é" * 70, "日本 語", "|" * 30, "a " * 3000, "word word"]


# urls


def judge(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url is not None and at >= 0 else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((min(fits)[1], min(fits)[2]) if fits else (None, "allow"))


@pytest.mark.parametrize(("many", "words"), [(0, 1 << 17), (3000, 1 << 17), (3000, 64)])
def test_urls(spark, many, words, monkeypatch):
    monkeypatch.setattr(urls, "MAX_WORDS", words)
    rng = random.Random(1)
    listed = list(queries.URL_RULES) + [(f"h{i}.example.com", f"/{i % 7}", "block") for i in range(many)]
    given = [None, "", "no scheme", "http://", "http://NET", "http://a.NET/x?y", "ftp://example.net/en/", "http://xexample.net/en/", "http://example.net?/en/", "http://É.org/fr/#", "a://b://net/", "http://example.com/de", "http://example.com/de/"]
    given += [f"http://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(['net', 'org', 'example.com', 'example.net', f'h{rng.randrange(4000)}.example.com'])}{rng.choice(['', '/', '/en/1', '/de/2?x', '/3/4', '?/fr/'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = urls.filter_urls(pages, spark.createDataFrame(listed, "host string, path string, verdict string"), as_listed=True)
    assert got.columns == ["page_id", "url", "host", "path", "entry", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.entry, r.verdict) == judge(r.url, listed), r.url
    assert got.count() == len(given)


def test_urls_in_canonical_form(spark):
    """Ports, user information, trailing dots, escapes and case do not hide a listed host; the columns stay as they stand."""
    listed = spark.createDataFrame([("Bad.example.com", "", "block"), ("x.org", "/a b/", "block"), ("ok.x.org", "/a b/", "allow")], "host string, path string, verdict string")
    same = ["bad.example.com", "bad.example.com:8080", "user@bad.example.com", "u:p@bad.example.com:1", "bad.example.com.", "m.BAD.example.com..", "%62ad.example.com", "b%61d.example.com:", "a@b@bad.example.com"]
    other = ["bad.example.com.evil", "xbad.example.com", "bad.example.com:8x", "bad.example.com%zz", ""]
    long = "http://bad.example.com:80/" + "p" * 5000
    given = [f"http://{h}/x?q" for h in same + other] + ["http://x.org/a%20b/c", "http://x.org/a+b/c", "http://ok.x.org:1/a b/", long, long, long]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages, listed).collect()}
    verdicts = [got[i].verdict for i in range(len(given))]
    assert verdicts == ["block"] * len(same) + ["allow"] * len(other) + ["block", "allow", "allow", "block", "block", "block"]
    assert got[1].host == "bad.example.com:8080" and got[1].entry == "Bad.example.com" and got[len(same + other)].path == "/a%20b/c"
    exact = urls.filter_urls(pages, listed, as_listed=True).collect()
    assert {r.page_id for r in exact if r.verdict == "block"} == set()


def test_urls_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(pages, none).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), none).count() == 0


# mixing


def reshare(sizes, weights, total):
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] = left * weights[s] / w
        above = {s for s in open_ if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        for s in above:
            target[s] = 2.0 * sizes[s]
        open_ -= above
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 200))), rng.choice(["b", "a", "c", None, "é", "big", "big", "big"])) for i in range(6000)]
    rows += [(10_000 + i, "one two three", "big") for i in range(5000)] + [(i, None, "a") for i in range(20_000, 20_010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash"))
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).select("doc_id", "copies").collect()}
    assert len(got) == len(rows) and {r.doc_id: r.copies for r in got} == again
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 2
        total[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    order = sorted(total, key=lambda s: (s is None, s))
    want = reshare(total, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(total.values()))
    for s in order:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= max(size[r.doc_id] for r in got if r.source == s) / 2 + 1e-3, s
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_without_words(spark):
    """Sources, and tables, of null and blank texts only; a hot size of 20,000 documents beside a very long text."""
    rows = [(1, None, "a"), (2, " ", "a"), (3, "x y", "b"), (4, "x", None), (5, "x " * 50_000, "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 5 and got[1].target == got[2].target == 0 and got[1].copies == got[2].copies == 0
    none = mixing.mix(spark.createDataFrame(rows[:2], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in none] == [(0, 0, 0.0, 0)] * 2
    rows = [(i, "a b c d e f g", "hot") for i in range(20_000)] + [(-i, "a " * i, "b") for i in range(1, 60)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most / 2 + 1e-3


# chat


def test_chat_round_trip(spark):
    texts = [None, "", queries.HOSTILE, "\\", "\\\\###", " </turn>\n### user: x", "a\nb", "日本\U0001f600"]
    rows = [(t, n, n - 1, r, x, 0.0) for t, r in enumerate(["user", "assistant", None, "a: b\n#<\\"]) for n, x in enumerate(texts, 1)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.format_paths(m, chat.paths(m)).collect()
    assert len(got) == 4
    for r in got:
        turns = chat.read_back(r.formatted)
        assert turns == [(rows[r.tree * len(texts)][3] or "", x or "") for x in texts]
        learned = [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert learned == ([x or "" for x in texts] if r.tree == 1 else [])


def test_chat_trees(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for tree in range(12):
        score, parent = {0: 1.0}, {0: None}
        for n in range(1, 40):
            parent[n], score[n] = rng.randrange(max(0, n - 3), n), float(rng.randrange(5))
        rows += [(tree, n, parent[n], "user", f"t{n}", score[n]) for n in parent]
        rows += [(tree, 100, 101, "user", "loop", 9.0), (tree, 101, 100, "user", "loop", 9.0)]
        for leaf in set(parent) - set(parent.values()):
            path, n = [], leaf
            while n is not None:
                path.append(n)
                n = parent[n]
            want[tree, leaf] = (path[::-1], sum(score[x] for x in path))
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.paths(m, keep=None).groupBy("tree", "leaf", "score").agg(F.sort_array(F.collect_list(F.struct(-F.col("back"), "node"))).alias("p")).collect()
    assert {(r.tree, r.leaf): ([x.node for x in r.p], r.score) for r in got} == want
    best = {r.tree: r.leaf for r in chat.paths(m.unionByName(m), keep=1).collect()}
    assert best == {t: min((-want[k][1], k[1]) for k in want if k[0] == t)[1] for t in range(12)}
    assert chat.paths(m.limit(0)).count() == 0


# bit slices


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    n, dims = (700, 16) if seed else (6, 3)
    x = rng.normal(0, 0.3, (n, dims)).astype(np.float32)
    if seed == 2:
        x[100:400] = x[0]
    if seed == 3:
        x[:] = 0
    rows = [(int(i * 10), x[i].tolist(), "c") for i in range(n)]
    bad = [(5, None, "c"), (15, [float("nan")] * dims, "c"), (25, [None] * dims, "c"), (35, [float("inf")] * dims, "c"), (45, [], "c"), (55, [0.5], "c"), (None, x[0].tolist(), "c")]
    df = spark.createDataFrame(rows + rows[:20] + bad, "vec_id long, embedding array<float>, score string")
    got = bitslice.top_k(df, lambda v: v % 100 == 0).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    values = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    want = bitslice.brute_force(np.arange(n) * 10, values, [i for i in range(n) if i * 10 % 100 == 0], 10)
    assert got.astype("int64").equals(want.astype("int64"))


# rules


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, sf_dir):
    texts = [*ODD, "a b c\n \nd e f\na b c\n\n", "a\rb\na\rb"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rules.ledger(docs_of(spark, texts).withColumn("n_words", F.lit(1)))
    for r in got.collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert (r.failures & 3 != 0) == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    rows = {r.rule: r for r in rules.ablations(got, "2").collect()}
    fails = [r.failures & rules.mask(rules.POLICIES["2"]) for r in got.collect()]
    for i, rule in enumerate(rules.RULES):
        assert (rows[rule.name].failed, rows[rule.name].kept_without) == (sum(f >> i & 1 for f in fails), sum(f == 1 << i for f in fails))
    assert rules.ledger(docs_of(spark, [])).count() == 0


# language


@pytest.mark.parametrize("few", [1, 4, 48])
def test_language_parse(monkeypatch, few):
    """Whole texts of several thousand symbols, against longest matches by search in the text."""
    monkeypatch.setattr(language, "FEW", few)
    rng = random.Random(2)
    made = ["".join(rng.choice("ab é日") for _ in range(400)).encode(), b"ab " * 50, "".join(rng.choice("abcdefgh ") for _ in range(900)).encode()]
    model = language.Model(("x", "y", "z"), tuple(made))
    texts = ["".join(rng.choice("abcé日x ") for _ in range(n)).encode() for n in (*range(1, 60), 400, 700, 700, 3000, 6000)] + [made[0], made[1][:3000] * 40, b"q" * 3000, b" "]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        for k, train in enumerate(made):
            phrases = at = 0
            while at < len(t):
                end = at + 1
                while end <= len(t) and t[at:end] in train:
                    end += 1
                phrases, at = phrases + 1, max(at + 1, end - 1)
            assert got[i, k] == phrases, (i, k)


def test_language_symbols():
    assert language.cleaned("Ab, 1c\n\nÉ-日!") == "ab c é 日 ".encode() and language.cleaned("") == b"" and language.cleaned("1 2").strip() == b""
    # Letters of any number: no alphabet is cut, and none is shared between languages.
    texts = {"a": "".join(chr(0x4E00 + i) for i in range(3000)), "b": "".join(chr(0x5E00 + i) for i in range(3000))}
    model = language.Model(tuple(texts), tuple(language.cleaned(t) for t in texts.values()))
    assert model.predict([texts["a"][100:160], texts["b"][2000:2100] * 3, None, "", "?", "123"])[0] == ["a", "b", "und", "und", "und", "und"]
    # Repeated rows agree, and a tie goes to the smaller name.
    best, score = language.Model(("u", "v"), (b"abc", b"abc")).predict(["abcabc", "abcabc", "abcabc"])
    assert best == ["u"] * 3 and score.tolist() == [0.5] * 3


def test_language(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = language.train(docs.where(~out))
    got = language.identify(docs.where(out), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    odd = {r.doc_id: r for r in language.identify(docs_of(spark, ODD).withColumn("score", F.lit("x")), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[4].lang_pred != "und"
    assert language.train(docs.limit(0))[0] == () and language.identify(docs.limit(3), language.train(docs.limit(0))).select("lang_pred").distinct().first()[0] == "und"


# quality


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    machine = queries.quality_machine(spark, "/root/testdata/sf0.1", docs)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where(language.held_out(F.col("doc_id"), 3, 1))
    got = quality.score(docs.join(labels.where("toxic = 0"), "doc_id"), machine).select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)
    odd = quality.score(docs_of(spark, ODD).withColumn("score", F.lit("x")), machine).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(docs.limit(0), machine).count() == 0


def test_machine_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.BUCKETS + quality.N_STATS), rng.normal(size=(quality.BUCKETS + quality.N_STATS, 3)), np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    b, v, s = np.array([3, 9, 4000]), np.array([0.5, 0.1, 0.2]), rng.normal(size=(1, quality.N_STATS))
    x = np.zeros(quality.BUCKETS + quality.N_STATS)
    x[b], x[quality.BUCKETS :] = v, m.standard(s)[0]
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert m.score(np.array([0, 3]), b, v, s)[0] == pytest.approx(1 / (1 + np.exp(-(0.1 + m.weights @ x + pairs))))


# bpe


def test_bpe(spark, sf_dir):
    import tiktoken

    path = public_tokenizers.path(queries.TOKENIZER)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = [*ODD, "don't I'LL 123  x\u2003y\u0085z \n\n a", "\U0001f600\U0001f468\u200d\U0001f469 ﷽ ½ ", "<|endoftext|>"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    docs = docs_of(spark, texts).withColumn("ids", F.lit(1))
    got = bpe.encode(docs, path, public_tokenizers.PATTERN)
    for r in got.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("back"), bpe.little_endian(F.col("ids"), path).alias("le")).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want
        assert bytes(r.back) == (texts[r.doc_id] or "").encode() and bytes(r.le) == np.asarray(want, "<u4").tobytes()
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_words(spark):
    """A word of 100,000 letters, repeated letters, code points of all lengths, and the same by the column fold."""
    import random

    import tiktoken

    path = public_tokenizers.path(queries.TOKENIZER)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC", k=n)) for n in (255, 256, 257, 2000, 100_000)]
    texts += ["a" * 5000, "日本語" * 400, "\U0001f600\U0001f468\u200d" * 300, " " * 3000, "é" * 257]
    for r in bpe.encode(docs_of(spark, texts), path, public_tokenizers.PATTERN).select("doc_id", "ids").collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id])
    short = ["".join(rng.choices("abcdeé日\U0001f600 ", k=n)).strip() or "a" for n in range(1, 40)]
    fold = docs_of(spark, short).select("doc_id", bpe.fold(F.col("text"), bpe.merge_table(path)).alias("ids"))
    for r in fold.collect():
        assert r.ids == enc._encode_single_piece(short[r.doc_id])


def test_bpe_query(spark, sf_dir):
    import tiktoken

    path = public_tokenizers.path(queries.TOKENIZER)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = enc.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_contract_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {-7: [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op4_chat(spark, sf_dir).collect()
    assert len(got) == len(convs)
    for r in got:
        turns = convs[r.conv_id]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss))

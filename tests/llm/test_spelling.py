"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gleaner.llm import queries, spelling


def brute_counts(rows, every=199, least_chars=6, least=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(n, ratio=5):
    deleted = defaultdict(set)  # words that meet after deleting nothing or one letter
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            deleted[x].add(w)
    near = defaultdict(set)
    for group in deleted.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(frame, **more):
    got = spelling.group(frame, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    roots = ["".join(rng.choices("abcdeéÿ", k=rng.randrange(6, 12))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc", "abcabcd", "ababab", "bababa"]
    words = list(roots)
    for w in roots:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcdeé")
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    rows = []
    for d in range(120):
        picked = rng.choices(words, weights=[30 if w in roots else 1 + i % 7 for i, w in enumerate(words)], k=60)
        rows.append((d - 5, " ".join(rng.choice([str, str.upper, str.title])(w) if w.isascii() else w for w in picked) + rng.choice(["", "\n12x", "ł", "_abcdef_"])))
    return [*rows, (None, rows[0][1]), (500, None), (501, ""), (3, rows[8][1]), rows[9], rows[9]]


def test_against_brute_force(spark, made, monkeypatch):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in made], "doc_id long, text string, word string, n long").repartition(5)
    for more in ({}, {"every": 7, "least": 2, "ratio": 2}, {"every": 0, "least_chars": 2, "least": 1, "ratio": 3}):
        own = {k: v for k, v in more.items() if k != "ratio"}
        want = brute(brute_counts(made, **own), more.get("ratio", 5))
        assert result(frame, **more) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("pairs", [1, 7])
def test_hot_segments_and_small_blocks(spark, monkeypatch, pairs):
    # A third of all words share a half.
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", 9)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    rng = random.Random(2)
    words = {"inter" + "".join(rng.choices("abc", k=rng.randrange(4, 7))) for _ in range(90)} | {"".join(rng.choices("abcd", k=rng.randrange(6, 9))) for _ in range(180)}
    n = {w: rng.choice([1, 2, 5, 11, 60]) for w in sorted(words)}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(frame).collect()}
    want = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), best, n[best])
    assert got == want and len(want) > 50
    shard = spelling.Shard(*zip(*[(w, n[w], s, e) for w in n for e, s in enumerate((w[: len(w) // 2], w[len(w) // 2 :]))], strict=True))
    monkeypatch.setattr(spelling, "BLOCK_PAIRS", pairs)
    a, b = shard.near(sorted(words))
    found = Counter(zip([sorted(words)[i] for i in a], [shard.words[i] for i in b], strict=True))
    # Each word stands twice in the shard here, once for each segment; a pair is still found with one of them.
    assert set(found) == {(w, x) for w in n for x in n if one_edit(w, x)}


def test_chains_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert result(none) == {}
    chain = ["abcdef" + "g" * i for i in range(6)]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(2 * 3**i)))]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), every=0, least=2, ratio=3)
    assert [got[w][1] for w in chain] == [chain[-1]] * 6 and got == brute(brute_counts(rows, 0, 6, 2), 3)


def test_query(spark, sf_dir):
    got = queries.QUERIES["op11_spelling"](spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.word: tuple(r)[1:] for r in got.collect()} == brute(brute_counts(rows))

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard


def brute(docs):
    """key -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    docs = []
    for i in range(n):
        kind = rng.random()
        base = list(bases[0] if kind < 0.35 else rng.choice(bases))
        if kind > 0.8:
            base = [rng.choice(words) for _ in range(rng.randrange(0, 60))] + (common if kind > 0.9 else [])
        for _ in range(rng.randrange(0, 4)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        if rng.random() < 0.2 and len(base) > 8:
            base = base[: -rng.randrange(1, 8)]
        docs.append((i * 3, rng.choice([" ", "\n", "\t "]).join(base).title() if rng.random() < 0.3 else " ".join(base)))
    return docs + [(5000, None), (5001, ""), (5002, " \t"), (5003, "a b"), (5004, "A  b"), (5005, "a b"), (5006, "x y z v w"), (5007, "a b c d"), (5008, "a " * 500), (5009, "a " * 7)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    docs = corpus(seed)
    df = spark.createDataFrame([(k, t, k, "c") for k, t in docs], "doc_id long, text string, point long, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute(docs)


def test_skewed_group(spark):
    """Thousands of near copies of one text link through few comparisons; a bridge outside the radius is found."""
    rng = random.Random(9)
    base = ["b%d" % i for i in range(120)]
    docs = []
    for i in range(700):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == brute(docs)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (7, "a b c d e f"), (None, "q"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.join(docs).collect())
    assert got == [(0, 1, 0), (1, 2, 1), (1, 2, 1), (3, 0, 3), (7, 2, 1)]
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.join(docs.where("text is null")).count() == 1


def test_null_keys_and_groups(spark):
    """Rows without key link like any others; rows of one key with different texts are in groups of their own."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    near = [t + " z" for t in text]
    rows = [(None, text[0], "p"), (4, near[0], "q"), (None, text[1], "r"), (None, near[1], "s"), (5, text[2], "t"), (5, near[0], "u"), (5, "", "v"), (None, None, "w")]
    got = {r.name: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3), carry=("name",)).collect()}
    assert list(got["p"].asDict()) == ["doc_id", "name", "n_shingles", "component_id", "group_id"]
    assert {n: r.component_id for n, r in got.items()} == {"p": 4, "q": 4, "r": None, "s": None, "t": 5, "u": 4, "v": 5, "w": None}
    assert got["p"].group_id == got["q"].group_id == got["u"].group_id != got["t"].group_id
    assert got["r"].group_id == got["s"].group_id and got["v"].group_id is got["w"].group_id is None


def test_shared_count_never_short():
    """Blocks of runs that hold copies of the same points count at least the shared shingles of each."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for _ in range(40)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    names = jaccard.points(np.concatenate(sets), bounds)
    rows = []
    for run in (range(0, 25), range(15, 40), range(0, 40, 3)):
        each = [sets[i] for i in run]
        b = np.concatenate(([0], np.cumsum([len(s) for s in each])))
        rows += list(jaccard._pack(np.concatenate(each), b, names[list(run)], 3))
    blocks = [jaccard._emit(sorted(rows, key=lambda r: r[0]))]
    counts = [c for batch in jaccard._count_shared(4)(iter(blocks)) for c in batch.column(1).to_pylist()]
    got = {r["point"]: r for r in jaccard._merged([np.frombuffer(c, jaccard._COUNT) for c in counts])}
    for i, s in enumerate(sets):
        true = sum(any(v in t for j, t in enumerate(sets) if names[j] != names[i]) for v in s)
        assert got[names[i]]["local"] + got[names[i]]["found"] >= true and got[names[i]]["n"] == len(s)


def test_halves_share_a_quarter_and_are_all_that_is_sent(spark):
    """The halves of linked sets share a quarter of either set; the first exchange holds no key beyond the halves."""
    rng = np.random.default_rng(6)
    linked = 0
    for _ in range(400):
        base = np.unique(rng.integers(0, 1 << 40, int(rng.integers(1, 60))).astype(np.uint64))
        other = np.union1d(base[rng.random(len(base)) < rng.uniform(0.8, 1)], rng.integers(0, 1 << 40, int(rng.integers(0, 8))).astype(np.uint64))
        common = len(np.intersect1d(base, other))
        if common * 100 < jaccard.PERCENT * (len(base) + len(other) - common):
            continue
        linked += 1
        values, bounds = jaccard.halves(np.concatenate((base, other)), np.array([0, len(base), len(base) + len(other)]))
        both = len(np.intersect1d(values[: bounds[1]], values[bounds[1] :]))
        assert all(both * 4 >= n for n in (len(base), len(other))) and bounds[1] == (len(base) + 1) // 2
    assert linked > 100
    texts = [" ".join(f"w{i}x{j}" for j in range(104)) for i in range(20)]
    blocks = jaccard._text_blocks(spark.createDataFrame([(t,) for t in texts], "text string"), "text").where("kind <> 1").collect()
    assert sum(len(b.keys) // 4 for b in blocks) == 20 * 50


def test_survivors_in_several_passes_and_small_regions(spark, monkeypatch):
    """More survivors than one broadcast may hold give the same components, without an exchange of texts."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    rows = [(10 * g + j, " ".join([*w, *(["z"] * j)])) for g, w in enumerate(words) for j in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}


def test_sets_stay_and_cells_are_cut(spark, monkeypatch):
    """Few sets are written where their texts lie, without an exchange; a text and one of twice its size share no region."""
    seen = {}

    def watched(df, tag, f=jaccard.materialise):
        seen.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        out = f(df, tag)
        if tag == "jaccard-regions":
            seen["pairs"] = {frozenset(r) for r in out.collect()}
        return out

    monkeypatch.setattr(jaccard, "materialise", watched)
    long, short = [f"a{i}" for i in range(200)], [f"a{i}" for i in range(80)]
    rows = [(1, " ".join(long)), (2, " ".join([*long, "z"])), (3, " ".join(short)), (4, " ".join([*short, "z"])), (4, " ".join([*short, "z"]))]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    assert len(seen["pairs"]) == 2  # long with long, short with short
    # The pass itself, what is left of it without the row that came twice, and the survivors of the second count.
    first, _, last = seen["jaccard-sets"]
    assert "Exchange hashpartitioning" not in first + last


def test_linked_sizes_are_at_most_a_class_apart():
    n = np.arange(1, 20_000)
    assert (np.abs(jaccard.size_class(n) - jaccard.size_class(n * 4 // 3)) <= 1).all()

"""Line dedup against brute force, and its minimal perfect hash."""

import random
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import lines, perfect

KIND = "doc_id long, text string, kept string, extra string"
SPACES = " \t\n\x0b\x0c\r"


def brute(rows, chars=20, documents=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACES))
    low = lambda d: -(2**63) if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(low(d))
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if len(holders[key(x)]) < documents or max(holders[key(x)]) == low(d)]
        out.append((low(d), len(all_), len(all_) - len(left), "\n".join(left)))
    return sorted(out)


def found(frame, **more):
    got = lines.dedup(frame, **more)
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect())


@pytest.mark.parametrize(("run_bytes", "parts"), [(lines.RUN_BYTES, 3), (400, 5)])
def test_against_brute_force(spark, monkeypatch, run_bytes, parts):
    monkeypatch.setattr(lines, "RUN_BYTES", run_bytes)
    rng = random.Random(5)
    pool = [f"{'common line number ' * (i % 3)}{i} of the pool é{'日' * (i % 30)}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"a line of its own, document {i}, number {j}" for j in range(rng.randrange(3))]
        shared = [rng.choice([str.upper, str, lambda s: f" \t{s}\x0b\r"])(x) for x in rng.choices(pool, k=rng.randrange(8))]
        body = own + shared + rng.choices(["", "short", "x" * 19, "y" * 20, " " + "z" * 20], k=3)
        rng.shuffle(body)
        rows.append((i - 20, "\n".join(body)))
    rows += [(None, "\n".join(pool[:9])), (None, pool[3]), (500, ""), (501, None), (502, "\n"), (503, "\n\n" + pool[1] + "\n"), (7, rows[9][1]), (7, "w" * 40), (8, "w" * 40), (9, "w" * 40)]
    rows += [rows[3]] * 3  # the same row again
    frame = spark.createDataFrame([(d, t, "old", "x") for d, t in rows], KIND).repartition(parts)
    assert lines.dedup(frame).columns == ["doc_id", "text", "extra", "n_lines", "n_dropped", "kept"]
    assert found(frame) == brute(rows)
    assert found(frame, chars=5, documents=1, carry=["doc_id"]) == brute(rows, 5, 1)
    assert found(frame, chars=20, documents=7, carry=["doc_id"]) == brute(rows, 20, 7)


def test_code_points_not_bytes(spark):
    rows = [(i, "é" * 19 + "\n" + "日" * 20) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame) == brute(rows) and [r[2] for r in found(frame)] == [1, 1, 1, 0]


def test_empty_and_one_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(none).count() == 0
    long = "\n".join(f"line {i % 50_000} of a very long text" for i in range(120_000))
    rows = [(1, long), (2, long + "\nand one more line at its end"), (3, long)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 30_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    keys[: n // 2, 0] = 7  # halves of keys may agree
    h = perfect.PerfectHash.from_bytes(perfect.PerfectHash.build(keys[:, 0], keys[:, 1]).to_bytes())
    assert len(h) == n and sorted(h.lookup(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
    other = rng.integers(0, 2**64, (100, 2), dtype=np.uint64)
    at = h.lookup(other[:, 0], other[:, 1])
    assert ((at >= -1) & (at < max(n, 1))).all()
    if n == 30_000:
        assert sum(x.nbytes for x in h.levels) * 8 < 5 * n


def test_perfect_hash_without_room(monkeypatch):
    monkeypatch.setattr(perfect, "LEVELS", 1)
    keys = np.arange(400, dtype=np.uint64).reshape(-1, 2)
    h = perfect.PerfectHash.from_bytes(perfect.PerfectHash.build(keys[:, 0], keys[:, 1]).to_bytes())
    assert len(h.rest) and sorted(h.lookup(keys[:, 0], keys[:, 1]).tolist()) == list(range(200))

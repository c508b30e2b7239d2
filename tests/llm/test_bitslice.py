"""Exact top-k beyond 64 bits, and as a grid of blocks."""

import math
import random
from fractions import Fraction

import pytest

from gleaner.llm import bitslice


def brute(rows, asked, k, scale=1024):
    q = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for i in {i for i, _ in q if asked(i)}:
        scores = {}
        for a in (v for j, v in q if j == i):
            for j, b in q:
                if j != i and len(a) == len(b):
                    s = sum(x * y for x, y in zip(a, b, strict=True))
                    scores[j] = max(s, scores.get(j, s))
        best = sorted(scores, key=lambda j: (-scores[j], j))[:k]
        out |= {(i, r + 1): (j, scores[j] if -(2**63) <= scores[j] < 2**63 else None) for r, j in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(32_768, 2_048, 4_096), (20, 7, 3)])
def test_any_size_of_component(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "SMALL_ROWS", "QUERY_ROWS"), blocks, strict=True):
        monkeypatch.setattr(bitslice, name, value)
    rng = random.Random(4)
    size = [1e-3, 1.0, 1e6, 1e16, 1e30, 1e300]
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice(size if i % 5 == 0 else size[:2]) for _ in range(3 if i % 11 else 2)]) for i in range(120)]
    rows += [(1000, [1e16, 1.0, 0.0]), (1001, [1e30, 1.0, 0.0]), (1002, [1e308, -1e308, 0.0]), (None, [1.0, 1.0, 1.0]), (1003, None), (1004, []), (1005, [None, 1.0, 1.0]), (1006, [math.inf, 1.0, 1.0]), (20, [5.0, 5.0, 5.0]), (20, [5.0, 5.0, 5.0]), (7, [1e20, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bitslice.top_k(frame, lambda v: v % 10 == 0, k=4).collect()}
    assert got == brute(rows, lambda i: i % 10 == 0, 4)
    assert got[1000, 1][0] in (1001, 1002) and got[1000, 1][1] is None


def test_sortable():
    numbers = [0, 1, 9, 10, 123, 10**40, 10**41 - 1]
    assert [bitslice.sortable(v) for v in numbers] == sorted(bitslice.sortable(v) for v in numbers)
    down = [-v for v in reversed(numbers) if v]
    assert [bitslice.sortable(v) for v in down] == sorted(bitslice.sortable(v) for v in down)

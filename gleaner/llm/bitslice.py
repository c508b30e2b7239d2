"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

#: Low bits of a component that the index leaves out; boundary rows are resolved with all bits.
DROPPED_BITS = 5
#: Rows of a block of the index (about, and at least where there is work for all), and queries of a block.
BLOCK_ROWS, SMALL_ROWS, QUERY_ROWS = 32_768, 2_048, 4_096


class Block:
    """Bit slices of the attributes (components) of a block of rows, packed 64 rows to a word."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.words = -(-n // 64)
        self.low = values.min(axis=0) >> DROPPED_BITS
        coarse = (values >> DROPPED_BITS) - self.low
        self.bits = max(1, int(coarse.max()).bit_length())
        padded = np.zeros((self.words * 64, dims), np.int64)
        padded[:n] = coarse
        self.alive = self.pack(np.arange(self.words * 64) < n)
        #: slices[d, j]: bit j of component d of all rows.
        self.slices = np.stack([[self.pack((padded[:, d] >> j) & 1 == 1) for j in range(self.bits)] for d in range(dims)])
        self.flipped = ~self.slices

    def pack(self, rows: np.ndarray) -> np.ndarray:
        return np.packbits(rows, bitorder="little").view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * c), c flipped where q is negative: carry-save additions of weighted slices."""
        piles: dict[int, list[np.ndarray]] = {}
        for positive in (True, False):
            dims = np.flatnonzero(query > 0 if positive else query < 0)
            source, weight = (self.slices if positive else self.flipped), np.abs(query[dims])
            for b in range(int(weight.max(initial=0)).bit_length()):
                chosen = dims[(weight >> b) & 1 == 1]
                for j in range(self.bits) if len(chosen) else ():
                    piles.setdefault(b + j, []).append(source[chosen, j])
        out, b = [], 0
        while piles:
            pile = piles.pop(b, None)
            if pile is None:
                out.append(np.zeros(self.words, np.uint64))
                b += 1
                continue
            x = np.concatenate(pile)
            carries = []
            while len(x) > 1:
                k = len(x) // 3
                if k:
                    p, q, r, rest = x[:k], x[k : 2 * k], x[2 * k : 3 * k], x[3 * k :]
                    half = p ^ q
                    carries.append((p & q) | (half & r))
                    x = np.concatenate((half ^ r, rest))
                else:  # two are left
                    carries.append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
            out.append(x[0])
            if carries:
                piles.setdefault(b + 1, []).extend(carries)
            b += 1
        return out

    def at_least(self, score: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is bound or more, from the most significant slice downward."""
        if bound <= 0:
            return self.alive
        if bound >> len(score):
            return np.zeros(self.words, np.uint64)
        above, tied = np.zeros(self.words, np.uint64), self.alive.copy()
        for i in range(len(score) - 1, -1, -1):
            if (bound >> i) & 1:
                tied &= score[i]
            else:
                above |= tied & score[i]
                tied &= ~score[i]
        return above | tied

    def kth(self, score: list[np.ndarray], k: int) -> int:
        """The k-th highest sum, from the most significant slice downward."""
        value, sure, tied = 0, 0, self.alive.copy()
        for i in range(len(score) - 1, -1, -1):
            ones = tied & score[i]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                tied, value = ones, value | 1 << i
            else:
                sure, tied = sure + n, tied & ~score[i]
        return value

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_id and score of the k best distinct ids but the query's own."""
        own = int(np.count_nonzero(self.ids == query_id))
        n = len(self.ids)
        if n > k + own + self.repeats:
            sums = self.add(query)
            # What the dropped bits can add to a sum: from 0 up to this, for each row alike.
            room = int(np.abs(query).sum()) * ((1 << DROPPED_BITS) - 1)
            bound = (self.kth(sums, k + own + self.repeats) << DROPPED_BITS) - room if sums else 0
            near = self.rows(self.at_least(sums, -(-bound >> DROPPED_BITS) if bound > 0 else 0)) if sums else np.arange(n)
        else:
            near = np.arange(n)
        ids, scores = self.ids[near], self.values[near] @ query
        other = ids != query_id
        ids, scores = ids[other], scores[other]
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        if self.repeats:
            _, first = np.unique(ids, return_index=True)
            first.sort()
            ids, scores = ids[first], scores[first]
        return ids[:k], scores[:k]

    @property
    def repeats(self) -> int:
        """Rows that repeat an id of the block."""
        if not hasattr(self, "_repeats"):
            self._repeats = len(self.ids) - len(np.unique(self.ids))
        return self._repeats


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id and x: vectors as doubles. Drops those that are null, empty or hold null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(good & F.col("vec_id").isNotNull()).select("vec_id", x.alias("x"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), of any size."""
    product = x * scale
    return math.floor(product) if math.isfinite(product) else math.floor(Fraction(x) * scale)


class Vectors:
    """The vectors of one length of a table: those whose products fit 64 bits as longs, the others as Python integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int):
        # Below this in both factors, no sum of products reaches 2^62.
        most = math.isqrt((1 << 62) // x.shape[1])
        with np.errstate(over="ignore"):
            q = np.floor(x * scale)
        small = (np.abs(q) < most).all(axis=1)
        self.ids, self.values = ids[small], q[small].astype(np.int64)
        self.wide_ids = ids[~small]
        self.wide = np.array([[whole(v, scale) for v in row] for row in x[~small].tolist()], object).reshape(-1, x.shape[1])

    @staticmethod
    def of(table: pa.Table, scale: int) -> dict[int, Vectors]:
        """By length, from columns cell, vec_id, x."""
        ids, lists = table.column("vec_id").to_numpy(), table.column("x").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        sizes, first = np.diff(at), at[:-1] - at[0]
        return {d: Vectors(ids[mine], flat[first[mine][:, None] + np.arange(d)], scale) for d in np.unique(sizes).tolist() if len(mine := np.flatnonzero(sizes == d))}


_FOUND = "query_id long, vec_id long, beyond int, score long, digits string"


def _search(scale: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The k best rows of a block for each query of a block; sums beyond 64 bits as sign and sortable digits."""
        asked, given, out = Vectors.of(queries, scale), Vectors.of(rows, scale), []
        for d in asked.keys() & given.keys():
            a, b = asked[d], given[d]
            block = Block(b.ids, b.values) if len(b.ids) and len(a.ids) else None
            for query_id, q, fits in [*((i, q, True) for i, q in zip(a.ids.tolist(), a.values, strict=True)), *((i, q, False) for i, q in zip(a.wide_ids.tolist(), a.wide, strict=True))]:
                best: dict[int, int] = {}
                if fits and block:
                    best = dict(zip(*(x.tolist() for x in block.top(query_id, q, k)), strict=True))
                elif not fits and len(b.ids):
                    _exact(best, b.ids, b.values.astype(object) @ q)
                if len(b.wide_ids):
                    _exact(best, b.wide_ids, b.wide @ q.astype(object))
                best.pop(query_id, None)
                for vec_id in sorted(best, key=lambda i: (-best[i], i))[:k]:
                    v = best[vec_id]
                    beyond = (v >= 1 << 63) - (v < -(1 << 63))
                    out.append((query_id, vec_id, beyond, None if beyond else v, sortable(v) if beyond else None))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["query_id", "vec_id", "beyond", "score", "digits"])

    return run


def _exact(best: dict[int, int], ids: np.ndarray, scores: np.ndarray) -> None:
    for i, v in zip(ids.tolist(), scores.tolist(), strict=True):
        best[i] = max(v, best.get(i, v))


def sortable(v: int) -> str:
    """Digits that sort as text like the numbers they stand for, among numbers of one sign."""
    d = str(abs(v))
    return f"{len(d):06d}{d}" if v >= 0 else f"{999_999 - len(d):06d}{d.translate(str.maketrans('0123456789', '9876543210'))}"


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score.

    vectors: vec_id and an array of numbers; is_query marks the query rows. Components count as floor(scale * x); ranks are
    exact for components of any size. Sums that 64 bits cannot hold are ranked as well and have a null score. Candidates
    are all rows but those of the query's own vec_id; ties go to the smaller vec_id; fewer than k candidates give fewer
    rows. Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id.
    Rows that repeat a vec_id count once, with their highest score; a repeated query likewise. Vectors of different
    lengths never meet: a query sees those of its own length. Other columns are not looked at.

    A stated query set against all rows, in a grid: blocks of queries meet blocks of rows, each pair in a task of its own
    that indexes its rows and keeps k of them a query; one shuffle merges. Nothing of either side reaches the driver.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector)
    queries = rows.where(is_query(F.col("vec_id")))
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    # Small tables are cut finer, so that every executor has a block.
    down = max(1, -(-n_rows // BLOCK_ROWS), min(shuffle_parts(spark), -(-n_rows // SMALL_ROWS)))
    across = max(1, -(-n_queries // QUERY_ROWS))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    cell = lambda q, r: (q * down + r).alias("cell")
    sent = rows.withColumn("r", block(down)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(cell(F.col("q"), F.col("r")), "vec_id", "x")
    asked = queries.withColumn("q", block(across)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(cell(F.col("q"), F.col("r")), "vec_id", "x")
    found = asked.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(_search(scale, k), _FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("beyond", "score", "digits")).alias("s"))
    order = [F.desc("s.beyond"), F.desc("s.score"), F.desc("s.digits"), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s.score").alias("score"))


def brute_force(ids: np.ndarray, values: np.ndarray, queries: list[int], k: int) -> pd.DataFrame:
    """For tests: the same by sorting all scores."""
    rows = []
    for i in queries:
        scores = values @ values[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        rows += [(ids[i], r + 1, ids[j], scores[j]) for r, j in enumerate(order)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

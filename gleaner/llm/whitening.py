"""Embedding whitening by an exact integer scatter.

Entries become integers, so sums and cross-products of any number of rows are exact and do not depend on how rows are
dealt to tasks. A task multiplies blocks of rows as floats, cut into limbs so small that every product sum stays an
exact integer, and adds the blocks up as Python integers. What tasks have found travels as limbs of LIMB bits that Spark
sums as longs. Only n * XtX - SSt, formed exactly, becomes floating point: correctly rounded, and decomposed by eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

#: Rows of a block, bits of a factor that a block of them multiplies exactly, and bits of a limb that tasks send.
BLOCK_ROWS, FACTOR, LIMB = 4096, 20, 31
#: Entries are held within plus and minus this before the offset.
MOST = 1 << 62


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: their number, sums less shift, and per component the direction over its deviation."""

    n: int
    sums: tuple[int, ...]
    project: np.ndarray
    explained: np.ndarray


def good(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector of rows whose vector has entries, all of them finite."""
    x = F.col(vector).cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(whole).select(F.col(key), x.alias("vector"))


def integers(batch: pa.RecordBatch, scale: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * entry) - less of them) for each length of vector in the second column, in blocks."""
    lists = batch.column(1)
    at = lists.offsets.to_numpy()
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    flat = np.clip(flat, -MOST, MOST).astype(np.int64) - less
    sizes, first = np.diff(at), at[:-1] - at[0]
    for d in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == d)
        for rows in np.split(mine, range(BLOCK_ROWS, len(mine), BLOCK_ROWS)):
            yield rows, flat[first[rows][:, None] + np.arange(d)]


def cross_products(y: np.ndarray) -> np.ndarray:
    """y'y of at most BLOCK_ROWS rows of longs, exactly, as an array of Python integers."""
    limbs, rest = [], y
    while len(limbs) == 0 or rest.any():
        top = bool((np.abs(rest) < 1 << FACTOR).all())
        limbs.append((rest if top else rest & ((1 << FACTOR) - 1)).astype(np.float64))
        if top:
            break
        rest = rest >> FACTOR
    out = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << FACTOR * (i + j)  # below 2^53 each
    return out


def limbs(v: int) -> list[int]:
    """v in base 2^LIMB; the last limb carries the sign."""
    out = []
    while not -(1 << LIMB) <= v < 1 << LIMB:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def scatter(rows: DataFrame, scale: int, less: int) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length of vector: number, sums and cross-products. What the driver gets is bounded by the lengths alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for mine, y in integers(batch, scale, less):
                d = y.shape[1]
                n, s, m = found.get(d) or (0, np.zeros(d, object), np.zeros((d, d), object))
                found[d] = [n + len(mine), s + y.astype(object).sum(axis=0), m + cross_products(y)]
        for d, (n, s, m) in found.items():
            entries = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(s)), *((i, j, int(m[i, j])) for i in range(d) for j in range(i, d))]
            out = [(d, i, j, k, x) for i, j, v in entries for k, x in enumerate(limbs(v))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["d", "i", "j", "k", "x"])

    sums = rows.mapInArrow(run, "d long, i long, j long, k long, x long").groupBy("d", "i", "j", "k").agg(F.sum("x").alias("x"))
    out: dict[int, tuple[int, list[int], list[list[int]]]] = {}
    for d, i, j, k, x in sums.collect():
        n, s, m = out.setdefault(d, (0, [0] * d, [[0] * d for _ in range(d)]))
        v = int(x) << LIMB * k
        if i < 0:
            out[d] = (n + v, s, m)
        elif j < 0:
            s[i] += v
        else:
            m[i][j] += v
    return out


def decompose(n: int, s: list[int], m: list[list[int]], components: int) -> Fit:
    """The leading components of the covariance (n * m - s s') / n^2, which is formed in integers."""
    d = len(s)
    exact = [[n * m[min(i, j)][max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    v = np.array([[x / (n * n) for x in row] for row in exact])  # integers divide with correct rounding
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    trace = sum(exact[i][i] for i in range(d)) / (n * n)
    # Beyond the rank of the covariance, eigenvalues are rounding: such a component has no scale to divide by.
    keep = np.flatnonzero(e > d * np.finfo(float).eps * max(e[0], 0.0))[:components]
    return Fit(n, tuple(s), w[:, keep] / np.sqrt(e[keep]), e[keep] / trace if len(keep) else e[keep])


def centred(fit: Fit, y: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(y - mean as floats, sum of (n * y - sums)^2 of each row), the second in longs where they fit."""
    bound = fit.n * int(np.abs(y).max(initial=0)) + max(map(abs, fit.sums))
    if bound < MOST:
        c = fit.n * y - np.array(fit.sums, np.int64)
        if int(np.abs(c).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
            return c / fit.n, (c * c).sum(axis=1)
        c = c.astype(object)
    else:
        c = fit.n * y.astype(object) - np.array(fit.sums, object)
    return (c / fit.n).astype(np.float64), (c * c).sum(axis=1).tolist()


def identity_errors(rows: DataFrame, fits: dict[int, Fit], scale: int, less: int) -> dict[int, float]:
    """By length: the largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    # Fixed point, so that the order of additions does not show. No sum of products exceeds n by more than rounding.
    unit = {d: 1 << (60 - f.n.bit_length()) for d, f in fits.items() if f.n.bit_length() < 60}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, y in integers(batch, scale, less):
                d = y.shape[1]
                w = centred(fits[d], y)[0] @ fits[d].project
                s, m = found.get(d, (0.0, 0.0))
                found[d] = [s + w.sum(axis=0), m + w.T @ w]
        for d, (s, m) in found.items():
            k = len(s)
            i, j = np.triu_indices(k)
            values = np.rint(np.concatenate((s, m[i, j])) * unit[d]).astype(np.int64)
            where = [pa.array(x, pa.int64()) for x in (np.full(len(values), d), np.concatenate((np.arange(k), i)), np.concatenate((np.full(k, -1), j)), values)]
            yield pa.RecordBatch.from_arrays(where, ["d", "i", "j", "x"])

    sums = rows.mapInArrow(run, "d long, i long, j long, x long").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect()
    means = {(r.d, r.i): r.x / unit[r.d] / fits[r.d].n for r in sums if r.j < 0}
    errors = {d: 0.0 for d in fits}
    for r in sums:
        if r.j >= 0:
            covariance = r.x / unit[r.d] / fits[r.d].n - means[r.d, r.i] * means[r.d, r.j]
            errors[r.d] = max(errors[r.d], abs(covariance - (r.i == r.j)))
    return errors


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, shift: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The leading whitened components of every vector: key, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c counts as x = floor(scale * c) + offset. All vectors make up the fit list: n of them with sums S.
    deviation is the sum over dimensions of (n * x - S)^2, exact to 38 digits (null beyond); whitened is x - S / n along
    a unit eigenvector of the covariance (divisor n), over the root of its eigenvalue; explained is the eigenvalue's
    share of the trace; identity_error is measured on all whitened rows and the same in each row.

    shift is taken off before products are summed; no result depends on it. Eigenvectors have the sign that eigh gives
    them. Components without variance (identical vectors, one vector, constant dimensions) are left out, as there is no
    scale to divide by. Vectors that are null, empty or hold null or non-finite entries take no part. floor(scale * c) is
    held within plus and minus 2^62. Vectors of different lengths have fits of their own. Repeated rows and rows without
    key count like any others; other columns are not looked at. An empty table gives an empty result.
    """
    rows = good(vectors, key, vector)
    less = shift - offset
    fits = {d: decompose(*found, components) for d, found in scatter(rows, scale, less).items()}
    errors = identity_errors(rows, fits, scale, less)
    schema = StructType(
        [vectors.schema[key], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0))]
        + [StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = pa.decimal128(38, 0)
        for batch in batches:
            for mine, y in integers(batch, scale, less):
                fit = fits[y.shape[1]]
                k = len(fit.explained)
                x, deviation = centred(fit, y)
                exact = pa.array(deviation, pa.int64()).cast(wide) if isinstance(deviation, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in deviation], wide)
                each = pa.array(np.repeat(np.arange(len(mine)), k))
                columns = [
                    batch.column(0).take(pa.array(mine)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), len(mine)), pa.int32()),
                    pa.array(np.full(len(each), fit.n), pa.int64()),
                    exact.take(each),
                    pa.array((x @ fit.project).ravel()),
                    pa.array(np.tile(fit.explained, len(mine))),
                    pa.array(np.full(len(each), errors[y.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)

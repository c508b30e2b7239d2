"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import slices, text_buffers, word_hashes

#: Buckets of hashed words, and rank of the pairwise interactions.
BUCKETS, RANK = 4096, 8
#: Bound of the training sample: rows of the smallest key hashes.
SAMPLE_ROWS = 5_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-4

#: Byte classes whose shares are structure statistics, fixed values.
CLASSES = (b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"!", b"?", b".", b",", b":;", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b" ", b"\n", b"\t\r\x0b\x0c", b"()[]{}", b"\"'`", b"/\\@_-+=~^", bytes(range(128, 256)))
N_STATS = len(CLASSES) + 9


def _class_of() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for i, c in enumerate(CLASSES):
        out[list(c)] = i
    return out


_CLASS = _class_of()


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: bounds into (bucket, value) pairs of its hashed words, and its statistics [n, N_STATS].

    Word values are log counts, scaled to length 1 a text. Statistics: shares of byte classes, number and length of
    words, lines, repetition, and the n_chars of the row as metadata.
    """
    raw, offsets = text_buffers(texts)
    n = len(offsets) - 1
    stats = np.zeros((n, N_STATS), np.float32)
    all_buckets, all_values, ends = [], [], np.zeros(n + 1, np.int64)
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = raw[offsets[first] : offsets[last]]
        m = last - first
        doc = np.repeat(np.arange(m), np.diff(at))
        counts = np.bincount(doc * (len(CLASSES) + 1) + _CLASS[part], minlength=m * (len(CLASSES) + 1)).reshape(m, -1)
        size = np.maximum(1, np.diff(at))[:, None]
        hashes, starts = word_hashes(part, at)
        n_words = np.diff(starts)
        of = np.repeat(np.arange(m), n_words)
        pairs, times = np.unique(of * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        owner, bucket = pairs // BUCKETS, pairs % BUCKETS
        value = np.log1p(times).astype(np.float32)
        value /= np.sqrt(np.bincount(owner, value * value, m))[owner].astype(np.float32)
        distinct = np.bincount(owner, minlength=m)
        most = np.zeros(m)
        np.maximum.at(most, owner, times)
        words = np.maximum(1, n_words)
        twice = np.bincount(of[1:], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]), m) if len(of) > 1 else np.zeros(m)
        lines = counts[:, CLASSES.index(b"\n")] + 1
        block = stats[first:last]
        block[:, : len(CLASSES)] = counts[:, :-1] / size
        block[:, len(CLASSES) :] = np.stack([np.log1p(n_words), np.log1p(n_chars[first:last]), size[:, 0] / words / 10, distinct / np.minimum(words, BUCKETS), most / words, twice / words, np.log1p(words / lines), counts[:, :7].sum(1) / words, counts[:, CLASSES.index(b"!")] / words], axis=1)
        all_buckets.append(bucket)
        all_values.append(value)
        ends[first + 1 : last + 1] = ends[first] + np.cumsum(distinct)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return ends, join(all_buckets, np.int64), join(all_values, np.float32), stats


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)): linear in the non-zeros of x."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -3, 3) / 3

    def score(self, ends: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(stats)
        x = self.standard(stats)
        w, v = self.weights, self.factors
        linear = x @ w[BUCKETS:]
        sums, squares = x @ v[BUCKETS:], (x * x) @ (v[BUCKETS:] ** 2).sum(1)
        owner = np.repeat(np.arange(n), np.diff(ends))
        linear += np.bincount(owner, w[buckets] * values, n)
        squares += np.bincount(owner, (v[buckets] ** 2).sum(1) * values**2, n)
        for f in range(v.shape[1]):
            sums[:, f] += np.bincount(owner, v[buckets, f] * values, n)
        z = self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, stats: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Fit by Adam on the logistic loss, both labels weighing the same up to a factor of 3.

    x: dense word values, with N_STATS columns at the end that this fills in.
    """
    n = len(y)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if n else (np.zeros(N_STATS), np.ones(N_STATS))
    rng = np.random.default_rng(seed)
    dims = BUCKETS + N_STATS
    machine = Machine(0.0, np.zeros(dims, np.float32), rng.normal(0, 0.05, (dims, RANK)).astype(np.float32), mean.astype(np.float32), scale.astype(np.float32))
    if not n or y.min() == y.max():
        machine.bias, machine.factors = (4.0 if n and y.max() == 1 else -4.0 if n else 0.0), np.zeros((dims, RANK), np.float32)
        return machine
    share = y.mean()
    weight = np.where(y == 1, min(1.0, 3 * (1 - share) / share), min(1.0, 3 * share / (1 - share))).astype(np.float32)
    x[:, BUCKETS:] = machine.standard(stats)
    params = [np.zeros(1, np.float32), machine.weights, machine.factors]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            xb = x[rows]
            x2 = xb**2
            s = xb @ params[2]
            z = params[0] + xb @ params[1] + 0.5 * ((s * s).sum(1) - x2 @ (params[2] ** 2).sum(1))
            g = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [g.sum(keepdims=True), xb.T @ g + DECAY * params[1], xb.T @ (g[:, None] * s) - (x2.T @ g)[:, None] * params[2] + DECAY * params[2]]
            t += 1
            for p, grad, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    machine.bias = float(params[0][0])
    return machine


def _batch_features(batch: pa.RecordBatch, text: int, chars: int):
    n_chars = batch.column(chars).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) if chars >= 0 else None
    if n_chars is None:
        n_chars = np.zeros(batch.num_rows)
    return features(batch.column(text), np.maximum(n_chars, 0))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", chars: str = "n_chars") -> Machine:
    """Fit on at most SAMPLE_ROWS labelled rows: those of the smallest hash of the key. Null labels are left out.

    Tasks make the features, sparse rows; one task fits on those of the sample, whose size is bounded. Rows of equal
    key are cut by their statistics. The driver gets the weights only. Labels of one kind alone give every text one score,
    near that label; no label gives 0.5. Rows without key take part; a text whose key is null is in no fold.
    """
    rows = labelled.where(F.col(label).isNotNull()).withColumn("h", F.xxhash64(F.lit("quality"), F.col(key)))
    rows = rows.select("h", F.col(label).cast("int").alias("y"), F.col(text).alias("text"), F.col(chars).cast("double").alias("c") if chars in labelled.columns else F.lit(0.0).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, buckets, values, stats = _batch_features(batch, 2, 3)
            cut = lambda x, kind: [x[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut(buckets, np.int16), pa.binary()), pa.array(cut(values, np.float32), pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["h", "y", "b", "v", "s"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)), key=lambda r: (r[0], r[4], r[1], r[2]))
        x = np.zeros((len(got), BUCKETS + N_STATS), np.float32)
        for i, (_, _, buckets, values, _) in enumerate(got):
            x[i, np.frombuffer(buckets, np.int16)] = np.frombuffer(values, np.float32)
        stats = np.array([np.frombuffer(r[4], np.float32) for r in got], np.float32).reshape(-1, N_STATS)
        found = fit(x, stats, np.array([r[1] for r in got], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([found.bias]), *(pa.array([p.astype(np.float32).tobytes()]) for p in (found.weights, found.factors, found.mean, found.scale))], ["bias", "weights", "factors", "mean", "scale"])

    sample = rows.mapInArrow(run, "h long, y int, b binary, v binary, s binary").orderBy("h", "s", "y", "b").limit(SAMPLE_ROWS)
    learnt = sample.repartition(1).mapInArrow(learn, "bias double, weights binary, factors binary, mean binary, scale binary").first()
    if learnt is None:
        return fit(np.zeros((0, BUCKETS + N_STATS), np.float32), np.zeros((0, N_STATS), np.float32), np.zeros(0, np.float32))
    array = lambda b: np.frombuffer(b, np.float32)
    return Machine(learnt.bias, array(learnt.weights), array(learnt.factors).reshape(-1, RANK), array(learnt.mean), array(learnt.scale))


def sample_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most SAMPLE_ROWS keys with their label (the smallest of a repeated key), by the smallest hash of the key."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    return one.orderBy(F.xxhash64(F.lit("quality"), F.col(key)), key).limit(SAMPLE_ROWS)


def score(docs: DataFrame, machine: Machine, text: str = "text", chars: str = "n_chars", carry: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 from 0.5 on) to every row of docs.

    Whole texts; a null text scores as an empty one, a null or missing n_chars as 0. Repeated rows stay. carry: the
    columns of docs to return, all if None; columns named score or predicted are replaced.
    """
    added = ("score", "predicted")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in added]
    sent = docs.select(*keep, F.col(text).alias("__text"), (F.col(chars).cast("double") if chars in docs.columns else F.lit(0.0)).alias("__chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = machine.score(*_batch_features(batch, len(keep), len(keep) + 1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, *added])

    return sent.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))

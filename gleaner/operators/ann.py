"""Approximate nearest neighbours: inverted lists around centroids, probed in order of distance, scored exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import VECTOR_ROWS, rank

#: Vectors that centroids are fitted on at most, and rounds of the fit.
SAMPLE_ROWS, ROUNDS = 4_096, 12


def sample(vectors: DataFrame, seed: int = 42) -> np.ndarray:
    """The SAMPLE_ROWS vectors of smallest seeded hash, as unit vectors: a bound, so that fits run on the driver.

    Of several lengths the most frequent one counts; vectors of others are in no list.
    """
    whole = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c)))
    rows = whole.select("vec_id", "embedding", F.xxhash64(F.lit(seed), "vec_id").alias("h")).orderBy("h", "vec_id").limit(SAMPLE_ROWS).collect()
    sizes = Counter(len(r.embedding) for r in rows)
    d = max(sizes, key=lambda n: (sizes[n], n), default=1)
    x = np.array([r.embedding for r in rows if len(r.embedding) == d], np.float64).reshape(-1, d)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(rows) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, 1))


def fit(vectors: DataFrame, lists: int, seed: int = 42) -> np.ndarray:
    """Centroids (unit vectors) of spherical k-means on the sample; every vector is indexed. Reruns agree."""
    x = sample(vectors, seed)
    if not len(x):
        return x
    made = np.random.default_rng(seed)
    # Each next centre is drawn among vectors by their distance to the nearest one so far.
    centres = x[made.integers(len(x))][None]
    while len(centres) < min(lists, len(x)):
        far = np.maximum(0, 1 - (x @ centres.T).max(axis=1))
        if far.sum() <= 1e-12:
            break
        centres = np.vstack((centres, x[made.choice(len(x), p=far / far.sum())]))
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def probes_for(vectors: DataFrame, centroids: np.ndarray, limit: int, recall: float, queries: int = 256, seed: int = 42) -> int:
    """The fewest lists to probe for a mean recall of `recall` at `limit`, measured on the sample: its first vectors ask.

    Neighbours in a sample are further away than in the whole table, so the measure errs on the safe side. Clustered vectors
    need few lists; vectors that lie evenly in all directions need most of them, and cosine_top serves them better.
    """
    x = sample(vectors, seed)
    if not len(x) or not len(centroids):
        return 1
    asked = x[:queries]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = np.inf  # a query finds itself first, as in search
    top = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
    places = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list for each query
    own = (x @ centroids.T).argmax(axis=1)
    needed = np.take_along_axis(places, own[top], axis=1)  # lists to probe, less one, for each neighbour
    found = np.array([(needed < p).mean() for p in range(1, len(centroids) + 1)])
    return int(np.flatnonzero(found >= recall)[0]) + 1


def assign(vectors: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, list, embedding (unit): each vector in its `probes` nearest lists. Zero, null and other-sized vectors are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(probes, len(centroids))
        for batch in batches:
            lists = batch.column(1)
            good = np.flatnonzero(np.asarray(lists.value_lengths()) == centroids.shape[1])
            x = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(len(good), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            fine = np.isfinite(x).all(axis=1)
            good, x = good[fine], x[fine]
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :k]
            each = np.repeat(np.arange(len(good)), k)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * centroids.shape[1], pa.int32()), pa.array(x[each].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[each])), pa.array(near.ravel(), pa.int32()), flat], [key, "list", "embedding"])

    rows = vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, list int, embedding array<double>")


def search(vectors: DataFrame, queries: DataFrame, centroids: np.ndarray, limit: int, probes: int, decimals: int = 9) -> DataFrame:
    """query_id, vec_id, score, rank: like retrieval.cosine_top, over the `probes` lists nearest to each query.

    Lists are cut into parts of about VECTOR_ROWS vectors, so that a list that holds much of the table is many tasks; each
    part keeps `limit` rows of a query. What is found is scored exactly; only vectors of lists that are not probed are
    missed. For exact results take cosine_top.
    """
    index = assign(vectors, "vec_id", centroids, 1)
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_ROWS).cast("int").alias("parts"))
    held = index.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "embedding")
    asked = assign(queries, "query_id", centroids, probes).join(sizes, "list")
    asked = asked.select(F.col("list").alias("list2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"), "query_id", F.col("embedding").alias("asked"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if q.num_rows and v.num_rows:
            scores, ids = np.round(matrix(q, "asked") @ matrix(v, "embedding").T, decimals), v.column("vec_id").to_numpy()
            for j, query_id in enumerate(q.column("query_id").to_pylist()):
                at = np.lexsort((ids, -scores[j]))[:limit]
                for c, x in zip(found, (np.full(len(at), query_id), ids[at], scores[j, at]), strict=True):
                    c.append(x)
        return pa.table([np.concatenate(c) for c in found], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("list2", "part2").cogroup(held.groupBy("list", "part")).applyInArrow(run, "query_id long, vec_id long, score double")
    return rank(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact neighbours that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))

"""N-gram Jaccard join in metric space: pivots, their regions, triangle-inequality windows, exact joins of regions.

1. Every text becomes the set of its distinct shingles (64-bit hashes); equal sets are one point from here on.
2. A point can only have a neighbour if half of the smaller half of its shingle hashes occur in another point's half.
   Tasks send packed blocks of 32-bit keys, and points with fewer shared shingles leave; of the survivors, whole sets are
   counted among themselves, and 3/4 must be shared.
3. Cells: two linked points share one of the n/4 + 1 smallest hashes of each. A cell is cut where sizes leave a gap that
   no link spans. The most central point of a cut cell (the one with the largest share of shared shingles) is its
   pivot; all points that share a cut cell with a pivot form its region. Every linked pair meets in a region.
4. Regions of up to LEAF points are joined whole, exactly. In larger ones distances to the pivot are exact. Points
   within the radius of the pivot are linked to it, which joins them with one link each. What else may be linked has a point outside the radius, and distances to the pivot that differ by at
   most the radius: regions are cut into sub-regions by distance (and salted to a bounded size), and only sub-regions
   within that window are joined, exactly.
5. Links give components by iterated minima with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import STRIP_BYTES, discard, materialise, mix, release, shuffle_parts, slices, text_buffers, word_hashes

#: Words of a shingle, and the link condition 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
RADIUS = 1 - PERCENT / 100
#: Sub-regions: about so many points at most, and steps of the distance to the pivot.
LEAF, STEP = 1024, 1 / 16
#: So many survivors are broadcast as (key, point) rows to pick their texts; more take several passes, as texts are not shuffled.
#: So many (pair, point) rows at most are sent to the sets as well; with more, the sets are exchanged.
BROADCAST_ROWS = 300_000
#: Size classes of a factor of 4/3 and a rounding error; sizes of linked sets differ by 4/3 at most, so by one class.
CLASS = np.log(100 / PERCENT) * (1 + 1e-9)

_ODD = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, concatenated, and their len + 1 bounds.

    Fewer words than a shingle: the whole sequence is one shingle. No words: none. Some documents at a time.
    """
    values, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(offsets, STRIP_BYTES):
        v, at = _shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        values.append(v)
        bounds.append(at[1:] + bounds[-1][-1])
    return np.concatenate(values), np.concatenate(bounds)


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = word_hashes(raw, offsets)
    n_docs, n = len(offsets) - 1, np.diff(starts)
    many = np.maximum(0, n - WORDS + 1)
    doc = np.repeat(np.arange(n_docs), many)
    first = np.repeat(starts[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    with np.errstate(over="ignore"):
        values = np.zeros(len(first), np.uint64)
        for j in range(WORDS):
            values += hashes[first + j] * _ODD[j]
        few = np.flatnonzero((n > 0) & (n < WORDS))
        short = np.zeros(len(few), np.uint64)
        for j in range(WORDS - 1):
            has = n[few] > j
            short[has] += hashes[starts[few[has]] + j] * _ODD[j]
        short += n[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    values, doc = mix(np.concatenate((values, short))), np.concatenate((doc, few))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(n_docs + 1))


def points(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as long: equal sets have equal names. Empty sets get 0."""
    size = np.diff(bounds)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)))
        name = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)) | np.uint64(1)
    return np.where(size > 0, name, np.uint64(0)).view(np.int64)


def _sets_of(batch: pa.RecordBatch, column: int):
    """(row range, values, bounds, names) for runs of documents of a batch."""
    raw, offsets = text_buffers(batch.column(column))
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        values, bounds = shingle_sets(raw[offsets[first] : offsets[last]], at)
        yield first, last, values, bounds, points(values, bounds)


def measure(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry..., n_shingles, point (null where the set is empty) of every row."""
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, _, bounds, name in _sets_of(batch, k + 1):
                sizes.append(np.diff(bounds))
                names.append(name)
            size, name = np.concatenate(sizes), np.concatenate(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(size), pa.array(name, mask=size == 0)], ["key", *carry, "n_shingles", "point"])

    sent = docs.select(F.col(key).cast("long").alias("key"), *carry, F.col(text).alias("text"))
    return sent.mapInArrow(run, StructType([*sent.schema.fields[: k + 1], StructField("n_shingles", LongType()), StructField("point", LongType())]))


_BLOCK = "part int, kind int, keys binary, names binary, sizes binary, counts binary"


def _pack(values: np.ndarray, bounds: np.ndarray, names: np.ndarray, parts: int) -> Iterator[tuple]:
    """Blocks of a run of sets, for each part of the keys; shingles that the run itself shares are counted here.

    Of a shingle that two or more sets of the run hold, two witnesses are sent, marked as counted, so that a shingle
    of any number of documents costs each run two keys.
    """
    _, one = np.unique(names, return_index=True)
    one = one[names[one] != 0]
    size = np.diff(bounds)
    keep = np.zeros(len(names), bool)
    keep[one] = True
    owner = np.repeat(np.arange(len(names)), size)
    values, owner = values[keep[owner]], owner[keep[owner]]
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(v)))
    shared = times[run] > 1
    local = np.bincount(o[shared], minlength=len(names))
    yield 0, 1, b"", names[one].tobytes(), size[one].astype(np.uint32).tobytes(), local[one].astype(np.uint32).tobytes()
    send = ~shared | (np.arange(len(v)) - start[run] < 2)
    v, o, shared = v[send], o[send], shared[send]
    part = (v % np.uint64(parts)).astype(np.int64)
    # By part, whether counted, and owner; the key is what the part leaves of the hash.
    group = (part * 2 + shared) * len(names) + o
    order = np.argsort(group, kind="stable")
    group, key = group[order], ((v[order] // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(group))).astype(np.uint32)
    who, cut = names[group[at] % len(names)], group[at] // len(names)
    edges = np.flatnonzero(np.append(True, cut[1:] != cut[:-1])) if len(cut) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(cut))[: len(edges)]
    places = np.append(at, len(group))
    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        yield int(cut[a] // 2), 0 if cut[a] % 2 == 0 else 2, key[places[a] : places[b]].tobytes(), who[a:b].tobytes(), b"", n[a:b].tobytes()


def halves(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller half of each set's hashes (rounded up). The halves of a linked pair share a quarter of either set at least.

    Of the c common hashes of sets of n and m at most n - c lie behind the end of n's half, and m - c behind m's; c is at
    least 3/4 of the larger one.
    """
    half = (np.diff(bounds) + 1) // 2
    ends = np.cumsum(half)
    return values[np.repeat(bounds[:-1] - ends + half, half) + np.arange(int(half.sum()))], np.append(0, ends)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "kind", "keys", "names", "sizes", "counts"])


#: What is known of a point: its shingles, those shared within its run, and those found shared across runs.
_COUNT = np.dtype([("point", "<i8"), ("n", "<u4"), ("local", "<u4"), ("found", "<u4")])
_NONE = np.uint32(0xFFFFFFFF)


def _merged(counts: list[np.ndarray]) -> np.ndarray:
    """One row a point: largest n, smallest local, all found."""
    x = np.concatenate(counts) if counts else np.zeros(0, _COUNT)
    if not len(x):
        return x
    x = x[np.argsort(x["point"], kind="stable")]
    first = np.flatnonzero(np.append(True, x["point"][1:] != x["point"][:-1]))
    out = np.zeros(len(first), _COUNT)
    out["point"], out["n"], out["local"] = x["point"][first], np.maximum.reduceat(x["n"], first), np.minimum.reduceat(x["local"], first)
    out["found"] = np.add.reduceat(x["found"].astype(np.int64), first)
    return out


def _shared_in(blocks: list[tuple]) -> np.ndarray:
    """Points of one part with the number of their keys that another point has, if no run has counted them."""
    key = np.concatenate([np.frombuffer(b[1], np.uint32) for b in blocks])
    name = np.concatenate([np.repeat(np.frombuffer(b[2], np.int64), np.frombuffer(b[3], np.uint32)) for b in blocks])
    counted = np.concatenate([np.full(len(b[1]) // 4, b[0] == 2) for b in blocks])
    order = np.lexsort((counted, name, key))  # an uncounted row comes first among its equals
    key, name, counted = key[order], name[order], counted[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, counted = key[first], name[first], counted[first]
    twin = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    who, n = np.unique(name[twin & ~counted], return_counts=True)
    out = np.zeros(len(who), _COUNT)
    out["point"], out["local"], out["found"] = who, _NONE, n
    return out


def _count_shared(buckets: int):
    """From blocks sorted by part, one packed block of counts for each bucket of points and task. One part is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        current, held = -1, []
        for batch in batches:
            for part, kind, keys, names, sizes, local in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if part != current and held:
                    counts.append(_shared_in(held))
                    held = []
                current = part
                if kind == 1:
                    one = np.zeros(len(names) // 8, _COUNT)
                    one["point"], one["n"], one["local"] = np.frombuffer(names, np.int64), np.frombuffer(sizes, np.uint32), np.frombuffer(local, np.uint32)
                    counts.append(one)
                else:
                    held.append((kind, keys, names, local))
        if held:
            counts.append(_shared_in(held))
        merged = _merged(counts)
        to = merged["point"] % buckets
        order = np.argsort(to, kind="stable")
        to, merged = to[order], merged[order]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(to))[: len(first)]
        yield pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array([merged[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "counts"])

    return run


def _pick_survivors(halved: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _merged([np.frombuffer(c, _COUNT) for batch in batches for c in batch.column(1).to_pylist()])
        shared = np.where(x["local"] == _NONE, 0, x["local"]).astype(np.int64) + x["found"]
        n = x["n"].astype(np.int64)
        keep = shared * 4 >= 2 * n - 1 if halved else shared * 100 >= n * PERCENT  # a half of n or n - 1/2 of a whole
        x, shared = x[keep], shared[keep]
        yield pa.RecordBatch.from_arrays([pa.array(x["point"]), pa.array(x["n"].astype(np.int64)), pa.array(np.minimum(shared, x["n"]) / np.maximum(x["n"], 1))], ["point", "n", "central"])

    return run


def _survivors(blocks: DataFrame, halved: bool = False) -> DataFrame:
    """Points of which 3/4 of the shingles (halved: a quarter, within the halves) occur in another point: point, n, central.

    The count never falls short: of the runs that hold a point each gives local + found at least.
    """
    parts = shuffle_parts(blocks.sparkSession)
    buckets = max(1, parts // 8)  # of points: a block of counts is some hundred rows at any size
    found = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count_shared(buckets), "bucket int, counts binary")
    return found.repartition(buckets, "bucket").mapInArrow(_pick_survivors(halved), "point long, n long, central double")


def _text_blocks(docs: DataFrame, text: str) -> DataFrame:
    parts = shuffle_parts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, bounds, names in _sets_of(batch, 0):
                yield _emit(list(_pack(*halves(values, bounds), names, parts)))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _BLOCK)


def _set_blocks(sets: DataFrame) -> DataFrame:
    parts = shuffle_parts(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets_ = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a in range(0, len(sets_), 4096):
                each = [np.frombuffer(s, np.uint64) for s in sets_[a : a + 4096]]
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in each])))
                yield _emit(list(_pack(np.concatenate(each), bounds, names[a : a + 4096], parts)))

    return sets.select("point", "members").mapInArrow(run, _BLOCK)


def _members(docs: DataFrame, text: str) -> DataFrame:
    """point (as named by the row), and the sorted shingles of its text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, values, bounds, names in _sets_of(batch, 1):
                good = [i for i in range(len(names)) if names[i] == wanted[first + i]]
                yield pa.RecordBatch.from_arrays([pa.array(names[good], pa.int64()), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in good], pa.binary())], ["point", "members"])

    return docs.select("point", F.col(text).alias("text")).mapInArrow(run, "point long, members binary")


def _cells(sets: DataFrame) -> DataFrame:
    """cell, point, central, sized: a row for each of the n/4 + 1 smallest hashes of a point; sized is its size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            cut = [s[: int(len(s) * (100 - PERCENT) // 100) + 1] for s in each]
            n = [len(c) for c in cut]
            sized = size_class(np.array([len(s) for s in each], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cut) if cut else np.zeros(0, np.int64)), *(pa.array(np.repeat(c, n)) for c in (batch.column(0).to_numpy(), batch.column(2).to_numpy(), sized))], ["cell", "point", "central", "sized"])

    return sets.select("point", "members", "central").mapInArrow(run, "cell long, point long, central double, sized int")


def size_class(n: np.ndarray) -> np.ndarray:
    """Classes of sizes such that two sets can only link if their classes differ by one at most."""
    return np.floor(np.log(np.maximum(n, 1)) / CLASS).astype(np.int32)


def _regions(sets: DataFrame) -> DataFrame:
    """pivot, point: the points, but for the pivot, that share a cut cell with a pivot."""
    cells = materialise(_cells(sets), "jaccard-cells")
    # A row for each class of a cell, whatever the number of its points; where a class is missing, the cell is cut.
    classes = cells.groupBy("cell", "sized").agg(F.max(F.struct("central", "point")).alias("best"), F.count("*").alias("n"))
    place = Window.partitionBy("cell").orderBy("sized")
    classes = classes.withColumn("gap", (F.col("sized") - F.lag("sized").over(place) > 1).cast("int")).withColumn("run", F.coalesce(F.sum("gap").over(place), F.lit(0)))
    run = Window.partitionBy("cell", "run")
    elected = classes.select("cell", "sized", F.max("best").over(run)["point"].alias("pivot"), F.sum("n").over(run).alias("n")).where("n > 1").drop("n")
    regions = materialise(cells.join(elected, ["cell", "sized"]).where("point <> pivot").select("pivot", "point").distinct(), "jaccard-regions")
    discard(cells)
    return regions


def _with_members(ids: DataFrame, own: DataFrame) -> DataFrame:
    """ids (point and more) with the members of their points: sent to where the sets lie if they are few, else both are exchanged."""
    ids = materialise(ids, "jaccard-ids")
    return own.join(F.broadcast(ids), "point") if ids.count() <= BROADCAST_ROWS else own.join(ids, "point")


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sizes, common = [], []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common.append(int(np.count_nonzero(large[at] == small)))
            sizes.append((len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()), pa.array(common, pa.int64())], ["pivot", "point", "n_pivot", "n_point", "common"])


def forest(left: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what the exact join of two sub-regions links: a spanning forest of pairs (i, j).

    sets: those of the first sub-region, then (from `left` on) those of the second; left = len(sets) joins one with
    itself.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(k), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    times = np.diff(np.append(start, len(value)))
    common = np.zeros((k, k), np.float32)  # counts below 2^24 are exact
    for t in range(2, 7):
        rows = owner[start[times == t][:, None] + np.arange(t)]
        for i in range(t):
            for j in range(i + 1, t):
                np.add.at(common, (rows[:, i], rows[:, j]), 1)
    # Shingles of many sets: products of 0/1 matrices, some thousand shingles at a time.
    many = np.flatnonzero(times > 6)
    for at in range(0, len(many), 2048):
        some = many[at : at + 2048]
        n = times[some]
        place = np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        held = np.zeros((k, len(some)), np.float32)
        held[owner[place], np.repeat(np.arange(len(some)), n)] = 1
        common += held @ held.T
    common = np.triu(common, 1)
    i, j = np.nonzero(common * 100 >= PERCENT * (size[:, None] + size[None, :] - common))
    meet = (i < j) if left == k else (i < left) & (j >= left)
    parent = list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i[meet].tolist(), j[meet].tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _join_leaves(table: pa.Table) -> pa.Table:
    """Exact join of one pair of sub-regions; rows: side, point, members."""
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    names = table.column("point").to_numpy()[order]
    members = table.column("members").to_pylist()
    sets = [np.frombuffer(members[i], np.uint64) for i in order]
    left = int((side == 0).sum())
    pairs = forest(left, sets) if len(sets) > 1 and left else []
    return pa.table({"a": pa.array([int(names[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(names[j]) for _, j in pairs], pa.int64())})


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between points that give the same components as all links. sets: point, members, central."""
    regions = _regions(sets)
    own = sets.select("point", "members")
    # A region that fits into one sub-region is joined whole with its pivot, so that each of its points is sent once.
    sized = regions.groupBy("pivot").agg(F.count("*").alias("members"))
    small, large = sized.where(F.col("members") < LEAF).select("pivot"), sized.where(F.col("members") >= LEAF).select("pivot")
    whole = regions.join(small, "pivot").unionByName(small.select("pivot", F.col("pivot").alias("point")))
    whole = _with_members(whole.select(F.col("pivot").alias("pair"), F.lit(0).alias("side"), "point"), own).select("pair", "side", "point", "members")
    whole = materialise(whole.groupBy("pair").applyInArrow(_join_leaves, "a long, b long").distinct(), "jaccard-whole")
    of_pivots = _with_members(large.select(F.col("pivot").alias("point")), own).select(F.col("point").alias("pivot"), F.col("members").alias("p_members"))
    near = _with_members(regions.join(large, "pivot"), own).join(of_pivots, "pivot")
    near = near.select("pivot", "point", "p_members", "members").mapInArrow(_intersect, "pivot long, point long, n_pivot long, n_point long, common long")
    union = F.col("n_pivot") + F.col("n_point") - F.col("common")
    near = near.select("pivot", "point", (F.col("common") * 100 >= union * PERCENT).alias("core"), (1 - F.col("common") / union).alias("d"))
    near = materialise(near, "jaccard-near")
    stars = near.where("core").select(F.col("pivot").alias("a"), F.col("point").alias("b")).unionByName(whole)
    # What is left: pairs of different components with a point outside the radius, within the window of distances.
    labels = components(stars)
    roots = labels.select("point", F.col("root").alias("r"))
    outer = near.where("not core").groupBy("pivot").agg(F.min("d").alias("from_d"), F.max("d").alias("to_d"))
    slack = RADIUS + 1e-9
    active = near.join(outer, "pivot").where((~F.col("core")) | ((F.col("d") >= F.col("from_d") - slack) & (F.col("d") <= F.col("to_d") + slack)))
    active = active.join(roots, "point", "left").select("pivot", "point", "core", F.floor(F.col("d") / STEP).cast("int").alias("ring"), F.coalesce("r", "point").alias("root"))
    active = materialise(active, "jaccard-active")
    several = active.groupBy("pivot").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("members")).where("r1 <> r2").select("pivot", "members")
    # What is left of a region may fit into one sub-region.
    large = F.col("members") > LEAF
    parted = active.join(several, "pivot").withColumn("core", F.col("core") & large).withColumn("ring", F.when(large, F.col("ring")).otherwise(0))
    rings = parted.groupBy("pivot", "core", "ring").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("salts"))
    # Points of one component keep together, unless they are too many for one sub-region.
    salt = F.pmod(F.xxhash64("root") + F.pmod(F.xxhash64("point"), F.ceil(F.col("same") / LEAF)), F.col("salts")).cast("int")
    alike = parted.groupBy("pivot", "core", "ring", "root").agg(F.count("*").alias("same"))
    parted = parted.join(rings, ["pivot", "core", "ring"]).join(alike, ["pivot", "core", "ring", "root"])
    parted = materialise(parted.select("pivot", "point", "root", F.struct("core", "ring", salt.alias("salt")).alias("sub")), "jaccard-subs")
    subs = parted.groupBy("pivot", "sub").agg(F.count("*").alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    other = subs.select(F.col("pivot").alias("p2"), F.col("sub").alias("sub2"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    window = F.abs(F.col("sub.ring") - F.col("sub2.ring")) <= int(np.ceil(RADIUS / STEP)) + 1
    pairs = subs.join(other, (F.col("pivot") == F.col("p2")) & (F.col("sub") <= F.col("sub2")) & window)
    joined = (F.least("r1", "s1") == F.greatest("r2", "s2")) | (F.col("sub.core") & F.col("sub2.core"))
    pairs = pairs.where(~joined).select("pivot", "sub", "sub2")
    sides = pairs.select("pivot", "sub", F.xxhash64("pivot", "sub", "sub2").alias("pair"), F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.where(F.col("sub") != F.col("sub2")).select("pivot", F.col("sub2").alias("sub"), F.xxhash64("pivot", "sub", "sub2").alias("pair"), F.lit(1).alias("side")))
    met = _with_members(sides.join(parted, ["pivot", "sub"]).select("pair", "side", "point"), own).select("pair", "side", "point", "members")
    rest = met.groupBy("pair").applyInArrow(_join_leaves, "a long, b long")
    found = materialise(stars.unionByName(rest).distinct(), "jaccard-links")
    for spent in (regions, whole, near, active, labels, parted):
        discard(spent)
    return found


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """point, root (smallest point reachable) of every point of edges (a, b): minima over neighbours, then jumps."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, "jaccard-edges")
    labels = materialise(both.groupBy(F.col("a").alias("point")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "jaccard-labels")
    for _ in range(rounds):
        of = labels.select(F.col("point").alias("b"), F.col("root").alias("r"))
        lower = both.join(of, "b").groupBy(F.col("a").alias("point")).agg(F.min("r").alias("low"))
        step = labels.join(lower, "point").select("point", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = step.select(F.col("point").alias("via"), F.col("root").alias("up"))
        step = step.join(jump, step.root == jump.via, "left").select("point", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        step = materialise(step, "jaccard-labels")
        discard(labels)
        labels = step.select("point", "root")
        labels.written = step.written
        if step.where("old <> root").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """n_shingles and component of every row of docs: key (long), carry..., n_shingles, component_id, group_id.

    A-Z count as a-z; words are runs of anything but ASCII white space; a set holds the distinct shingles of WORDS
    words, with fewer words the whole sequence. Rows link when 100 * intersection >= PERCENT * union; component_id is
    the smallest key reachable. group_id tells components apart even where rows of one key have different texts; it is
    null where there are no shingles. Null or blank text has no shingles and is its own component; equal texts link.
    A null key counts as larger than all others: it is a component_id only where all keys of a component are null.
    Repeated rows stay, one result row each. Only the columns in carry (none of them named key, text, point or
    n_shingles) are kept. Shingles are told apart by 64-bit hashes. The links between different sets that make up each
    component are found exactly, whatever its size.
    """
    rows = materialise(measure(docs, key, text, carry), "jaccard-rows")
    first = rows.where("point is not null").groupBy("point").agg(F.min("key").alias("key"))
    kept = materialise(_survivors(_text_blocks(docs, text), halved=True), "jaccard-kept")
    release(docs.sparkSession)
    wanted = materialise(kept.join(first, "point").select("key", "point"), "jaccard-wanted")
    discard(kept)
    passes = max(1, -(-wanted.count() // BROADCAST_ROWS))
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = []
    for i in range(passes):
        some = wanted.where(F.pmod(F.xxhash64("point"), F.lit(passes)) == i).select(F.col("key").alias("first"), "point")
        picked = texts.join(F.broadcast(some), F.col("key").eqNullSafe(F.col("first")))
        part = materialise(_members(picked, "text"), "jaccard-sets")
        if part.count() > some.count():  # a key of several rows with one text
            parts.append(materialise(part.dropDuplicates(["point"]), "jaccard-sets"))
            discard(part)
        else:
            parts.append(part)
    discard(wanted)
    again = materialise(_survivors(_set_blocks(reduce(DataFrame.unionByName, parts))), "jaccard-kept")
    left = []
    for i, part in enumerate(parts):  # a pass has no more survivors than could be broadcast before
        some = again.where(F.pmod(F.xxhash64("point"), F.lit(passes)) == i).select("point", "central")
        left.append(materialise(part.join(F.broadcast(some), "point").select("point", "members", "central"), "jaccard-sets"))
        discard(part)
    discard(again)
    sets = reduce(DataFrame.unionByName, left)
    found = links(sets)
    for part in left:
        discard(part)
    roots = components(found)
    discard(found)
    groups = first.join(roots, "point", "left").select("point", "key", F.coalesce("root", "point").alias("group_id"))
    smallest = groups.groupBy("group_id").agg(F.min("key").alias("component_id"))
    of = groups.join(smallest, "group_id").select("point", "component_id", "group_id")
    return rows.join(of, "point", "left").select(F.col("key").alias(key), *carry, "n_shingles", F.coalesce("component_id", "key").alias("component_id"), "group_id")

"""Byte-level BPE with Spark's higher-order functions and literal rank tables."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import discard, materialise, slices

#: At most so many of the most frequent distinct words are folded once for all documents; none beyond so many bytes.
HOT_WORDS, HOT_BYTES = 50_000, 32
#: Longer words (in bytes) are folded one by one; batches are cut into runs of documents of about so many words.
LONG, SLICE = 256, 1 << 20
#: A part of the fold's state is an id in the lower bits, and above it the id that it and the next one merge to, or no id.
_BITS, _ID_MASK, _NONE, _EDGE = 32, (1 << 32) - 1, 1 << 62, 1 << 30


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 pieces. The driver reads it; executors only see the literals made of it."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _constant(text: str, kind: str) -> Column:
    """A constant of JSON, which the optimiser folds once; as a literal, it costs the SQL parser nothing."""
    return F.from_json(F.lit(text), kind)


def _json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"))


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: the end of a fold over nothing. Unlike transform, this copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


@cache
def merge_arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ids, row starts and entries: the sparse matrix (left id, right id) -> merged id, with its rows overlaid.

    Every row of the matrix is shifted so far that no two rows have an entry in one place; an entry names its row.
    """
    ranks = load_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no rank for the bytes {missing}")
    top = max(ranks.values()) + 1
    window, free = 4096, 0
    taken = np.zeros(2 * top + 4 * sum(map(len, rows.values())) + window, bool)
    entries, starts = np.full(len(taken), -1, np.int64), np.zeros(top, np.int64)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right = np.array([r for r, _ in row])
        away, at = right - right.min(), free
        while not len(fits := np.flatnonzero(~np.logical_or.reduce([taken[at + a : at + a + window] for a in away]))):
            at += window
            if at + top + window > len(taken):
                taken, entries = np.append(taken, np.zeros(len(taken), bool)), np.append(entries, np.full(len(entries), -1, np.int64))
        at += int(fits[0])
        taken[at + away] = True
        entries[at + away] = np.array([m for _, m in row]) << _BITS | left
        starts[left] = at - right.min()
        free += int(np.argmin(taken[free:]))
    used = len(taken) - int(np.argmax(taken[::-1])) if rows else 0
    # Whatever two ids are looked up, the place is inside; a negative one holds another row's entry or none.
    entries = np.append(entries[:used], np.full(top + 1, -1, np.int64))
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64), starts, entries


def merge_table(path: str) -> Column:
    """The same as constants in one struct: bytes, starts and entries."""
    return F.struct(*[_constant(_json(x.tolist()), "array<bigint>").alias(name) for x, name in zip(merge_arrays(path), ("bytes", "starts", "entries"), strict=True)])


def _link(table: Column, left: Column, right: Column) -> Column:
    """A part of the state: the id left, and above it the id that it and the id right merge to (else _NONE).

    That id is the rank of the merge as well, so the least part is the one to merge next.
    """
    entry = F.get(table["entries"], (F.get(table["starts"], left.cast("int")) + right).cast("int"))
    return _bound(entry, lambda e: F.when(e.bitwiseAND(F.lit(_ID_MASK)) == left, e).otherwise(left.bitwiseOR(F.lit(_NONE))))


def _fold_ids(table: Column, ids: Column) -> Column:
    """Ranked merges folded over ids: each step merges the pair of lowest rank, the first of equals.

    The state keeps what every pair merges to, so a step looks up the two new neighbours only. A part without id
    stands before the first and after the last one.
    """
    edge = F.array(F.lit(_NONE | _EDGE))

    def step(parts: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            best = F.shiftright(least, _BITS)
            id_at = lambda at: F.get(parts, at).bitwiseAND(F.lit(_ID_MASK))

            def around(i: Column) -> Column:
                new = _bound(best, lambda b: F.array(_link(table, id_at(i - 2), b), _link(table, b, id_at(i + 1))))
                return F.flatten(F.array(F.slice(parts, 1, i - 2), new, F.slice(parts, i + 2, F.size(parts))))

            return _bound(F.array_position(parts, least).cast("int"), around)

        return _bound(F.array_min(parts), lambda least: F.when(least >= _NONE, parts).otherwise(merge(least)))

    start = F.concat(edge, F.transform(ids, lambda left, i: _link(table, left, F.get(ids, i + 1))), edge)
    return F.aggregate(F.slice(ids, 2, F.size(ids)), start, step, lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), lambda x: x.bitwiseAND(F.lit(_ID_MASK))))


def fold(word: Column, table: Column) -> Column:
    """Token ids of one short word by ranked merges folded over its bytes; its cost is the square of its length."""
    byte = lambda b: F.get(table["bytes"], b)
    six = lambda cp, by: byte(F.shiftright(cp, by).bitwiseAND(F.lit(63)) + 128)

    def utf8(cp: Column) -> Column:
        return (
            F.when(cp < 0x80, F.array(byte(cp))).when(cp < 0x800, F.array(byte(F.shiftright(cp, 6) + 0xC0), six(cp, 0)))
            .when(cp < 0x10000, F.array(byte(F.shiftright(cp, 12) + 0xE0), six(cp, 6), six(cp, 0)))
            .otherwise(F.array(byte(F.shiftright(cp, 18) + 0xF0), six(cp, 12), six(cp, 6), six(cp, 0)))
        )

    letters = F.split(word, "")
    ascii_ = F.transform(letters, lambda c: byte(F.ascii(c)))
    parts = F.when(F.octet_length(word) == F.length(word), ascii_).otherwise(F.flatten(F.transform(letters, lambda c: _bound(F.ascii(c), utf8))))
    return _bound(parts, lambda p: _fold_ids(table, p)).cast("array<int>")


@cache
def _alone(path: str) -> dict[bytes, int]:
    """Pieces of the vocabulary that merges do not lead to: such a word is its own token nevertheless."""
    ranks, table = load_ranks(path), merge_arrays(path)
    pieces = list(ranks)
    ids, ends = fold_words(pa.array(pieces, pa.large_binary()), table)
    alone = np.diff(ends) == 1
    return {p: ranks[p] for p, one in zip(pieces, alone.tolist(), strict=True) if not one}


def words(text: Column, pattern: str) -> Column:
    """Matches of the splitting pattern; (?U) gives \\s its Unicode meaning. Null: none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, text: str, pattern: str, path: str) -> pa.Table:
    """The most frequent distinct words of all documents (w, ids), at most HOT_WORDS, each folded once.

    A histogram of the counts tells from which count on there are so few words, so no task sorts them.
    """
    counted = docs.select(F.explode(words(F.col(text), pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counted = materialise(counted.where((F.octet_length("w") <= HOT_BYTES) & (F.col("n") > 1)), "bpe-counts")
    steps = counted.groupBy("n").agg(F.count("*").alias("words"))
    steps = steps.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("total"))
    least = steps.where(F.col("total") <= HOT_WORDS).agg(F.min("n")).first()[0]
    kept = counted.where(F.col("n") >= least) if least else counted.limit(0)
    found = kept.select("w", _bound(merge_table(path), lambda t: fold(F.col("w"), t)).alias("ids")).toArrow()
    discard(counted)
    return found


def _fold_long(ids: list[int], table: tuple[np.ndarray, ...]) -> list[int]:
    """The same merges for one long word: a queue of (rank, place) over linked parts, n log n."""
    _, starts, entries = table

    def merged(left: int, right: int) -> int:
        e = int(entries[starts[left] + right])
        return e >> _BITS if e & _ID_MASK == left else -1

    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merged(ids[i], ids[i + 1])) >= 0]
    heapq.heapify(queue)
    while queue:
        best, i, left, right = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = best, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (m := merged(ids[x], ids[y])) >= 0:
                heapq.heappush(queue, (m, x, ids[x], ids[y]))
    return [x for x, on in zip(ids, alive, strict=True) if on]


def fold_words(found: pa.Array, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many distinct words, concatenated, and their len + 1 bounds: the fold's merges, a step of all at once.

    A step merges in every word the pair of lowest rank, the first of equals; words without such a pair are done.
    """
    bytes_, starts, entries = table
    found = found.cast(pa.large_binary())
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    parts, size = bytes_[raw], np.diff(at)
    owner = np.repeat(np.arange(len(found)), size)
    long_words = np.flatnonzero(size > LONG)
    done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for w in long_words.tolist():
        ids = _fold_long(parts[at[w] - at[0] : at[w + 1] - at[0]].tolist(), table)
        done.append((np.full(len(ids), w), np.array(ids, np.int64)))
    if len(long_words):
        short = size[owner] <= LONG
        parts, owner = parts[short], owner[short]
    while len(parts):
        n = len(parts)
        entry = entries[starts[parts[:-1]] + parts[1:]]
        joins = ((entry & _ID_MASK) == parts[:-1]) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(joins, entry >> _BITS, _NONE >> _BITS), _NONE >> _BITS)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank * n + np.arange(n), first)
        more = least // n < _NONE >> _BITS
        go = np.repeat(more, np.diff(np.append(first, n)))
        done.append((owner[~go], parts[~go]))
        best, place = np.divmod(least[more], n)
        parts[place] = best
        go[place + 1] = False
        parts, owner = parts[go], owner[go]
    owner, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
    order = np.argsort(owner, kind="stable")
    return ids[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(found)))))


def _gather(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ragged rows those asked for, concatenated, and their len + 1 bounds."""
    size = np.diff(bounds)[rows]
    ends = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(bounds[rows] - ends[:-1], size) + np.arange(ends[-1])], ends


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ids, the token ids of the whole text, as array<int>. Null text counts as empty; empty text has no ids.

    Every match of pattern is encoded by itself and without special tokens; characters that no match covers have no
    ids. Time grows with the square of a word's length up to LONG bytes, with n log n beyond. Repeated rows stay.
    carry: the columns of docs to return, all if None; a column named ids is replaced.

    The distinct words are counted over all documents, and the most frequent ones (a bounded number) are folded once
    by higher-order functions. What is rarer is folded once a batch, in the same order of merges, by array steps over
    all its distinct words: no word is shuffled beyond the count, and the tables sent are of bounded size.
    """
    table, often, alone = merge_arrays(path), frequent_words(docs, text, pattern, path), _alone(path)
    known = often.column("w").combine_chunks().cast(pa.large_string())
    known_ids = often.column("ids").combine_chunks()
    known_values, known_ends = known_ids.values.to_numpy().astype(np.int64), known_ids.offsets.to_numpy().astype(np.int64)
    keep = [c for c in (docs.columns if carry is None else carry) if c != "ids"]

    def ids_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(distinct, known).fill_null(-1).to_numpy()
        new = np.flatnonzero(at < 0)
        values, ends = fold_words(distinct.take(pa.array(new)), table)
        place = np.where(at >= 0, at, 0) if len(known) else np.zeros(len(at), np.int64)
        place[new] = len(known) + np.arange(len(new))
        values, ends = _gather(np.append(known_values, values), np.append(known_ends, known_ends[-1] + ends[1:]), place)
        if alone:
            each = [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            each = [[alone[w]] if (w := word.encode()) in alone else e for word, e in zip(distinct.to_pylist(), each, strict=True)]
            values, ends = np.array([i for e in each for i in e], np.int64), np.concatenate(([0], np.cumsum([len(e) for e in each])))
        return values, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            bounds = lists.offsets.to_numpy().astype(np.int64)
            for first, last in slices(bounds, SLICE):
                found = lists.values.slice(bounds[first], bounds[last] - bounds[first]).cast(pa.large_string()).dictionary_encode()
                values, ends = ids_of(found.dictionary)
                ids, to = _gather(values, ends, found.indices.to_numpy().astype(np.int64))
                each = pa.ListArray.from_arrays(pa.array(to[bounds[first : last + 1] - bounds[first]].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[: len(keep)]), each], [*keep, "ids"])

    sent = docs.select(*keep, words(F.col(text), pattern).alias("__words"))
    return sent.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("ids", ArrayType(IntegerType()))]))


@cache
def _piece_json(path: str) -> str:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return _json(pieces)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of token ids: the pieces, concatenated. Null stays null."""
    pieces = _constant(_piece_json(path), "array<string>")
    return _bound(pieces, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))


def little_endian(ids: Column, path: str) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    coded = _constant(_json([i.to_bytes(4, "little").hex() for i in range(max(load_ranks(path).values()) + 1)]), "array<string>")
    return _bound(coded, lambda c: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(c, i)), "")))

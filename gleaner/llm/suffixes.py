"""Suffix-array dedup: bytes of repeated long strings are removed, by external induced sorting in shards.

Sorting every suffix of a corpus would ship each byte many times. As in induced sorting, a sample of suffixes is sorted
and the rest are induced from it: the anchors of a text, minimisers of its windows, are chosen by content alone, so
that equal windows have their anchor at the same place, and every window of LENGTH bytes has exactly one.

1. Tasks send packed 32-bit keys of anchors (K bytes) to shards; an anchor that only one text holds induces no repeat.
2. The other anchors are sent with the bytes of the windows they induce, once for each run of documents.
3. A shard sorts those suffix tuples through a disk-backed priority queue and gets the longest common prefix (LCP) of
   neighbours. Then it goes left byte by byte: the suffix that starts o bytes before an anchor is named by the byte in
   front and the name of the suffix behind it, and two windows are equal if these names are and the LCP to the right
   still covers LENGTH - o bytes. Each class of equal windows takes its smallest document.
4. The classes go back to the runs of documents that sent them; each text gets the spans to remove.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import STRIP_BYTES, discard, materialise, mix, powers, release, shuffle_parts, slices, text_buffers

#: Length of the strings that count as repeats, and of the anchors: every window of LENGTH bytes holds one.
LENGTH, K = 50, 24
WINDOW = LENGTH - K + 1
CONTEXT = WINDOW - 1 + LENGTH
#: Bytes of suffix tuples that a queue holds before it writes a sorted run to the task's own disk.
QUEUE_BYTES = 16 << 20
#: Suffix tuples that are induced at a time, about: each of them gives up to WINDOW hits.
INDUCED = 1 << 15

# Suffix tuple: anchor, bytes of its windows (zeros elsewhere), first and last window (bytes before the anchor),
# smallest document, and the run and place it came from.
TUPLE = np.dtype([("anchor", "<u8"), ("ctx", "u1", CONTEXT), ("lo", "u1"), ("hi", "u1"), ("doc", "<i8"), ("run", "<i8"), ("id", "<u4")])


#: Fields that are sent; the anchor follows from the bytes.
_SENT = tuple(n for n in TUPLE.names if n != "anchor")


def pack(x: np.ndarray) -> bytes:
    """Tuples field by field, compressed."""
    return zstandard.compress(b"".join(x[n].tobytes() for n in _SENT), 3)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    x = np.zeros(len(raw) // (TUPLE.itemsize - 8), TUPLE)
    at = 0
    for name in _SENT:
        size = len(x) * TUPLE[name].itemsize
        x[name] = np.frombuffer(raw, TUPLE[name].base, size // TUPLE[name].base.itemsize, at).reshape(x[name].shape)
        at += size
    with np.errstate(over="ignore"):
        for i, power in enumerate(powers(K)[0]):
            x["anchor"] += (x["ctx"][:, WINDOW - 1 + i].astype(np.uint64) + np.uint64(1)) * power
    x["anchor"] = mix(x["anchor"])
    return x


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash, lo, hi) of all anchors: they own the windows that start hi to lo bytes before them.

    The anchor of a window is its first K bytes of smallest hash (33 bits of it), the leftmost of equals. Some documents
    at a time, as this takes up to 100 bytes a byte of text.
    """
    found = []
    for a, b in slices(offsets, STRIP_BYTES):
        doc, place, *more = _anchors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append((doc + a, place + offsets[a], *more))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _anchors(raw[:0], offsets[:1])


def _anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    nothing = np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing, nothing, np.zeros(0, np.uint64), nothing, nothing
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        hashes = mix((total[K:] - total[: n - K + 1]) * down[: n - K + 1])
    del total
    key = (hashes >> np.uint64(31) << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])  # smallest of WINDOW from each place on
    count = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.repeat(offsets[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = (low[start] & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    place = at[first]
    return doc[first], place, hashes[place], place - start[last], place - start[first]


_BLOCK = "part int, kind int, codes binary, names binary, counts binary"


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equal values, and the run of each place."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _grouped(group: np.ndarray, payload: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its payload) of rows sorted by group."""
    first, _ = _runs(group)
    for a, b in zip(first.tolist(), np.append(first[1:], len(group)).tolist()[: len(first)], strict=True):
        yield int(group[a]), payload[a:b]


def _pack(doc: np.ndarray, code: np.ndarray, names: np.ndarray, parts: int) -> list[tuple]:
    """Blocks of a run of texts: which of its codes are shared within the run, and the others for the shards.

    Of a code that several texts of the run hold, two witnesses are sent (kind 2), so that no shard gets more than
    two rows of a code from a run.
    """
    _, one = np.unique(names, return_index=True)
    keep = np.zeros(len(names), bool)
    keep[one] = True
    doc, code = doc[keep[doc]], code[keep[doc]]
    order = np.lexsort((doc, code))
    doc, code = doc[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    doc, code = doc[new], code[new]
    first, run = _runs(code)
    shared = np.diff(np.append(first, len(code)))[run] > 1 if len(code) else np.zeros(0, bool)
    rows = []
    local = np.argsort(doc[shared], kind="stable")
    for d, codes in _grouped(doc[shared][local], code[shared][local]):
        rows.append((int(names[d] % parts), 1, _MIXED + codes.tobytes(), names[d : d + 1].tobytes(), b""))
    send = ~shared | (np.arange(len(code)) - first[run] < 2) if len(code) else shared
    doc, code, shared = doc[send], code[send], shared[send]
    part = (code % np.uint64(parts)).astype(np.int64)
    group = (part * 2 + shared) * max(1, len(names)) + doc
    order = np.argsort(group, kind="stable")
    group, key = group[order], (code[order] // np.uint64(parts)).astype(np.uint32)
    at, _ = _runs(group)
    places = np.append(at, len(group))
    who, cut = names[group[at] % max(1, len(names))], group[at] // max(1, len(names))
    for c, place in _grouped(cut, np.arange(len(cut))):
        a, b = place[0], place[-1] + 1
        rows.append((c // 2, 2 if c % 2 else 0, key[places[a] : places[b]].tobytes(), who[a:b].tobytes(), np.diff(places[a : b + 1]).astype(np.uint32).tobytes()))
    return rows


def _shared_codes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From blocks sorted by part: text, codes of its anchors that another text holds as well. One part is held at a time."""

        def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["text_id", "codes"])

        def flush(part: int, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
            key = np.concatenate([np.frombuffer(b[1], np.uint32) for b in blocks])
            name = np.concatenate([np.repeat(np.frombuffer(b[2], np.int64), np.frombuffer(b[3], np.uint32)) for b in blocks])
            known = np.concatenate([np.full(len(b[1]) // 4, b[0] == 2) for b in blocks])
            order = np.lexsort((known, name, key))
            key, name, known = key[order], name[order], known[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, name, known = key[first], name[first], known[first]
            twin = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            key, name = key[twin & ~known], name[twin & ~known]
            order = np.argsort(name, kind="stable")
            head = np.uint32(part).tobytes()
            if len(key):
                yield out([(n, head + c.tobytes()) for n, c in _grouped(name[order], key[order])])

        current, held = -1, []
        for batch in batches:
            passed = []
            for part, kind, codes, names, counts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != current and held:
                    yield from flush(current, held)
                    held = []
                current = part
                if kind == 1:
                    passed.append((int(np.frombuffer(names, np.int64)[0]), codes))
                else:
                    held.append((kind, codes, names, counts))
            if passed:
                yield out(passed)
        if held:
            yield from flush(current, held)

    return run


#: Before codes of any part; keys of one part have that part before them.
_MIXED = b"\xff\xff\xff\xff"


def _read_codes(blocks: list[bytes], parts: int) -> np.ndarray:
    """The codes of packed blocks."""
    out = [np.zeros(0, np.uint64)]
    for b in blocks:
        if b[:4] == _MIXED:
            out.append(np.frombuffer(b, np.uint64, offset=4))
        else:
            out.append(np.frombuffer(b, np.uint32, offset=4).astype(np.uint64) * np.uint64(parts) + np.uint64(int.from_bytes(b[:4], "little")))
    return np.concatenate(out)


def _codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32-bit key of a hash as one number."""
    return hashes % np.uint64(parts << 32)


class TupleQueue:
    """A priority queue of suffix tuples by anchor and bytes: sorted runs on the task's disk, merged block by block."""

    def __init__(self, most: int = QUEUE_BYTES):
        self.most, self.held, self.bytes = most, [], 0
        self.runs: list = []

    @staticmethod
    def order(x: np.ndarray) -> np.ndarray:
        """By anchor, then by the bytes from the anchor on."""
        right = np.zeros((len(x), 56), np.uint8)
        right[:, :LENGTH] = x["ctx"][:, WINDOW - 1 :]
        words = right.view(">u8").astype(np.uint64)
        return np.lexsort((*words.T[::-1], x["anchor"]))

    def push(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.bytes += x.nbytes
        if self.bytes > self.most:
            self._spill()

    def _take(self) -> np.ndarray:
        x = np.concatenate(self.held) if self.held else np.zeros(0, TUPLE)
        self.held, self.bytes = [], 0
        return x[self.order(x)]

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # gone with the task
        self._take().tofile(file)
        file.seek(0)
        self.runs.append(file)

    def pop(self) -> Iterator[np.ndarray]:
        """Sorted blocks that never cut an anchor's tuples in two."""
        if not self.runs:
            x = self._take()
            if len(x):
                yield x
            return
        self._spill()
        step = max(1, self.most // (2 * len(self.runs) * TUPLE.itemsize))
        waiting: list[np.ndarray] = []
        heads: list[tuple[int, int]] = []  # the last anchor that was read of each run

        def read(run: int) -> None:
            block = np.fromfile(self.runs[run], TUPLE, step)
            if len(block):
                waiting.append(block)
                heapq.heappush(heads, (int(block["anchor"][-1]), run))

        for run in range(len(self.runs)):
            read(run)
        while heads:
            read(heapq.heappop(heads)[1])
            if heads and sum(len(w) for w in waiting) * TUPLE.itemsize <= self.most:
                continue
            # No run can still bring an anchor below the smallest that is at the head of one.
            have = np.concatenate(waiting)
            done = have["anchor"] < np.uint64(heads[0][0]) if heads else np.ones(len(have), bool)
            waiting[:] = [have[~done]]
            if done.any():
                x = have[done]
                yield x[self.order(x)]


def induce(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tuple, window, smallest document) wherever a window of a tuple occurs in a document below the tuple's own.

    x: tuples in the order of TupleQueue, with all tuples of an anchor. Names and LCP values are carried left.
    """
    n = len(x)
    right = x["ctx"][:, WINDOW - 1 :]
    differ = right[1:] != right[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    lcp[x["anchor"][1:] != x["anchor"][:-1]] = -1
    name = np.zeros(n, np.int64)
    found = []
    for o in range(WINDOW):
        if o:
            _, name = np.unique(name * 256 + x["ctx"][:, WINDOW - 1 - o], return_inverse=True)
        behind = np.concatenate(([0], np.cumsum(lcp < LENGTH - o)))
        mine = np.flatnonzero((x["lo"] <= o) & (x["hi"] >= o))
        if len(mine) < 2:
            continue
        whole = behind[mine] * n + name[mine]
        order = np.argsort(whole, kind="stable")
        first, run = _runs(whole[order])
        low = np.minimum.reduceat(x["doc"][mine][order], first)[run]
        hit = low < x["doc"][mine][order]
        found.append((mine[order][hit], np.full(int(hit.sum()), o), low[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _contexts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text_id, text, codes -> blocks of suffix tuples by part (kind 0), and who holds them (kind 1)."""
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            docs, ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)
            wanted = batch.column(3).to_pylist()
            for first, last in slices(offsets):
                serial += 1
                at = offsets[first : last + 1] - offsets[first]
                part_raw = raw[offsets[first] : offsets[last]]
                doc, place, hashes, lo, hi = anchors(part_raw, at)
                code = _codes(hashes, parts)
                keep = np.zeros(len(doc), bool)
                edges = np.searchsorted(doc, np.arange(last - first + 1))
                for d in range(last - first):
                    if wanted[first + d] and edges[d] < edges[d + 1]:
                        keep[edges[d] : edges[d + 1]] = np.isin(code[edges[d] : edges[d + 1]], _read_codes(wanted[first + d], parts))
                doc, place, hashes, lo, hi = doc[keep], place[keep], hashes[keep], lo[keep], hi[keep]
                if not len(doc):
                    continue
                reach = np.arange(-(WINDOW - 1), LENGTH)
                ctx = np.zeros((len(doc), CONTEXT), np.uint8)
                for a in range(0, len(doc), 8192):
                    some = slice(a, a + 8192)
                    inside = (reach >= -hi[some, None]) & (reach < LENGTH - lo[some, None])
                    ctx[some] = np.where(inside, part_raw[np.clip(place[some, None] + reach, 0, len(part_raw) - 1)], 0)
                wide = np.zeros((len(doc), 80), np.uint8)
                wide[:, :CONTEXT], wide[:, CONTEXT], wide[:, CONTEXT + 1] = ctx, lo, hi
                print_ = hashes.copy()
                for w in wide.view(np.uint64).T:
                    print_ = mix(print_ ^ w)
                _, one, same = np.unique(print_, return_index=True, return_inverse=True)
                low = np.full(len(one), np.iinfo(np.int64).max)
                np.minimum.at(low, same, docs[first:last][doc])
                x = np.zeros(len(one), TUPLE)
                x["anchor"], x["ctx"], x["lo"], x["hi"], x["doc"], x["run"], x["id"] = hashes[one], ctx[one], lo[one], hi[one], low, serial, np.arange(len(one))
                to = (x["anchor"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                rows = [(p, 0, serial, pack(t), b"", b"", b"") for p, t in _grouped(to[order], x[order])]
                held = np.stack((doc, place - at[doc], same, lo, hi)).astype(np.int32)
                rows.append((-1, 1, serial, zstandard.compress(held.tobytes(), 1), docs[first:last].tobytes(), ids[first:last].astype(np.int64).tobytes(), low.tobytes()))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "kind", "run", "data", "docs", "ids", "low"])

    return run


def _pieces(x: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted tuples in pieces of about INDUCED; none cuts an anchor's tuples in two."""
    first, _ = _runs(x["anchor"])
    a = 0
    while a < len(x):
        i = int(np.searchsorted(first, a + INDUCED))
        b = int(first[i]) if i < len(first) else len(x)
        yield x[a:b]
        a = b


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, data -> run, hits: what each run needs to know of its tuples."""
    queue = TupleQueue()
    for batch in batches:
        for data in batch.column(1).to_pylist():
            queue.push(unpack(data))
    kind = np.dtype([("id", "<u4"), ("o", "u1"), ("doc", "<i8")])
    for x in (piece for block in queue.pop() for piece in _pieces(block)):
        t, o, doc = induce(x)
        run = x["run"][t]
        hits = np.zeros(len(t), kind)
        hits["id"], hits["o"], hits["doc"] = x["id"][t], o, doc
        order = np.argsort(run, kind="stable")
        rows = [(r, h.tobytes()) for r, h in _grouped(run[order], hits[order])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["run", "hits"])


def _spans(held: pa.Table, hits: pa.Table) -> pa.Table:
    """Of one run: doc_id, text_id and the merged spans to remove, as int32 pairs."""
    out: list[tuple[int, int, bytes]] = []
    kind = np.dtype([("id", "<u4"), ("o", "u1"), ("doc", "<i8")])
    for row in held.select(["data", "docs", "ids", "low"]).to_pylist():
        doc, place, same, lo, hi = np.frombuffer(zstandard.decompress(row["data"]), np.int32).reshape(5, -1).astype(np.int64)
        docs, ids, low = (np.frombuffer(row[c], np.int64) for c in ("docs", "ids", "low"))
        best = np.repeat(low[:, None], WINDOW, axis=1)  # of each tuple and window
        got = [np.frombuffer(h, kind) for h in hits.column("hits").to_pylist()]
        if got:
            h = np.concatenate(got)
            best[h["id"], h["o"]] = h["doc"]
        own = docs[doc]
        n = hi - lo + 1
        at = np.repeat(np.arange(len(doc)), n)
        o = np.repeat(hi, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        gone = best[same[at], o] < own[at]
        d, start = doc[at][gone], (place[at] - o)[gone]
        order = np.lexsort((start, d))
        d, start = d[order], start[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (start[1:] > start[:-1] + LENGTH)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d))[: len(first)] - 1
        pairs = np.stack((start[first], start[last] + LENGTH), axis=1).astype(np.int32)
        out += [(int(docs[k]), int(ids[k]), p.tobytes()) for k, p in _grouped(d[first], pairs)]
    return pa.table({"doc_id": pa.array([r[0] for r in out], pa.int64()), "text_id": pa.array([r[1] for r in out], pa.int64()), "spans": pa.array([r[2] for r in out], pa.binary())})


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where texts repeat smaller documents: text_id, text_id2, first (smallest key of the text), spans.

    One row for each distinct text; spans are int32 pairs [start, end) in bytes, disjoint and rising, null if none.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text")).withColumn("text_id2", F.xxhash64(F.lit("second"), "text"))
    first = rows.groupBy("text_id", "text_id2").agg(F.min("doc_id").alias("first"))
    first = materialise(first, "suffix-texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                doc, _, hashes, _, _ = anchors(raw[offsets[a] : offsets[b]], at)
                got = _pack(doc, _codes(hashes, parts), names[a:b], parts)
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], ["part", "kind", "codes", "names", "counts"])

    blocks = rows.select("text_id", "text").mapInArrow(find, _BLOCK).repartition(parts, "part").sortWithinPartitions("part")
    shared = blocks.mapInArrow(_shared_codes(parts), "text_id long, codes binary")
    shared = shared.groupBy("text_id").agg(F.collect_list("codes").alias("codes"))
    shared = materialise(shared.join(first, "text_id").select("text_id", "text_id2", F.col("first").alias("doc_id"), "codes"), "suffix-anchors")
    release(spark)
    # Only the first document of each text takes part; its copies are removed whole later.
    flagged = rows.join(shared, ["doc_id", "text_id", "text_id2"])
    tuples = flagged.select("doc_id", "text_id", "text", "codes").mapInArrow(_contexts(parts), "part int, kind int, run long, data binary, docs binary, ids binary, low binary")
    tuples = materialise(tuples, "suffix-tuples")
    discard(shared)
    hits = tuples.where("kind = 0").select("part", "data").repartition(parts, "part").mapInArrow(_sort_shard, "run long, hits binary")
    held = tuples.where("kind = 1").select("run", "data", "docs", "ids", "low")
    spans = held.groupBy("run").cogroup(hits.groupBy("run")).applyInArrow(_spans, "doc_id long, text_id long, spans binary")
    spans = materialise(spans.dropDuplicates(["text_id", "doc_id"]), "suffix-spans")
    discard(tuples)
    return first.join(spans.withColumnRenamed("doc_id", "first"), ["text_id", "first"], "left")


def _inner(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The whole characters within [a, b)."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """Remove every byte that a string of LENGTH bytes covers which also starts in a document with a smaller key.

    Adds n_bytes, n_spans, n_removed and kept (the bytes that stay, concatenated) to every row of docs; carry: the
    columns of docs to return, all if None; columns with those names are replaced. Texts are their UTF-8 bytes; null
    counts as empty. Strings are judged on the input; matches never cross documents; spans that touch are one. Of
    equal texts the one with the smallest key stays; the others go whole, if they have LENGTH bytes. Rows that repeat
    key and text are treated alike and do not remove each other; rows of one key with different texts do not either.
    whole_characters keeps characters that a span covers in part, so that kept is UTF-8 again.
    An empty table gives an empty result. Texts and windows are told apart by hashes of 64 bits or more.
    """
    added = ("n_bytes", "n_spans", "n_removed", "kept")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in added]
    info = repeats(docs, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("__text"), F.col(key).cast("long").alias("__key"), F.xxhash64(body).alias("__id"), F.xxhash64(F.lit("second"), body).alias("__id2"))
    info = info.select(F.col("text_id").alias("__id"), F.col("text_id2").alias("__id2"), F.col("first").alias("__first"), F.col("spans").alias("__spans"))
    sent = rows.join(info, ["__id", "__id2"]).select(*keep, "__text", (F.col("__key") > F.col("__first")).alias("__copy"), "__spans")
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some texts at a time: they are held as strings, as bytes and as what is left.
        for batch in (b.slice(first, last - first) for b in batches for first, last in slices(text_buffers(b.column(k))[1])):
            out = []
            for t, copy, spans in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist(), strict=True):
                raw = t.encode()
                cuts = [(0, len(raw))] if copy and len(raw) >= LENGTH else np.frombuffer(spans, np.int32).reshape(-1, 2).tolist() if spans and not copy else []
                if whole_characters:
                    cuts = [_inner(raw, a, b) for a, b in cuts]
                left, at = [], 0
                for a, b in cuts:
                    left.append(raw[at:a])
                    at = b
                left = b"".join((*left, raw[at:]))
                out.append((len(raw), len(cuts), len(raw) - len(left), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], [*keep, *added])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, LongType()) for c in added[:3]), StructField("kept", BinaryType())])
    return sent.mapInArrow(run, schema)

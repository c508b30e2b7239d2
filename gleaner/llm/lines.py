"""Line dedup: lines that several documents hold stay in one of them.

1. Tasks hash the lines of a run of documents. A run sends each distinct line once to its shard, with up to LEAST of
   the largest documents that hold it: that many tell whether enough documents do, and the largest is the keeper. So a
   line that a third of all documents hold reaches its shard once a run.
2. A shard builds a minimal perfect hash over its distinct line hashes. It indexes two compact arrays, fingerprints and
   counts of documents (up to LEAST); lines with enough of them have their keeper in a third.
3. Runs probe the arrays with the hashes of their distinct lines. What comes back are the lines that go, with their
   keepers; a run turns them into line numbers of its documents. Lines themselves are never exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import discard, materialise, release, shuffle_parts
from .perfect import PerfectHash

#: Spaces that do not count at the ends of a line. Fixed value.
ENDS = b" \t\n\x0b\x0c\r"
#: Bytes of text of a run of documents.
RUN_BYTES = 16 << 20
#: Stands for a doc_id that is null: smaller than all others.
NO_KEY = np.iinfo(np.int64).min

_BLOCK = "kind int, shard int, run long, data binary"
_INDEX = "shard int, function binary, prints binary, counts binary, keepers binary"


def _batch(rows: list[tuple], names: tuple[str, ...] = ("kind", "shard", "run", "data"), kinds: tuple = (pa.int32(), pa.int32(), pa.int64(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def line_key(line: bytes) -> bytes:
    """The line without spaces at its ends, A-Z lower-cased."""
    return line.strip(ENDS).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether key has at least `least` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class Run:
    """The lines of some documents: distinct hashes, and who holds them at which line number."""

    def __init__(self, shards: int, chars: int, least: int):
        self.shards, self.chars, self.least = shards, chars, least
        self.docs: list[int] = []
        self.texts: list[int] = []
        self.ids: dict[bytes, int] = {}
        self.line: list[int] = []
        self.row: list[int] = []
        self.number: list[int] = []
        self.bytes = 0

    def add(self, doc: int, text_id: int, text: bytes) -> None:
        r = len(self.docs)
        self.docs.append(doc)
        self.texts.append(text_id)
        self.bytes += len(text) + 64
        for number, line in enumerate(text.split(b"\n")):
            key = line_key(line)
            if long_enough(key, self.chars):
                h = hashlib.blake2b(key, digest_size=16).digest()
                self.line.append(self.ids.setdefault(h, len(self.ids)))
                self.row.append(r)
                self.number.append(number)

    def blocks(self, run: int) -> Iterator[tuple]:
        """Kind 0: for a shard, hashes with their largest documents. Kind 1: what the run needs again itself."""
        if not self.ids:
            return
        docs = np.array(self.docs, np.int64)
        line, row, number = np.array(self.line), np.array(self.row), np.array(self.number)
        keys = np.frombuffer(b"".join(self.ids), np.uint64).reshape(-1, 2)
        doc = docs[row]
        order = np.lexsort((~doc, line))  # of a line, documents from the largest down; ~ cannot overflow
        l, d = line[order], doc[order]
        new = np.ones(len(l), bool)
        new[1:] = (l[1:] != l[:-1]) | (d[1:] != d[:-1])
        l, d = l[new], d[new]
        first = np.flatnonzero(np.append(True, l[1:] != l[:-1]))
        place = np.arange(len(l)) - np.repeat(first, np.diff(np.append(first, len(l))))
        l, d = l[place < self.least], d[place < self.least]
        shard = (keys[:, 0] % np.uint64(self.shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        at = np.empty(len(keys), np.int64)  # where a line is in the order of shards
        at[by_shard] = np.arange(len(keys))
        held = np.bincount(l, minlength=len(keys))
        ends = np.cumsum(held)
        edges = np.searchsorted(shard[by_shard], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            mine = by_shard[edges[s] : edges[s + 1]]
            n = held[mine]
            pick = np.repeat(ends[mine] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield (0, s, run, np.int64(len(mine)).tobytes() + keys[mine].tobytes() + n.astype(np.uint8).tobytes() + d[pick].tobytes())
        own = (np.array([len(docs), len(line)], np.int64), docs, np.array(self.texts, np.int64), at[line].astype(np.int32), row.astype(np.int32), number.astype(np.int32), edges.astype(np.int32))
        yield (1, -1, run, zstandard.compress(b"".join(x.tobytes() for x in own), 1))


def _read(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, number of documents and the documents of a block of kind 0."""
    n = int(np.frombuffer(block, np.int64, 1)[0])
    keys = np.frombuffer(block, np.uint64, 2 * n, 8).reshape(-1, 2)
    return keys, np.frombuffer(block, np.uint8, n, 8 + 16 * n), np.frombuffer(block[8 + 17 * n :], np.int64)


def _reduced(keys: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (key, document), the distinct documents of each key from the largest down, `least` at most."""
    order = np.lexsort((~docs, keys[:, 1], keys[:, 0]))
    keys, docs = keys[order], docs[order]
    other = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    new = other | np.append(True, docs[1:] != docs[:-1])
    keys, docs, other = keys[new], docs[new], other[new]
    first = np.flatnonzero(other)
    few = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs)))) < least
    return keys[few], docs[few]


def _build(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """shard, data sorted by shard -> the index of each shard. Rows that pile up are reduced on the way."""

        def index() -> pa.RecordBatch:
            keys, docs = _reduced(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), least)
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            n = np.diff(np.append(first, len(keys)))
            keys, largest = keys[first], docs[first]
            function = PerfectHash.build(keys[:, 0], keys[:, 1])
            order = np.argsort(function.lookup(keys[:, 0], keys[:, 1]))
            prints, counts = (keys[order, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[order].astype(np.uint8)
            row = (shard, function.to_bytes(), prints.tobytes(), counts.tobytes(), largest[order][counts >= least].tobytes())
            return _batch([row], ("shard", "function", "prints", "counts", "keepers"), (pa.int32(), *[pa.binary()] * 4))

        shard, held, most, size = None, [], 1 << 20, 0
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard is not None and s != shard:
                    yield index()
                    held, most, size = [], 1 << 20, 0
                shard = s
                keys, n, docs = _read(data)
                held.append((np.repeat(keys, n, axis=0), docs))
                size += len(docs)
                if size > most:
                    held = [_reduced(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), least)]
                    size = len(held[0][1])
                    most = max(most, 2 * size)
        if held:
            yield index()

    return run


class LineIndex:
    """The arrays of a shard, as they were written."""

    def __init__(self, function: bytes, prints: bytes, counts: bytes, keepers: bytes, least: int):
        self.function = PerfectHash.from_bytes(function)
        self.prints, self.counts = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint8)
        self.keepers, self.least = np.frombuffer(keepers, np.int64), least
        self.rank = np.cumsum(self.counts >= least) - 1

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys enough documents hold, their keepers)."""
        at = self.function.lookup(keys[:, 0], keys[:, 1])
        known = np.flatnonzero(at >= 0)
        known = known[self.prints[at[known]] == (keys[known, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
        known = known[self.counts[at[known]] >= self.least]
        return known, self.keepers[self.rank[at[known]]]


def _probe(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """shard, run, data, function, prints, counts, keepers sorted by shard and run; the arrays stand in a row without run, which comes first."""
        index, out = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                shard, run_id = columns[0][i].as_py(), columns[1][i].as_py()
                if run_id is None:
                    index = LineIndex(*(c[i].as_py() for c in columns[3:]), least)
                    continue
                where, keepers = index.probe(_read(columns[2][i].as_py())[0])
                if len(where):
                    out.append((run_id, shard, where.astype(np.int32).tobytes(), keepers.tobytes()))
            if out:
                yield _batch(out, ("run", "shard", "places", "keepers"), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))
                out = []

    return run


def _spread(held: pa.Table, hits: pa.Table) -> pa.Table:
    """Of one run: doc_id, text_id and the numbers of the lines that go."""
    out: list[tuple[int, int, bytes]] = []
    found = hits.select(["shard", "places", "keepers"]).to_pylist()
    for data in held.column("data").to_pylist() if found else ():
        raw = zstandard.decompress(data)
        n_docs, n_lines = np.frombuffer(raw, np.int64, 2).tolist()
        docs, texts = np.frombuffer(raw, np.int64, 2 * n_docs, 16).reshape(2, -1)
        rest = np.frombuffer(raw, np.int32, offset=16 + 16 * n_docs)
        line, row, number = rest[: 3 * n_lines].reshape(3, -1)
        edges = rest[3 * n_lines :]
        goes, keeper = np.zeros(int(edges[-1]), bool), np.zeros(int(edges[-1]), np.int64)
        for hit in found:
            places = edges[hit["shard"]] + np.frombuffer(hit["places"], np.int32)
            goes[places], keeper[places] = True, np.frombuffer(hit["keepers"], np.int64)
        gone = goes[line] & (keeper[line] != docs[row])
        row, number = row[gone], number[gone]  # lines were added document by document
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        out += [(int(docs[row[a]]), int(texts[row[a]]), number[a:b].tobytes()) for a, b in zip(first.tolist(), np.append(first[1:], len(row)).tolist(), strict=False)]
    return pa.table({"__doc": pa.array([r[0] for r in out], pa.int64()), "__text": pa.array([r[1] for r in out], pa.int64()), "__gone": pa.array([r[2] for r in out], pa.binary())})


def text_bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = 20, documents: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Drop lines that at least `documents` documents hold from all of them but the one with the largest key.

    Adds n_lines (before dropping), n_dropped and kept (the lines that stay, joined by \\n) to every row of docs; carry:
    the columns of docs to return, all if None; columns with those names are replaced. Lines are cut at \\n alone, so a
    null or empty text has one empty line. Lines are compared without the six ASCII space characters at both ends
    and with A-Z lower-cased; those of fewer than `chars` code points always stay. In the document that keeps a line
    all its repetitions stay. Documents are told apart by key: rows that repeat a key count as one document. A null key
    counts as one document, smaller than all others. An empty table gives an empty result. Lines are told apart by 128-bit
    hashes: the function settles whole hashes, and each probe is one of its keys.
    """
    spark = docs.sparkSession
    added = ("n_lines", "n_dropped", "kept")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in added]
    shards = shuffle_parts(spark)
    doc = F.coalesce(F.col(key).cast("long"), F.lit(int(NO_KEY)))
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_id"), text_bytes(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 32, Run(shards, chars, documents)
        for batch in batches:
            for d, t, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.add(d.as_py(), t.as_py(), x.as_py())
                if held.bytes >= RUN_BYTES:
                    if out := list(held.blocks(run)):
                        yield _batch(out)
                    run, held = run + 1, Run(shards, chars, documents)
        if out := list(held.blocks(run)):
            yield _batch(out)

    runs = materialise(rows.mapInArrow(scan, _BLOCK), "lines-runs")
    blocks = runs.where("kind = 0").select("shard", "run", "data")
    dealt = lambda df: df.repartition(shards, "shard")
    index = dealt(blocks.select("shard", "data")).sortWithinPartitions("shard").mapInArrow(_build(documents), _INDEX)
    index = materialise(index, "lines-index")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("function", "prints", "counts", "keepers")]
    arrays = index.select("shard", F.lit(None).cast("long").alias("run"), F.lit(None).cast("binary").alias("data"), "function", "prints", "counts", "keepers")
    probes = dealt(blocks.select("shard", "run", "data", *empty).unionByName(arrays)).sortWithinPartitions("shard", F.col("run").asc_nulls_first())
    hits = probes.mapInArrow(_probe(documents), "run long, shard int, places binary, keepers binary")
    held = runs.where("kind = 1").select("run", "data")
    gone = held.groupBy("run").cogroup(hits.groupBy("run")).applyInArrow(_spread, "__doc long, __text long, __gone binary")
    # A row that is repeated has the same lines to drop.
    gone = materialise(gone.dropDuplicates(["__doc", "__text"]), "lines-gone")
    discard(runs)
    discard(index)
    release(spark)
    sent = docs.select(*keep, text_bytes(text).alias("__body"), doc.alias("__doc"), F.xxhash64(text).alias("__text"))
    # Texts meet what they lose in an exchange at every size: a broadcast of it would grow with the documents.
    sent = sent.hint("merge").join(gone, ["__doc", "__text"], "left").select(*keep, "__body", "__gone")
    k = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for body, gone in zip(batch.column(k), batch.column(k + 1), strict=True):
                lines = body.as_py().split(b"\n")
                numbers = set(np.frombuffer(gone.as_py(), np.int32).tolist()) if gone.is_valid else ()
                total.append(len(lines))
                dropped.append(len(numbers))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in numbers) if numbers else body.as_py())
            new = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new], [*keep, *added])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType())])
    return sent.mapInArrow(cut, schema).withColumn("kept", F.col("kept").cast("string"))

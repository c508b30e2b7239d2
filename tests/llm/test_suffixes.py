import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import queries, suffixes


def spans(rows):
    """((key, text), maximal runs of bytes to remove) by a table of all strings of LENGTH bytes."""
    n = suffixes.LENGTH
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, k), k)
    for k, t in rows:
        b = (t or "").encode()
        out = []
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < k:
                if out and i <= out[-1][1]:
                    out[-1][1] = i + n
                else:
                    out.append([i, i + n])
        yield (k, t), out


def brute(rows):
    out = []
    for (k, t), gone in spans(rows):
        b = (t or "").encode()
        left = b"".join(b[a:e] for a, e in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(b)], strict=True))
        out.append((k, len(b), len(b) - len(left), len(gone), left))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é日\n" if seed else "ab"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([30, 49, 50, 51, 80, 300])) for _ in range(10)]
    rows = []
    for i in range(150):
        parts = [rng.choice([text(rng.randrange(0, 120)), rng.choice(passages), rng.choice(passages)[rng.randrange(20) :]]) for _ in range(rng.randrange(0, 5))]
        rows.append((i * 2, "".join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(7, "x" * 400), (9, "x" * 60), (11, "x" * 49), (2000, "ab " * 200), (2001, "ab " * 40), (2002, None), (2003, "")]
    return rows


@pytest.mark.parametrize(("seed", "most"), [(0, 1 << 26), (1, 1 << 26), (2, 20_000)])
def test_against_all_strings(spark, seed, most, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(suffixes.TupleQueue.__init__, "__defaults__", (most,))
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove(df).collect())
    assert got == brute(rows)


def test_queue_spills_and_keeps_anchors_whole():
    rng = np.random.default_rng(1)
    x = np.zeros(5000, suffixes.TUPLE)
    x["anchor"] = rng.integers(0, 40, 5000)
    x["ctx"] = rng.integers(0, 3, (5000, suffixes.CONTEXT))
    x["id"] = np.arange(5000)
    queue = suffixes.TupleQueue(most=40_000)
    for part in np.array_split(x, 90):
        queue.push(part)
    assert len(queue.runs) > 5
    blocks = list(queue.pop())
    got = np.concatenate(blocks)
    assert sorted(got["id"].tolist()) == list(range(5000)) and (np.diff(got["anchor"].astype(int)) >= 0).all()
    assert all(a["anchor"][-1] < b["anchor"][0] for a, b in zip(blocks, blocks[1:], strict=False))


def test_odd_tables(spark):
    t = "0123456789" * 6
    df = spark.createDataFrame([(1, t), (1, t), (1, "y" + t), (2, "z" + t + "!"), (3, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove(df).collect())
    assert got == [(1, 60, 0, 0), (1, 60, 0, 0), (1, 61, 0, 0), (2, 62, 60, 1), (3, 60, 60, 1)]
    assert suffixes.remove(df.limit(0)).count() == 0
    assert suffixes.remove(df.where("doc_id = 9").unionByName(df.limit(1))).count() == 1


def test_query(spark, sf_dir):
    """The registered query, digests and all, on whole tables."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(k, n, gone, s, hashlib.sha256(left).hexdigest()) for k, n, gone, s, left in brute(rows)]
    got = queries.QUERIES["op3_suffixes"](spark, sf_dir)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_a_shard_is_induced_in_pieces():
    """Memory of a shard full of repeats follows the pieces, not the hits of all its tuples; the hits are the same."""
    n, rng = 150_000, np.random.default_rng(3)
    x = np.zeros(n, suffixes.TUPLE)
    x["ctx"] = np.repeat(rng.integers(0, 256, (n // 2, suffixes.CONTEXT), np.uint8), 2, axis=0)
    x["hi"], x["doc"], x["id"] = suffixes.WINDOW - 1, np.arange(n) % 2, np.arange(n)
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), pa.array([suffixes.pack(part)], pa.binary())], ["part", "data"]) for part in np.array_split(x, 10)]
    kind = np.dtype([("id", "<u4"), ("o", "u1"), ("doc", "<i8")])
    tracemalloc.start()
    hits, ids = 0, set()
    for batch in suffixes._sort_shard(iter(batches)):
        for data in batch.column(1).to_pylist():
            h = np.frombuffer(data, kind)
            hits += len(h)
            ids |= set(np.unique(h["id"]).tolist())
            assert not h["doc"].any()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert hits == n // 2 * suffixes.WINDOW and ids == set(range(1, n, 2))
    assert peak < 120, peak

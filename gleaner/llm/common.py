"""What the operators of this subpackage share: tables, the shared folder, word hashing over Arrow buffers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but these six ASCII characters; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\u000c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() has written for df, once what was made of it is written itself; then release()."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let the session's cleaner drop the shuffle files that nothing refers to any more, once a stage is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    """How many partitions the session gives a shuffle; the cluster sets it by the size of its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and len + 1 offsets into them; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 21):
    """Cut documents into runs of at most `most` bytes (one document at least), as (first, last + 1)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


#: Bytes of text of which a task holds the arrays of 64-bit numbers at a time; a longer document is held whole.
STRIP_BYTES = 1 << 18

_POWERS: dict[str, np.ndarray] = {}
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some documents, and for each document the index of its first word (len + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[:-1] < n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | head[1:]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | head[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

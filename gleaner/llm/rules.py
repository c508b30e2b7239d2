"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    x = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    _, pair = np.unique(x[:-1] * len(names) + x[1:], return_inverse=True)
    _, place, times = np.unique(pair[:-1] * len(names) + x[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text, in that order; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at the six ASCII spaces, nothing else
    lines = [line for line in raw.split(b"\n") if line.split()] if b"\n" in raw else ([raw] if words else [])
    return (
        len(words),
        len(text) - (len(raw) - sum(map(len, words))),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        text.count("!!"),
    )


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measures. Its bit is its place in RULES and never changes."""

    name: str
    fails: str


#: Bits are stable: rules are appended, never reordered.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", "10 * n_upper > 3 * n_words"),
    Rule("bangs", "10 * n_bangs > 2 * n_words"),
)
#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting", "bangs"),
}


def mask(names: tuple[str, ...]) -> int:
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[n] for n in names)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, all MEASURES (long) and failures, a bit for each rule that fails.

    Whole texts; null text measures like an empty one, which fails few_words. Repeated rows stay. Only the key and
    the text are read, so other columns cannot clash. Every rule is evaluated once; policies read the bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [key, *MEASURES])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return rows.withColumn("failures", failures.cast("long"))


def passes(policy: str, failures: str = "failures") -> Column:
    """Whether a row of the ledger passes a version of the policy."""
    return F.col(failures).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many rows it fails, and how many it alone keeps out. One pass over the bits."""
    names, whole = POLICIES[policy], mask(POLICIES[policy])
    hit = F.col("failures").bitwiseAND(F.lit(whole))
    counts = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).alias("bit")) for n in names])).alias("r")
    found = counts.select("hit", "n", one).select("hit", "n", "r.rule", "r.bit")
    return found.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("kept_without"),
    )

"""Spelling variants: Aho-Corasick automata over the halves of words.

Two words that differ by one edit share a half, whole: the edit lies in one of the two segments of a word, so the
other segment stands at the start or at the end of its neighbour. Shards hold both segments of every word in an
automaton. Every word is scanned by the shards that can hold a segment at its ends; a match counts if it stands at the
right end and the lengths of both words allow one edit, and is then verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, shuffle_parts

#: What counts as a run of letters. Fixed value.
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of one segment that a shard holds at most; beyond, they are dealt to several shards by a hash.
SEGMENT_WORDS = 20_000
#: Pairs that are verified at a time.
BLOCK_PAIRS = 1 << 20


def damaged(run: str, head: int, every: int) -> str:
    """The run, without one letter if the checksum of head (of the document) and run is a multiple of `every`."""
    h = zlib.crc32(run.encode(), head)
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199, least_chars: int = 6, least: int = 5) -> DataFrame:
    """word, n: words of at least least_chars letters and their occurrences in all whole texts, if `least` or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Of one run in `every`, chosen by the
    crc32 of '<key>:<run>', one letter is deleted; every = 0 deletes none. Null texts have no words; a null key counts as
    an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes.lower() changes A-Z alone
                own = Counter(LETTERS.findall(body.as_py().lower().decode("utf-8", "replace")))
                head = zlib.crc32(f"{doc}:".encode()) if every else 0
                for word, n in own.items():
                    word = damaged(word, head, every) if every else word
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def latin(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, padded with 0, and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    width = int(sizes.max(initial=1))
    left = np.zeros((len(words), width), np.uint32)
    inside = np.arange(width) < sizes[:, None]
    left[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    right = np.zeros_like(left)
    right[inside] = left[np.repeat(np.arange(len(words)), sizes), np.repeat(sizes, sizes) - 1 - (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes))]
    return left, right, sizes


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading entries two rows share."""
    wide = max(a.shape[1], b.shape[1])
    differ = np.ones((len(a), wide + 1), bool)
    narrow = min(a.shape[1], b.shape[1])
    np.not_equal(a[:, :narrow], b[:, :narrow], out=differ[:, :narrow])
    return differ.argmax(axis=1)


def _segments(word: Column, scan: bool) -> Column:
    """The segments of a word; or (scan) all that a word within one edit of it can have at the same end."""
    size = F.length(word)
    first = [size - 1, size, size + 1] if scan else [size]
    heads = [word.substr(F.lit(1), F.floor(m / 2).cast("int")) for m in first]
    tails = [word.substr((size - F.ceil(m / 2) + 1).cast("int"), F.ceil(m / 2).cast("int")) for m in first]
    return F.array_distinct(F.array(*heads, *tails)) if scan else F.array(*heads, *tails)


class Shard:
    """An automaton over segments, and the words that have each of them as their first or second half."""

    def __init__(self, words: list[str], counts: list[int], segments: list[str], ends: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.left, self.right, self.sizes = latin(words)
        groups: dict[str, dict[tuple[int, int], list[int]]] = {}
        for i, (segment, end) in enumerate(zip(segments, ends, strict=True)):
            groups.setdefault(segment, defaultdict(list))[end, len(words[i])].append(i)
        self.automaton = ahocorasick.Automaton()
        for segment, own in groups.items():
            self.automaton.add_word(segment, (len(segment), {k: np.array(v) for k, v in own.items()}))
        if groups:
            self.automaton.make_automaton()

    def matches(self, word: str) -> Iterator[tuple[int, np.ndarray]]:
        """(end, words) that share a segment with the word at that end and have a length within one of its own."""
        size = len(word)
        for last, (length, groups) in self.automaton.iter(word):
            for end in (0, 1):
                if last == (length - 1 if end == 0 else size - 1):
                    for m in (size - 1, size, size + 1):
                        if (end, m) in groups:
                            yield end, groups[end, m]

    def near(self, scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scanned word, word of the shard) for each match at an end that one edit explains, each pair at one end."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        who: list[int] = []
        held: list[np.ndarray] = []
        ends: list[int] = []
        pairs = 0
        left, right, sizes = latin(scanned)

        def verify() -> None:
            n = [len(h) for h in held]
            a, b, end = np.repeat(who, n), np.concatenate(held), np.repeat(ends, n)
            forward, backward = common(left[a], self.left[b]), common(right[a], self.right[b])
            longest = np.maximum(sizes[a], self.sizes[b])
            same = (sizes[a] == self.sizes[b]) & (forward >= longest)
            # One edit: what both share from the left and from the right covers all but one letter.
            good = ~same & (np.minimum(forward, longest) + np.minimum(backward, longest) >= longest - 1)
            # A pair that shares both segments at their ends is reported with the first one.
            good &= (end == 0) | (forward < self.sizes[b] // 2)
            found.append((a[good], b[good]))

        for i, word in enumerate(scanned):
            for end, group in self.matches(word) if len(self.automaton) else ():
                for at in range(0, len(group), BLOCK_PAIRS):
                    who.append(i)
                    held.append(group[at : at + BLOCK_PAIRS])
                    ends.append(end)
                    pairs += len(held[-1])
                    if pairs >= BLOCK_PAIRS:
                        verify()
                        who, held, ends, pairs = [], [], [], 0
        if held:
            verify()
        nothing = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (nothing, nothing)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, kind, word, n, segment sorted by shard, kind (0 and 1: first and second segments; 2: to be scanned) and word.

    Gives word, near, best_n and best of the scanned words that are near words of the shard.
    """

    def search(shard: Shard, words: list[str]) -> pa.RecordBatch:
        a, b = shard.near(words)
        order = sorted(range(len(a)), key=lambda i: (a[i], -shard.counts[b[i]], shard.words[b[i]]))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
        n = np.diff(np.append(first, len(a)))
        best = b[first]
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in a[first]], pa.string()), pa.array(n, pa.int64()), pa.array(shard.counts[best], pa.int64()), pa.array([shard.words[i] for i in best], pa.string())], ["word", "near", "best_n", "best"])

    number, held, shard, last = None, [], None, None
    for batch in batches:
        scanned: list[str] = []
        for s, kind, word, n, segment in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if s != number:
                if scanned:
                    yield search(shard, scanned)
                number, held, shard, scanned, last = s, [], None, [], None
            if kind < 2:
                held.append((word, n, segment, kind))
                continue
            if shard is None:
                shard = Shard(*([h[i] for h in held] for i in range(4)))
                held = []
            if word != last:  # a word comes once for each of its segments in this shard
                scanned.append(word)
                last = word
        if scanned:
            yield search(shard, scanned)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: how many words differ from it by one edit, and which of them occurs most often.

    words: word, n, distinct and not null, of at least two letters. Ties go to the smaller word in code-point order. Words
    without near words are left out.
    """
    spark = words.sparkSession
    parts = shuffle_parts(spark)
    word = F.col("word")
    own = words.select("word", "n", F.posexplode(_segments(word, False)).alias("kind", "segment"))
    scan = words.select("word", "n", F.lit(2).alias("kind"), F.explode(_segments(word, True)).alias("segment"))
    # Segments of very many words; every one of them has more than SEGMENT_WORDS, so there are few.
    hot = own.groupBy("segment").count().where(F.col("count") > SEGMENT_WORDS)
    hot = materialise(hot.select("segment", F.ceil(F.col("count") / SEGMENT_WORDS).cast("int").alias("salts")), "spelling-hot")
    if hot.isEmpty():
        rows = own.unionByName(scan).withColumn("salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1))
        salted = own.unionByName(scan).join(hot, "segment", "left")
        rows = salted.withColumn("salt", F.explode(F.when(F.col("kind") == 2, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), salts).cast("int")))))
    rows = rows.select(F.pmod(F.xxhash64("segment", "salt"), F.lit(parts)).cast("int").alias("shard"), "kind", "word", "n", "segment")
    found = rows.repartition(parts, "shard").sortWithinPartitions("shard", "kind", "word").mapInArrow(_scan, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame, depth: int) -> DataFrame:
    """word, root: the end of each chain of word -> form (null: none), whose chains have at most depth steps."""
    chain = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, depth - 1).bit_length()):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("to"))
        chain = chain.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"))
    return chain


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199, least_chars: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all whole texts: see count_words for what a word is.

    Two words are near if they differ by one inserted, deleted or replaced letter. The form of a word is its near word of
    the largest n (ties: the smaller in code-point order), if that is at least `ratio` (2 or more) times its own n; else
    null. root follows forms to the last one, and is the word itself if it has none. An empty table gives no rows.
    """
    words = materialise(count_words(docs, key, text, every, least_chars, least), "spelling-words")
    near = near_words(words)
    known = words.join(near, "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    known = materialise(known, "spelling-forms")
    discard(words)
    # n grows by the ratio with every step of a chain.
    most, depth = (known.agg(F.max("n")).first()[0] or 0) // max(1, least), 0
    while most:
        most, depth = most // ratio, depth + 1
    release(docs.sparkSession)
    ends = roots(known.select("word", "form"), depth)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

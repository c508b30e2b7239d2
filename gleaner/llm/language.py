"""Language ID by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Bounds of the training sample: about so many documents a language, characters of each, and symbols of text in its automaton.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 150, 80_000, 20_000
#: Fewer texts than this are parsed one by one; more of them a symbol of each at a time.
FEW = 48
#: Languages whose counts are broadcast; more of them meet the rows in a join.
BROADCAST_LANGUAGES = 10_000

_letters: list[np.ndarray] = []


def cleaned(text: str) -> bytes:
    """Lower case, every run of anything but letters as one space, as UTF-8: the symbols of a parse are its bytes."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][x]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return np.where(letter, x, np.uint32(32))[keep].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Language:
    """The suffix automaton of one language's text, as a table: state times the number of symbols, plus symbol, gives the next state.

    The alphabet is the bytes of the text, whatever their number; symbol 0 stands for every other byte. State 0 is dead, 1 is
    the start, and both count in steps of the number of symbols.
    """

    def __init__(self, text: bytes):
        used = np.unique(np.frombuffer(text, np.uint8))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        states = automaton(self.symbol[np.frombuffer(text, np.uint8)].tolist())
        table = np.zeros((len(states) + 1, self.width), np.int32)
        for i, out in enumerate(states):
            for s, to in out.items():
                table[i + 1, s] = to + 1
        self.next = (table * self.width).ravel()
        self.bits = np.log2(max(2, len(text)))


class Model:
    """The automata of all languages, and the greedy parse of texts by each of them."""

    def __init__(self, languages: tuple[str, ...], texts: tuple[bytes, ...]):
        self.languages, self.each = languages, [Language(t) for t in texts]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: phrases of each whole text's parse into longest matches; a byte that the language lacks is one by itself."""
        out = np.zeros((len(texts), len(self.each)), np.int64)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        first = np.cumsum(sizes) - sizes
        for k, own in enumerate(self.each):
            out[order, k] = self._parse(own, raw, first, sizes)
        return out

    @staticmethod
    def _parse(own: Language, raw: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of texts that are in order of their length, the longest first."""
        step, start = own.next, own.width
        found = np.zeros(len(sizes), np.int64)
        state = np.full(len(sizes), start, np.int32)
        symbols = own.symbol[raw]
        # Texts of which the first FEW still have a symbol here go on together.
        together = int(sizes[FEW - 1]) if len(sizes) >= FEW else 0
        alive = np.searchsorted(-sizes, -np.arange(1, together + 1), "right") if together else []
        for t, n in enumerate(alive.tolist() if together else ()):
            column = symbols[first[:n] + t]
            went = step.take(state[:n] + column)
            over = np.flatnonzero(went == 0)
            if len(over):
                # The open phrase ends; the symbol opens the next one, or is one if the language lacks it.
                found[over] += state[over] != start
                again = step.take(start + column[over])
                found[over] += again == 0
                went[over] = np.where(again == 0, start, again)
            state[:n] = went
        jump = memoryview(step)
        for i in np.flatnonzero(sizes > together).tolist():
            at, phrases = int(state[i]), 0
            for s in symbols[first[i] + together : first[i] + sizes[i]].tolist():
                to = jump[at + s]
                if not to:
                    phrases += at != start
                    to = jump[start + s]
                    if not to:
                        phrases += 1
                        to = start
                at = to
            state[i] = at
            found[i] += phrases
        return found + (state != start)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        spelled = [cleaned(t or "") for t in texts]
        known = [i for i, t in enumerate(spelled) if t.strip()]
        if not self.languages or not known:
            return best, score
        bits = self.phrases([spelled[i] for i in known]) * np.array([x.bits for x in self.each])
        order = np.argsort(bits, axis=1, kind="stable")
        for row, i in enumerate(known):
            best[i] = self.languages[order[row, 0]]
            low, next_ = bits[row, order[row, 0]], bits[row, order[row, 1]] if len(self.languages) > 1 else np.inf
            score[i] = 1.0 if np.isinf(next_) else next_ / (low + next_)
        return best, score


@lru_cache(maxsize=2)
def _model(languages: tuple[str, ...], texts: tuple[bytes, ...]) -> Model:
    return Model(languages, texts)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[tuple[str, ...], tuple[bytes, ...]]:
    """Languages and a bounded text of each, from rows with text and lang.

    The sample takes a row by the hash of its key at the rate that gives about SAMPLE_DOCS rows a language, SAMPLE_CHARS
    characters of each, in order of that hash until SAMPLE_SYMBOLS symbols are there: what the driver gets is bounded by the
    number of languages. Languages are in order of their names.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.substring(text, 1, SAMPLE_CHARS).alias("text"), F.xxhash64(F.lit("lang"), F.col(key)).alias("h"))
    # Texts stay where they are: languages and hashes alone meet the counts, and some 2 * SAMPLE_DOCS a language come back.
    narrow = rows.select("lang", "h")
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    counts = narrow.groupBy("lang").count()
    # A hot language is no key of an exchange as long as the languages are few.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    chosen = narrow.join(counts, "lang").where(draw * F.col("count") < 2 * SAMPLE_DOCS).select("lang", "h").distinct()
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text", "h")
    texts: dict[str, bytes] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.h, r.text)):
        had = texts.get(row.lang, b"")
        if len(had) < SAMPLE_SYMBOLS:
            texts[row.lang] = had + cleaned(row.text).strip() + b" "
    texts = {k: v[:SAMPLE_SYMBOLS] for k, v in texts.items() if v.strip()}
    names = tuple(sorted(texts))
    return names, tuple(texts[n] for n in names)


def identify(docs: DataFrame, model: tuple[tuple[str, ...], tuple[bytes, ...]], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row of docs, from its whole text alone.

    carry: the columns of docs to return; all of them if None.

    A text is parsed from its first to its last byte into the longest phrases that occur in a language's text. The language
    with the fewest phrases, each at the logarithm of its training text, wins; ties go to the smaller name. score is the runner-up's cost over the sum of both: 0.5 at a tie. Null text or text without a letter: 'und'
    and 0. Repeated rows stay; columns of docs with these names are replaced.
    """
    added = ("lang_pred", "score")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in added]
    sent = docs.select(*keep, F.col(text).alias("__text")) if text not in keep else docs.select(*keep)
    place = sent.columns.index("__text" if text not in keep else text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _model(*model)
        for batch in batches:
            best, score = parser.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, *added])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return sent.mapInArrow(run, schema)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text, modulo folds, is fold."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold

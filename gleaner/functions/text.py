"""Scalar text functions: normalisation, tokens, edit distance, ids and parsing. Built-in expressions unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token is a maximal run of letters, digits and underscores, in any script.
TOKEN = r"[\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize(text: Column, profile: str = "conservative") -> Column:
    """none: as it is. minimal: NFC, newlines as LF, no NUL or soft hyphen, stripped. conservative: also joins words
    hyphenated over a line end, collapses blanks to one and empty lines to one."""
    if profile == "none":
        return text
    return normalize_steps(nfc(text), profile)


def normalize_steps(text: Column, profile: str) -> Column:
    """What normalize does to text in normal form C, in built-in functions alone."""
    if profile not in ("minimal", "conservative"):
        raise ValueError(f"unknown profile {profile!r}")
    out = F.translate(unify_newlines(text), "\u0000­", "")
    if profile == "conservative":
        out = F.regexp_replace(out, r"(?U)(?<=\w)-\n(?=\w)", "")
        out = F.regexp_replace(F.regexp_replace(out, r"[\t\f\x0B]+", " "), " {2,}", " ")
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def prose(text: Column) -> Column:
    """Lower case, punctuation as blanks, runs of white space as one blank."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{P}", " "), r"(?U)\s+", " "))


def prose_tokens(text: Column) -> Column:
    return F.filter(F.split(prose(text), " "), lambda t: t != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def element_tokens(kind: Column, text: Column, latex: Column, cells: Column) -> Column:
    """Tokens of an element by its kind: words and single marks for code and formulas (their LaTeX, if there is any), prose for the
    rest; a table is its cells, joined, if it has any."""
    body = F.when((kind == "table") & cells.isNotNull(), F.array_join(cells, " ")).when(kind == "formula", F.coalesce(F.nullif(latex, F.lit("")), text)).otherwise(text)
    plain = F.regexp_replace(body, r"(?U)\s+", " ")
    return F.when(kind.isin("code", "formula"), F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).otherwise(prose_tokens(body))


def lines(text: Column) -> Column:
    """Normalised lines that are not empty, in order."""
    return F.filter(F.transform(F.split(unify_newlines(text), "\n"), prose), lambda x: x != "")


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.lit(1), F.length(reference))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of token arrays over the reference's length: each distinct token becomes one character beyond the surrogates, of which there are a million."""
    words = F.array_distinct(F.concat(reference, hypothesis))
    narrow = lambda a: F.array_join(F.transform(a, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(words, t)), 8, "0")), "UTF-32")), "")
    return F.levenshtein(narrow(reference), narrow(hypothesis)) / F.greatest(F.lit(1), F.size(reference))


def source_id(*parts: Column) -> Column:
    """Hash of the first part that is not blank."""
    return F.sha2(F.coalesce(*(F.nullif(F.btrim(p), F.lit("")) for p in parts)), 256)


def chunk_id(source: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(source, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))


def citations(answer: Column) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def citations_valid(answer: Column, contexts: Column, refusal: str) -> Column:
    """Whether all citations, of which there is one at least, are within 1..contexts, or the answer contains the refusal."""
    cited = citations(answer)
    return F.contains(F.lower(answer), F.lit(refusal.lower())) | ((F.size(cited) > 0) & F.forall(cited, lambda n: (n >= 1) & (n <= contexts)))


#: Factors of human-readable byte units, fixed values.
UNITS = {"B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}


def bytes_of(text: Column) -> Column:
    """Bytes of a figure such as 12.5MiB; null if it is none."""
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 2)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.nullif(unit, F.lit("")))
    return (F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double") * factor).cast("long")


def group_label(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.translate(F.lower(label), "- ", "__"))


def bag_f1(common: Column, predicted: Column, expected: Column) -> Column:
    """F1 of multisets from their common, predicted and expected sizes: 1 if both are empty."""
    return F.when((predicted == 0) & (expected == 0), F.lit(1.0)).otherwise(2 * common / F.greatest(predicted + expected, F.lit(1)))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """0 wherever the denominator is."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)

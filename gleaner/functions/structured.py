"""JSON and HTML that must have a certain shape: containment, strict answers, nesting of tables."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Containment


def json_contains(document: Column, pattern: Any) -> Column:
    """Whether a JSON text contains a pattern (a Python value), in the sense of the operator @> of jsonb.

    An object contains an object if it has all of its keys with values that contain those of the pattern. An array contains
    an array if each of its entries is contained in some entry; order and repetition do not count, and it contains a
    scalar that is one of its entries, at the top alone. Scalars contain equal ones of their kind (1 and 1.0 are equal,
    1 and "1" are not). Text that is not JSON contains nothing; null gives null. The pattern becomes an expression over a
    parsed variant, so nothing leaves the JVM and unused columns are pruned.
    """
    value = F.try_parse_json(document)
    found = _contains(value, pattern)
    if not isinstance(pattern, (dict, list)):
        entries = F.try_variant_get(value, "$", "array<variant>")
        found = found | F.coalesce(_some(entries, pattern), F.lit(False))
    return F.when(document.isNotNull(), value.isNotNull() & F.coalesce(found, F.lit(False)))


def _some(entries: Column, pattern: Any) -> Column:
    return F.exists(entries, lambda e: _contains(e, pattern))


def _contains(value: Column, pattern: Any) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(pattern, dict):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        found = F.startswith(kind, F.lit("OBJECT"))
        for key, sub in pattern.items():
            # A null in the document is a value; a key that is not there is none.
            found = found & F.coalesce(F.map_contains_key(fields, key) & _contains(F.try_element_at(fields, F.lit(key)), sub), F.lit(False))
        return F.coalesce(found, F.lit(False))
    if isinstance(pattern, list):
        entries = F.try_variant_get(value, "$", "array<variant>")
        found = F.startswith(kind, F.lit("ARRAY"))
        for sub in pattern:
            found = found & F.coalesce(_some(entries, sub), F.lit(False))
        return F.coalesce(found, F.lit(False))
    if pattern is None:
        # As a map's or array's entry, a JSON null may arrive as SQL null.
        return F.is_variant_null(value) | value.isNull()
    if isinstance(pattern, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == pattern), F.lit(False))
    if isinstance(pattern, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(value, "$", "string") == pattern), F.lit(False))
    number = F.regexp_like(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.coalesce(number & (F.try_variant_get(value, "$", "double") == float(pattern)), F.lit(False))


# Strict answers

#: What an answer must hold: its keys, and the values of its status. Fixed values.
KEYS, STATUSES = ("status", "answer", "citations"), ("answered", "insufficient_evidence")


class _Repeated(ValueError):
    pass


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise _Repeated
    return made


def read_answer(text: str | None) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """status, answer, citations and no reason; or none of them and the reason why the text is no answer."""
    try:
        value = json.loads(text or "", object_pairs_hook=_object, parse_constant=lambda _: None)
    except _Repeated:
        return None, None, None, "repeated key"
    except (ValueError, RecursionError):
        return None, None, None, "not JSON"
    if not isinstance(value, dict) or value.keys() != set(KEYS):
        return None, None, None, "other keys"
    status, answer, citations = (value[k] for k in KEYS)
    if not isinstance(status, str) or status not in STATUSES or not isinstance(answer, str):
        return None, None, None, "status or answer"
    if not isinstance(citations, list) or not all(isinstance(c, str) for c in citations):
        return None, None, None, "citations"
    return status, answer, citations, None


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("answer", StringType()), StructField("citations", ArrayType(StringType())), StructField("reason", StringType())]))
def parse_answer(text: pd.Series) -> pd.DataFrame:
    """Strict parse of a model's JSON answer: exactly three keys, none repeated at any depth, a known status, a string, strings."""
    return pd.DataFrame([read_answer(t) for t in text], columns=["status", "answer", "citations", "reason"])


# Tables

#: The elements that make a table, and what each may stand in (None: nothing). Fixed values.
INSIDE: dict[str, tuple[str | None, ...]] = {
    "table": (None,), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr",), "th": ("tr",),
}


class _Nesting(HTMLParser):
    """Events of table elements, until one breaks the nesting."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.events: list[str] = []
        self.broken = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INSIDE or self.broken:
            return
        spans = [self._span(dict(attrs), name) for name in ("rowspan", "colspan")] if tag in ("td", "th") else []
        self.broken = (self.open[-1] if self.open else None) not in INSIDE[tag] or None in spans
        self.open.append(tag)
        self.events.append(" ".join([tag, *map(str, spans)]))

    @staticmethod
    def _span(attrs: dict[str, str | None], name: str) -> int | None:
        try:
            n = int(attrs.get(name, "1"))
        except (TypeError, ValueError):
            return None
        return n if n > 0 else None

    def handle_endtag(self, tag: str) -> None:
        if tag not in INSIDE or self.broken:
            return
        self.broken = not self.open or self.open.pop() != tag
        self.events.append(f"/{tag}")


def table_events(html: str | None) -> list[str] | None:
    """Opening (cells with row and column span) and closing events of the one table in a text; null if the nesting is bad.

    Cell text and other attributes do not count. There must be exactly one table, with a cell at least, and everything
    that is opened must be closed.
    """
    reader = _Nesting()
    reader.feed(html or "")
    reader.close()
    cells = any(e.startswith(("td ", "th ")) for e in reader.events)
    return None if reader.broken or reader.open or not cells or reader.events.count("table") != 1 else reader.events


@F.pandas_udf(ArrayType(StringType()))
def table_structure(html: pd.Series) -> pd.Series:
    """table_events of each text, by Arrow batch."""
    return html.map(table_events)

"""Interval algebra. Spans are half-open; joins carry the document key, so they are hash joins with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def union_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Merge spans that overlap or touch: by..., start, end. Nulls come last, and equal spans one after the other, as in SQL."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spans.withColumn("island", island)
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of spans of one key that overlap, joined on (key, bucket) so that long documents spread over tasks.

    left: key, l_start, l_end, ...; right: key, r_start, r_end, ... A pair is reported in the first bucket that both
    touch, so none appears twice. Empty spans overlap nothing.
    """
    cut = lambda df, a, b: df.where(F.col(a) < F.col(b)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    pairs = cut(left, "l_start", "l_end").join(cut(right, "r_start", "r_end"), [key, "bucket"])
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    first = F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width)
    return pairs.where(meet & first).drop("bucket")


def covered_units(chunks: DataFrame, units: DataFrame, document: str = "doc_id") -> DataFrame:
    """question, chunk and unit wherever ONE chunk holds every interval of the unit.

    chunks: document, chunk, start, end; units: document, question, unit, u_start, u_end (a row an interval).
    """
    whole = units.groupBy(document, "question", "unit").agg(F.count("*").alias("intervals"))
    inside = chunks.join(units, document).where((F.col("start") <= F.col("u_start")) & (F.col("end") >= F.col("u_end")))
    held = inside.groupBy(document, "question", "unit", "chunk").agg(F.count("*").alias("held"))
    return held.join(whole, [document, "question", "unit"]).where("held = intervals").select("question", "chunk", "unit")


def project(segments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Segments clipped to [start, end), with their own bounds kept and their text cut to the clip."""
    a, b = F.greatest("seg_start", start), F.least("seg_end", end)
    kept = segments.where((F.col("seg_start") < end) & (F.col("seg_end") > start))
    return kept.withColumn("clip_start", a).withColumn("clip_end", b).withColumn("clip", F.substr("seg_text", a - F.col("seg_start") + 1, b - a))


def rebuild_offsets(parts: DataFrame, by: str, order: str, text: str, separator: int) -> DataFrame:
    """start and end of parts that are joined in order with a separator of so many characters."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0))
    return parts.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def nearest_kept_ancestor(items: DataFrame, rounds: int = 40) -> DataFrame:
    """item and the nearest kept ancestor (null if none): pointers of items that are not kept double their reach.

    items: item, parent, kept; items are distinct. After r rounds a pointer has climbed past 2^r items or stands at a
    kept one or above the root. What still moves after as many rounds as there are bits in the number of items goes
    around a cycle without a kept item, and gets null.
    """
    above = items.select("item", F.when(F.col("kept"), F.col("item")).otherwise(F.col("parent")).alias("to"), F.col("kept").alias("home"))
    known = items.select(F.col("item").alias("x"))
    above = cut(above.join(known, above["to"] == known["x"], "left").select("item", F.col("x").alias("to"), (F.col("home") | F.col("x").isNull()).alias("done")))
    for _ in range(min(rounds, items.count().bit_length() + 1)):
        if above.where(~F.col("done")).isEmpty():
            break
        further = above.select(F.col("item").alias("via"), F.col("to").alias("next"), F.col("done").alias("end"))
        step = above.join(further, above["to"] == further["via"], "left")
        above = cut(step.select("item", F.when(F.col("done"), F.col("to")).otherwise(F.col("next")).alias("to"), (F.col("done") | F.coalesce("end", F.lit(True))).alias("done")))
    ends = above.select(F.col("item").alias("p"), F.when(F.col("done"), F.col("to")).alias("ancestor"))
    return items.join(ends, items["parent"] == ends["p"], "left").select("item", "ancestor")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the shared folder."""
    return written(df, "spans")


def windows(length: int, step: int, duration: Column) -> Column:
    """Starts of windows of `length` over [0, duration), `step` apart; the first that reaches the end is the last."""
    count = F.greatest(F.lit(0), F.ceil((duration - length) / step)).cast("int")
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), count), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def best_match(pairs: DataFrame, detection: list[str], similarity: str, least: float, ties: list[str]) -> DataFrame:
    """Of each detection's pairs with a similarity of at least `least`, the most similar one; ties by `ties`, in order.

    One aggregation by detection with a partial minimum, so a detection with many pairs is reduced before the exchange.
    Null similarities are left out. Returns detection..., similarity and ties... of the pair.
    """
    best = F.min(F.struct((-F.col(similarity)).alias("s"), *ties)).alias("m")
    found = pairs.where(F.col(similarity) >= least).groupBy(*detection).agg(best)
    return found.select(*detection, (-F.col("m.s")).alias(similarity), *[F.col(f"m.{t}").alias(t) for t in ties])

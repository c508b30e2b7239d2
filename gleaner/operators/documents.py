"""Documents as segments: a row a segment, in order within its document. Offsets are code points, spans half-open.

Running lengths are window sums within a document, so a document's text is only put together where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .spans import cut


def normalize_segments(segments: DataFrame, by: str, order: str, text: str, kind: str, profile: str = "conservative", cells: str | None = None) -> DataFrame:
    """Segments with normalised text and the offsets that it has in the normalised document, as start and end.

    Formulas are normalised minimally whatever the profile; segments that become empty go; the others are joined by one
    line feed. cells: an array of rows of cells, normalised for tables alone; cells
    hold no U+001E or U+001F. The profile "none" leaves all as it is,
    offsets included, if there are any.
    """
    if profile == "none":
        return segments
    mild, full = tx.normalize(F.col(text), "minimal"), tx.normalize(F.col(text), profile)
    out = segments.withColumn(text, F.when(F.col(kind) == "formula", mild).otherwise(full)).where(F.length(text) > 0)
    if cells:
        # The normal form is a vectorised function and takes no lambda: it sees all cells of a segment as one text.
        joined = F.array_join(F.transform(cells, lambda row: F.array_join(row, "\u001f", "")), "\u001e", "")
        out = out.withColumn("__cells", tx.nfc(joined))
        clean = F.transform(F.split("__cells", "\u001e"), lambda row: F.transform(F.split(row, "\u001f"), lambda c: tx.normalize_steps(c, profile)))
        out = out.withColumn(cells, F.when((F.col(kind) == "table") & F.col(cells).isNotNull(), clean).otherwise(F.col(cells))).drop("__cells")
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int")
    return out.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def text_of(segments: DataFrame, by: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """by, text: the segments of each document joined in order. A document is one row, so it must fit one."""
    parts = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(by, F.array_join(F.transform("p", lambda x: x[text]), separator, "").alias("text"))


def structured_segments(elements: DataFrame, by: str, position: str, text: str, order: str | None = None) -> DataFrame:
    """Elements with separator, start, end and order: offsets in the text that joins them with blank lines.

    A blank line goes before an element with text if any text stands before it and does not end in one itself. Elements
    without text stand at the current end. order falls back to the place of the element, from 0. separator is what
    the element adds before its text.
    """
    place = Window.partitionBy(by).orderBy(position)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    out = elements.withColumn(text, F.coalesce(text, F.lit("")))
    last = F.last(F.when(F.col(text) != "", F.col(text)), ignorenulls=True).over(before)
    out = out.withColumn("separator", F.when((F.col(text) != "") & last.isNotNull() & ~F.endswith(last, F.lit("\n\n")), "\n\n").otherwise(""))
    ahead = F.coalesce(F.sum(F.length("separator") + F.length(text)).over(before), F.lit(0))
    out = out.withColumn("start", (ahead + F.length("separator")).cast("int")).withColumn("end", (F.col("start") + F.length(text)).cast("int"))
    fallback = F.row_number().over(place) - 1
    return out.withColumn("order", F.coalesce(F.col(order), fallback).cast("int") if order else fallback.cast("int"))


def joined_parts(parts: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """Segments of a document made of parts that are joined by line feeds: audio first, then frames.

    parts: by, part (their order), identity, modality, stamp, text. segments: by, part, number, text, start, end, element,
    parent, kind, t_start, t_end. A part without segments counts as one segment if it has text. Offsets move by what
    stands before the part, elements and parents get the part's identity before them, plain text takes the modality's kind,
    and segments of a frame take its time.
    """
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("shift", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))
    found = placed.withColumnRenamed("text", "part_text").join(segments.withColumn("__has", F.lit(True)), [by, "part"], "left")
    found = found.where(F.col("__has") | (F.length("part_text") > 0))
    whole = F.col("__has").isNull()
    own = lambda c, alone: F.when(whole, alone).otherwise(F.col(c))
    prefixed = lambda c: F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.concat_ws(":", "identity", c))
    visual = F.col("modality") == "visual"
    kind = F.coalesce(F.col("kind"), F.lit("text"))
    return found.select(
        by, "identity", "modality", (F.row_number().over(Window.partitionBy(by).orderBy("part", "number")) - 1).alias("order"), own("text", F.col("part_text")).alias("text"),
        (F.col("shift") + own("start", F.lit(0))).cast("int").alias("start"), (F.col("shift") + own("end", F.length("part_text"))).cast("int").alias("end"),
        prefixed("element").alias("element"), prefixed("parent").alias("parent"),
        F.when(kind != "text", kind).when(visual, "visual_text").otherwise("audio").alias("kind"),
        F.when(visual, F.col("stamp")).otherwise(F.col("t_start")).alias("t_start"), F.when(visual, F.col("stamp")).otherwise(F.col("t_end")).alias("t_end"),
        own("start", F.lit(0)).cast("int").alias("native_start"), own("end", F.length("part_text")).cast("int").alias("native_end"),
    )


def hierarchy_preservation(references: DataFrame, predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, eligible, preserved: references whose parent and level a matched prediction repeats.

    references: by, element, parent, level, with has_parent and has_level where they are annotated; predictions the same;
    matches: by, reference, prediction, at most one of each. A reference is eligible if either is annotated. Its parent is
    kept if both have none, or if its parent's match is its match's parent; the prediction must say so itself.
    """
    pairs = matches.select(by, F.col("reference").alias("element"), "prediction")
    eligible = references.where(F.col("has_parent") | F.col("has_level"))
    mapped = pairs.select(by, F.col("element").alias("parent"), F.col("prediction").alias("mapped"))
    other = predictions.select(by, F.col("element").alias("prediction"), F.col("parent").alias("p_parent"), F.col("level").alias("p_level"), F.col("has_parent").alias("p_has"))
    rows = eligible.join(pairs, [by, "element"], "left").join(other, [by, "prediction"], "left").join(mapped, [by, "parent"], "left")
    same = F.when(F.col("parent").isNull(), F.col("p_parent").isNull()).otherwise(F.coalesce(F.col("mapped") == F.col("p_parent"), F.lit(False)))
    parent = ~F.col("has_parent") | (F.coalesce("p_has", F.lit(False)) & same)
    level = ~F.col("has_level") | F.col("level").eqNullSafe(F.col("p_level"))
    good = F.col("prediction").isNotNull() & parent & level
    return rows.groupBy(by).agg(F.count("*").alias("eligible"), F.count_if(good).alias("preserved"))


def cycles(elements: DataFrame, by: str) -> DataFrame:
    """by, element, cycle: elements that are their own ancestors, and the smallest element of their cycle.

    elements: by, element, parent; elements are distinct within by. Pointers double their reach: after as many rounds as
    the largest document's size has bits, one that has not reached a root stands on a cycle, and every element of a
    cycle is reached. Each round is a join on (by, element), whatever the depth.
    """
    known = elements.select(by, "element")
    reach = elements.select(by, "element", F.col("parent").alias("to")).join(known.select(by, F.col("element").alias("to")), [by, "to"], "left_semi")
    reach = cut(reach.select(by, "element", "to", F.col("to").alias("low")))
    most = elements.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        further = reach.select(by, F.col("element").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        # What reaches a root leaves.
        reach = cut(reach.join(further, [by, "to"]).select(by, "element", F.col("next").alias("to"), F.least("low", "next_low").alias("low")))
    on = reach.select(by, F.col("to").alias("element")).distinct()
    return on.join(reach.select(by, "element", F.col("low").alias("cycle")), [by, "element"])


def annotation_problems(elements: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """by, element, problem of reference annotations: repeated elements or orders, unknown pages or parents, cycles.

    elements: by, element, order, page, parent; pages: by, page. One row for each element and problem.
    """
    said = lambda df, what: df.select(by, "element", F.lit(what).alias("problem")).distinct()
    twice = lambda c: F.count("*").over(Window.partitionBy(by, c)) > 1
    repeated = elements.withColumn("__n", twice("element")).where("__n")
    orders = elements.where(F.col("order").isNotNull()).withColumn("__n", twice("order")).where("__n")
    no_page = elements.where(F.col("page").isNotNull()).join(pages, [by, "page"], "left_anti")
    no_parent = elements.where(F.col("parent").isNotNull()).join(elements.select(by, F.col("element").alias("parent")), [by, "parent"], "left_anti")
    # A repeated element is looked at once, as its first row in order says.
    first = F.row_number().over(Window.partitionBy(by, "element").orderBy("order", "page", "parent")) == 1
    around = cycles(elements.withColumn("__first", first).where("__first").select(by, "element", "parent"), by)
    return said(repeated, "repeated element").unionByName(said(orders, "repeated order")).unionByName(said(no_page, "unknown page")).unionByName(said(no_parent, "unknown parent")).unionByName(said(around, "cycle"))


def page_scores(reference: DataFrame, predicted: DataFrame, by: str, least: float) -> DataFrame:
    """by, pages, content_f1, coverage: bags of tokens of pages against each other.

    reference and predicted: by, page, tokens (an array). Pages on either side count; a page that only one side has scores 0,
    two empty ones 1. coverage is the share of reference pages with tokens that score at least `least`.
    """
    bag = lambda df: df.select(by, "page", F.explode("tokens").alias("t")).groupBy(by, "page", "t").agg(F.count("*").alias("n"))
    common = bag(reference).join(bag(predicted).withColumnRenamed("n", "m"), [by, "page", "t"]).groupBy(by, "page").agg(F.sum(F.least("n", "m")).alias("common"))
    a = reference.select(by, "page", F.size("tokens").alias("a"))
    b = predicted.select(by, "page", F.size("tokens").alias("b"))
    both = a.join(b, [by, "page"], "full").join(common, [by, "page"], "left")
    f1 = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(tx.bag_f1(F.coalesce("common", F.lit(0)), F.col("b"), F.col("a")))
    scored = both.select(by, "page", "a", f1.alias("f1"))
    covered = F.count_if((F.col("a") > 0) & (F.col("f1") >= least)) / F.nullif(F.count_if(F.col("a") > 0), F.lit(0))
    return scored.groupBy(by).agg(F.count("*").alias("pages"), F.avg("f1").alias("content_f1"), covered.alias("coverage"))


def page_attribution(references: DataFrame, predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, expected, attributed: reference elements with a page, and those whose match is on the same page."""
    expected = references.where(F.col("page").isNotNull()).select(by, F.col("element").alias("reference"), "page")
    found = predictions.select(by, F.col("element").alias("prediction"), F.col("page").alias("p_page"))
    rows = expected.join(matches.select(by, "reference", "prediction"), [by, "reference"], "left").join(found, [by, "prediction"], "left")
    return rows.groupBy(by).agg(F.count("*").alias("expected"), F.count_if(F.col("page") == F.col("p_page")).alias("attributed"))


def kind_scores(references: DataFrame, predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, kind, expected, found, matched, precision, recall, f1, content_f1: detection and content of elements by kind.

    references and predictions: by, element, kind, tokens (an array); matches: by, reference, prediction, of one kind each and
    at most one of a reference and of a prediction. Content is the mean over references of the F1 of token bags, 0 where a
    reference has no match and 1 where both are empty; null without references. Rates are 0 wherever their denominator is.
    """
    known = matches.join(references.select(by, F.col("element").alias("reference"), "kind"), [by, "reference"])
    bag = lambda df, side: df.select(by, F.col("element").alias(side), F.explode("tokens").alias("t")).groupBy(by, side, "t").agg(F.count("*").alias(f"n_{side}"))
    shared = known.join(bag(references, "reference"), [by, "reference"]).join(bag(predictions, "prediction"), [by, "prediction", "t"])
    shared = shared.groupBy(by, "reference").agg(F.sum(F.least("n_reference", "n_prediction")).alias("common"))
    size = lambda df, side: df.select(by, F.col("element").alias(side), F.size("tokens").alias(f"s_{side}"))
    pairs = known.join(size(references, "reference"), [by, "reference"]).join(size(predictions, "prediction"), [by, "prediction"]).join(shared, [by, "reference"], "left")
    scored = pairs.groupBy(by, "kind").agg(F.count("*").alias("matched"), F.sum(tx.bag_f1(F.coalesce("common", F.lit(0)), F.col("s_prediction"), F.col("s_reference"))).alias("content"))
    count = lambda df, name: df.groupBy(by, "kind").agg(F.count("*").alias(name))
    rows = count(references, "expected").join(count(predictions, "found"), [by, "kind"], "full").join(scored, [by, "kind"], "left").fillna(0, ["expected", "found", "matched", "content"])
    precision, recall, f1 = tx.precision_recall_f1(F.col("matched"), F.col("found") - F.col("matched"), F.col("expected") - F.col("matched"))
    return rows.select(by, "kind", "expected", "found", "matched", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (F.col("content") / F.nullif(F.col("expected"), F.lit(0))).alias("content_f1"))

"""Attempts and what was measured of them: transcripts with timed segments, questions with repeated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def transcript_problems(predictions: DataFrame, segments: DataFrame, by: str, tolerance: float) -> DataFrame:
    """by, problem of predicted transcripts and their timed segments.

    predictions: by, transcript, duration; segments: by, number, text, start, end. Segments must not start before the one
    ahead of them (by number), nor end before they start or after the duration and `tolerance`; those with words, joined
    in order, must say what the transcript says once both are normalised (lower case, no punctuation, single blanks).
    """
    ahead = F.lag("start").over(Window.partitionBy(by).orderBy("number"))
    timed = segments.withColumn("__ahead", ahead).join(predictions.select(by, "duration"), by)
    spoken = segments.withColumn("__words", tx.prose(F.coalesce("text", F.lit("")))).where("__words <> ''")
    said = spoken.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "__words"))), lambda x: x["__words"]), " ").alias("__said"))
    both = predictions.select(by, tx.prose(F.coalesce("transcript", F.lit(""))).alias("__own")).join(said, by, "left")
    own, heard = F.col("__own"), F.col("__said")
    rules = [
        (timed, "unordered segments", F.col("start") < F.col("__ahead")), (timed, "segment ends before its start", F.col("end") < F.col("start")),
        (timed, "segment beyond the end", F.col("end") > F.col("duration") + tolerance), (both, "segments missing", (own != "") & heard.isNull()),
        (both, "segments without transcript", (own == "") & heard.isNotNull()), (both, "transcript contradicts segments", (own != "") & heard.isNotNull() & (own != heard)),
    ]
    out = None
    for rows, name, rule in rules:
        one = rows.where(rule).select(by, F.lit(name).alias("problem")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def timestamp_totals(references: DataFrame, predictions: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """by, references, aligned, error, boundaries: absolute errors of start and end over aligned segments.

    references and predictions: by, number, start, end; matches: by, reference, first, last, a reference segment and the run
    of predicted ones that it is aligned with. The run counts from its earliest start to its latest end; each match
    has two boundaries. Runs are joined to their segments by number, so a segment meets the runs that hold it alone.
    """
    runs = matches.withColumn("number", F.explode(F.sequence("first", "last")))
    held = runs.join(predictions.select(by, "number", F.col("start").alias("p_start"), F.col("end").alias("p_end")), [by, "number"])
    reach = held.groupBy(by, "reference").agg(F.min("p_start").alias("p_start"), F.max("p_end").alias("p_end"))
    rows = references.withColumnRenamed("number", "reference").join(reach, [by, "reference"], "left")
    error = F.abs(F.col("start") - F.col("p_start")) + F.abs(F.col("end") - F.col("p_end"))
    return rows.groupBy(by).agg(F.count("*").alias("references"), F.count("p_start").alias("aligned"), F.coalesce(F.sum(error), F.lit(0.0)).alias("error"), (2 * F.count("p_start")).alias("boundaries"))


def measurement_coverage(outcome: Column, events: Column, count: Column, ttft: Column, offset: Column, first: Column, last: Column, latency: Column, responded: Column) -> Column:
    """Which timings of an attempt are measured or rightly absent: decode, ttft, latency.

    events: seconds of tokens; an inventory has `count` finite ones in order. Decoding is covered if an attempt that completed
    has an inventory and, from two tokens on, first and last times that are its ends; the time to the first token if it
    equals the first event less the offset, or if no event is there and none is due; latency if a response has one.
    Attempts that were not executed cover nothing.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    inventory = sure((count >= 0) & (F.size(events) == count) & F.forall(events, fine) & (F.array_sort(events) == events))
    completed = outcome == "completed"
    begun = sure(F.size(events) > 0)
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    starts = F.when(begun, sure(fine(ttft) & near(ttft, F.get(events, F.lit(0)) - F.coalesce(offset, F.lit(0.0))))).otherwise(inventory | ~completed)
    ends = sure(fine(first) & fine(last) & (first == F.get(events, F.lit(0))) & (last == F.element_at(events, -1)))
    decode = ~completed | (inventory & ((count < 2) | F.when(count >= 2, ends).otherwise(F.lit(True))))
    executed = ~outcome.isin("not_executed", "missing_outcome", "infrastructure_error", "input_rejected")
    spent = ~responded | sure(fine(latency))
    return F.struct((executed & decode).alias("decode"), (executed & starts).alias("ttft"), (executed & spent).alias("latency"))


def question_statistics(cells: DataFrame, rates: list[str], by: str = "question") -> DataFrame:
    """by, metric, value, eligible, contributing, unavailable, claim_free, complete: what a question's attempts say of each metric.

    cells: by, metric, status, reason, value, a row an attempt. A cell is eligible unless it is inapplicable for another
    reason than that no claims were made. The value is the mean of what is defined; metrics in rates have none unless
    every scheduled cell is there, since their denominator may not shrink to attempts that survived.
    """
    s, reason = F.col("status"), F.col("reason")
    eligible = (s != "inapplicable") | F.coalesce(reason == "no_generated_claims", F.lit(False))
    gap = F.count_if(s == "incomplete") + F.count_if(eligible & (s == "unavailable"))
    rows = cells.groupBy(by, "metric").agg(
        F.avg("value").alias("mean"), F.count_if(eligible).alias("eligible"), F.count("value").alias("contributing"), F.count_if(eligible & s.isin("unavailable", "incomplete")).alias("unavailable"),
        F.count_if(F.coalesce(reason == "no_generated_claims", F.lit(False))).alias("claim_free"), gap.alias("gaps"),
    )
    value = F.when(~F.col("metric").isin(*rates) | (F.col("gaps") == 0), F.col("mean"))
    return rows.select(by, "metric", value.alias("value"), "eligible", "contributing", "unavailable", "claim_free", (F.col("gaps") == 0).alias("complete"))


#: The answer that states no facts, a fixed value.
REFUSAL = "The provided evidence is insufficient to answer the question."


def label_problems(claims: DataFrame, responses: DataFrame, by: str = "response") -> DataFrame:
    """by, id, problem of a judge's labels: a row for each claim and rule that it breaks.

    claims: by, id, text, spans (array of start, end), supported, cited_supported, correct, and the arrays support_sources,
    cited_sources, verification_sources and gold_matches; responses: by, answer, and the arrays blocks, citations, material
    and gold of what it may name. Ids and texts (in any case) are unique within a response; spans lie in the answer;
    sources are what the label may draw on, each named once; a positive label names a source; support by what is cited
    is support; gold matches are required facts, each named once, of correct claims; a refusal claims nothing.
    """
    rows = claims.join(responses, by)
    text = F.lower("text")
    twice = lambda c: F.count(c).over(Window.partitionBy(by, c)) > 1
    rows = rows.withColumn("__text", text).withColumn("__again", twice("id")).withColumn("__same", twice("__text"))
    blank = lambda c: F.coalesce(F.btrim(F.col(c)) == "", F.lit(True))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    strange = lambda named, known: (F.size(F.array_except(named, known)) > 0) | (F.size(F.array_distinct(named)) < F.size(named))
    support, cited, checked, gold = (listed(c) for c in ("support_sources", "cited_sources", "verification_sources", "gold_matches"))
    spans = F.col("spans")
    outside = F.exists(spans, lambda x: (x["start"] < 0) | (x["end"] <= x["start"]) | (x["end"] > F.length("answer")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = {
        "no id or text": blank("id") | blank("text"), "repeated claim": F.col("__again") | F.col("__same"), "no spans": F.coalesce(F.size(spans) < 1, F.lit(True)), "span outside the answer": F.coalesce(outside, F.lit(False)),
        "unknown support": strange(support, listed("blocks")), "unknown cited support": strange(cited, F.array_intersect(listed("blocks"), listed("citations"))), "unknown verification": strange(checked, listed("material")),
        "positive without source": (yes("supported") & (F.size(support) == 0)) | (yes("correct") & (F.size(checked) == 0)) | (yes("cited_supported") & (F.size(cited) == 0)),
        "cited support alone": yes("cited_supported") & ~yes("supported"), "gold match": (F.size(gold) > 0) & (strange(gold, listed("gold")) | ~yes("correct")), "claim of a refusal": F.coalesce(F.col("answer") == REFUSAL, F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(by, "id", F.explode(broken).alias("problem"))

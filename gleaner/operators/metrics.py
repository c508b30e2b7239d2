"""Ranking metrics, status algebra and aggregates over long-format ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORED, UNAVAILABLE, INCOMPLETE, INAPPLICABLE = "scored", "unavailable", "incomplete", "inapplicable"


def status(applicable: Column, complete: Column, value: Column) -> Column:
    """inapplicable before incomplete before unavailable before scored."""
    return F.when(~applicable, INAPPLICABLE).when(~complete, INCOMPLETE).when(value.isNull(), UNAVAILABLE).otherwise(SCORED)


def gains(ranking: DataFrame, covered: DataFrame) -> DataFrame:
    """question, chunk, rank, gain: the number of units that each ranked chunk covers."""
    n = covered.groupBy("question", "chunk").agg(F.count("*").alias("gain"))
    return ranking.join(n, ["question", "chunk"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))


def ndcg(ranking: DataFrame, covered: DataFrame, k: int) -> DataFrame:
    """question, ndcg at k with linear gains; the ideal takes the k largest gains over all chunks. 0 without an ideal."""
    discount = lambda r: F.log2(F.col(r) + 1)
    got = gains(ranking.where(F.col("rank") <= k), covered).groupBy("question").agg(F.sum(F.col("gain") / discount("rank")).alias("dcg"))
    best = covered.groupBy("question", "chunk").agg(F.count("*").alias("gain"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("gain"), "chunk"))).where(F.col("place") <= k)
    best = best.groupBy("question").agg(F.sum(F.col("gain") / discount("place")).alias("ideal"))
    return got.join(best, "question", "left").select("question", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def unit_recall(ranking: DataFrame, covered: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """question, recall: distinct covered units among the first k over all units of the question."""
    total = units.groupBy("question").agg(F.countDistinct("unit").alias("units"))
    hit = ranking.where(F.col("rank") <= k).join(covered, ["question", "chunk"]).groupBy("question").agg(F.countDistinct("unit").alias("hit"))
    return total.join(hit, "question", "left").select("question", (F.coalesce("hit", F.lit(0)) / F.col("units")).alias("recall"))


def pool_recall(pool: DataFrame, covered: DataFrame, units: DataFrame) -> DataFrame:
    """question, pool, units, found, recall, first_rank: distinct units that any chunk of a question's whole pool covers.

    Questions without evidence or without a pool have no row; one whose pool covers nothing has recall 0 and no rank.
    """
    total = units.groupBy("question").agg(F.countDistinct("unit").alias("units"))
    size = pool.groupBy("question").agg(F.count("*").alias("pool"))
    hit = pool.join(covered, ["question", "chunk"]).groupBy("question").agg(F.countDistinct("unit").alias("hit"), F.min("rank").alias("first_rank"))
    rows = total.join(size, "question").join(hit, "question", "left")
    return rows.select("question", "pool", "units", F.coalesce("hit", F.lit(0)).alias("found"), (F.coalesce("hit", F.lit(0)) / F.col("units")).alias("recall"), "first_rank")


def alpha_dcg(ranking: DataFrame, covered: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """question, alpha_dcg at k: a unit seen before in the ranking counts (1 - alpha) for each time."""
    seen = Window.partitionBy("question", "unit").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranking.where(F.col("rank") <= k).join(covered, ["question", "chunk"])
    rows = rows.withColumn("part", F.pow(F.lit(1 - alpha), F.count("*").over(seen)) / F.log2(F.col("rank") + 1))
    return ranking.select("question").distinct().join(rows.groupBy("question").agg(F.sum("part").alias("alpha_dcg")), "question", "left").fillna(0.0, ["alpha_dcg"])


def macro_mean(rows: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Mean over groups of the mean within each; nulls are skipped, groups without values too."""
    inner = rows.groupBy(*by, group).agg(F.avg(value).alias("inner"))
    return inner.groupBy(*by).agg(F.avg("inner").alias("macro"), F.count("inner").alias("groups"))


def publish(rows: DataFrame, by: list[str], value: str = "value", state: str = "status", policy: str = "complete") -> DataFrame:
    """Mean of scored values by the policy on missing data, with the counts behind it.

    complete: null unless every applicable row is scored; available: the mean of what there is; partial: likewise,
    flagged. The estimate is there in any case.
    """
    if policy not in ("complete", "available", "partial"):
        raise ValueError(f"unknown policy {policy!r}")
    counts = [F.count_if(F.col(state) == s).alias(s) for s in (SCORED, UNAVAILABLE, INCOMPLETE, INAPPLICABLE)]
    out = rows.groupBy(*by).agg(*counts, F.avg(F.when(F.col(state) == SCORED, F.col(value))).alias("estimate"))
    whole = (F.col(UNAVAILABLE) + F.col(INCOMPLETE) == 0) & (F.col(SCORED) > 0)
    out = out.withColumn("published", F.when(whole, F.col("estimate")) if policy == "complete" else F.col("estimate"))
    return out.withColumn("partial", ~whole) if policy == "partial" else out


def agreement(rows: DataFrame, by: list[str], repetition: str, outcome: str, valid: str) -> DataFrame:
    """by..., pairs, agreement: share of pairs of repetitions with equal valid outcomes; a failed one disagrees."""
    a = rows.select(*by, F.col(repetition).alias("r1"), F.col(outcome).alias("o1"), F.col(valid).alias("v1"))
    b = rows.select(*by, F.col(repetition).alias("r2"), F.col(outcome).alias("o2"), F.col(valid).alias("v2"))
    same = (F.col("v1") & F.col("v2") & (F.col("o1") == F.col("o2"))).cast("double")
    return a.join(b, by).where("r1 < r2").groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(same).alias("agreement"))


def percentiles(value: str, *points: float) -> list[Column]:
    """Exact percentiles with linear interpolation, as p50, p95, ..."""
    return [F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in points]


def sliced_aggregate(rows: DataFrame, slices: dict[str, Column], group: str, metric: str, value: str, weight: str | None = None) -> DataFrame:
    """slice, metric, observations, groups, macro, pooled, p50, p95: a ledger's metrics overall and by slice.

    A row counts in the slice 'overall' and under 'name:value' for each of slices (name -> column) that is not null for it; a
    column of arrays puts it into several. macro is the mean over groups of the mean within each, pooled the mean over
    observations, weighted if a weight is named; percentiles are over observations. Rows without a value count nowhere.
    """
    known = rows.where(F.col(value).isNotNull())
    kinds = {name: known.select(c.alias("c")).schema["c"].dataType.typeName() for name, c in slices.items()}
    each = [F.transform(c if kinds[name] == "array" else F.array(c), _label(name)) for name, c in slices.items()]
    named = F.array_distinct(F.concat(F.array(F.lit("overall")), *[F.filter(F.coalesce(e, F.array().cast("array<string>")), lambda x: x.isNotNull()) for e in each]))
    out = known.withColumn("slice", F.explode(named))
    by = ["slice", F.col(metric).alias("metric")]
    size = F.col(weight) if weight else F.lit(1.0)
    inner = out.groupBy(*by, group).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.sum(F.col(value) * size).alias("top"), F.sum(size).alias("bottom"))
    found = inner.groupBy("slice", "metric").agg(F.sum("n").alias("observations"), F.count("*").alias("groups"), F.avg("m").alias("macro"), (F.sum("top") / F.nullif(F.sum("bottom"), F.lit(0))).alias("pooled"))
    tails = exact_percentiles(out.select("slice", F.col(metric).alias("metric"), F.col(value).alias("v")), ["slice", "metric"], "v", 0.5, 0.95).drop("n")
    return found.join(tails, ["slice", "metric"])


def _label(name: str) -> Callable[[Column], Column]:
    return lambda x: _labelled(name, x)


def _labelled(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat_ws(":", F.lit(name), value.cast("string")))


def descriptor(rows: DataFrame, expected: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., status, complete, eligible, contributing, unavailable, mean, p95 of a measure against what was scheduled.

    expected: by..., expected, the number of observations that should be there; rows: those that are, null where nothing was
    measured. scored if all are there, inapplicable if none is due, unavailable if none is there, else incomplete. Mean
    and percentile are those of what there is, whatever the status.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__k"), F.avg(value).alias("mean"))
    tail = exact_percentiles(rows, by, value, 0.95).drop("n")
    out = expected.join(known, by, "left").join(tail, by, "left").withColumn("__k", F.coalesce("__k", F.lit(0)))
    due, k = F.col("expected"), F.col("__k")
    state = F.when((due > 0) & (k == due), SCORED).when(due == 0, INAPPLICABLE).when(k == 0, UNAVAILABLE).otherwise(INCOMPLETE)
    return out.select(*by, state.alias("status"), ((due > 0) & (k == due)).alias("complete"), due.alias("eligible"), k.alias("contributing"), (due - k).alias("unavailable"), "mean", "p95")


def violation_rate(hits: DataFrame, by: list[str], violates: Column) -> DataFrame:
    """by..., hits, violations, rate: the share of hits that a filter should have kept out; null where there are no hits."""
    rows = hits.groupBy(*by).agg(F.count("*").alias("hits"), F.count_if(violates).alias("violations"))
    return rows.withColumn("rate", F.col("violations") / F.nullif(F.col("hits"), F.lit(0)))


#: Distinct values of a range, about.
RANGE_VALUES = 50_000


def exact_percentiles(rows: DataFrame, by: list[str], value: str, *points: float) -> DataFrame:
    """by..., n, p50, p95, ...: exact percentiles with linear interpolation of groups of any size, with bounded state.

    Equal values are counted first. Groups of many distinct values are cut into ranges by approximate percentiles, which
    deal the work and change no result; running totals over ranges tell which of them hold the wanted ranks, and
    only those are ordered. Null values do not count; groups without values, or with a null key, have no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    most = counted.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = max(1, -(-most // RANGE_VALUES))
    if ranges > 1:
        edges = counted.groupBy(*by).agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)]).alias("__e"))
        counted = counted.join(edges, by).withColumn("__range", F.size(F.filter("__e", lambda e: e < F.col("__v")))).drop("__e")
    else:
        counted = counted.withColumn("__range", F.lit(0))
    group = Window.partitionBy(*by)
    each = counted.groupBy(*by, "__range").agg(F.sum("__c").alias("__k"))  # as many rows a group as it has ranges
    each = each.withColumn("n", F.sum("__k").over(group)).withColumn("__ahead", F.sum("__k").over(group.orderBy("__range")) - F.col("__k"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    low, high = [F.floor(place(p)) for p in points], [F.ceil(place(p)) for p in points]
    holds = lambda rank: (rank >= F.col("__ahead")) & (rank < F.col("__ahead") + F.col("__k"))
    any_ = F.lit(False)
    for rank in (*low, *high):
        any_ = any_ | holds(rank)
    some = counted.join(each.where(any_), [*by, "__range"])
    upto = F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v"))
    some = some.withColumn("__end", F.col("__ahead") + upto).withColumn("__start", F.col("__end") - F.col("__c"))
    at = lambda rank: F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), F.col("__v")))
    found = some.groupBy(*by, "n").agg(*[x for i, (a, b) in enumerate(zip(low, high, strict=True)) for x in (at(a).alias(f"__a{i}"), at(b).alias(f"__b{i}"))])
    name = lambda p: f"p{round(100 * p)}"
    return found.select(*by, "n", *[(F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (place(p) - F.floor(place(p)))).alias(name(p)) for i, p in enumerate(points)])


def iou(a: list[str], b: list[str]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2; 0 if the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (F.col(x[2]) - F.col(x[0])) * (F.col(x[3]) - F.col(x[1]))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))

"""Clustered bootstrap, paired comparisons, stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resampling import bootstrap_ratios


def bootstrap_mean(rows: DataFrame, value: str, group: str, by: list[str], resamples: int = 10_000, seed: int = 42, confidence: float = 0.95, least_groups: int = 2, size: str | None = None) -> DataFrame:
    """by..., estimate, low, high, groups, reason: interval of the macro mean by drawing groups with replacement.

    Groups are reduced to their mean first; see resampling.bootstrap_ratios for the draws and the reasons to withhold an
    interval. size: groups count by the sum of this column over their rows with a value, instead of equally.
    """
    counted = F.sum(F.when(F.col(value).isNotNull(), F.col(size))) if size else F.lit(1.0)
    inner = rows.groupBy(*by, group).agg(F.avg(value).alias("m"), counted.alias("z")).where("m is not null")
    found = bootstrap_ratios(inner, group, {"mean": (F.col("m") * F.col("z"), F.col("z"))}, by, None, resamples, seed, confidence, least_groups, "__metric")
    return found.select(*by, "estimate", "low", "high", F.col("sources").alias("groups"), "reason")


def paired_interval(rows: DataFrame, candidate: str, sample: str, value: str, group: str, resamples: int = 10_000, seed: int = 42, confidence: float = 0.95, least_groups: int = 2) -> DataFrame:
    """left, right, estimate, low, high, groups, reason: interval of the mean difference over samples of both, left < right.

    Groups of samples are drawn with replacement and count by their number of paired samples. A sample belongs to the
    group of its left row; candidates are few, a row of the result for each pair of them.
    """
    # A sample's rows, one a candidate, are brought together once; a self-join would make and exchange them twice.
    known = rows.where(F.col(value).isNotNull() & F.col(sample).isNotNull())
    each = known.groupBy(sample).agg(F.collect_list(F.struct(F.col(candidate).alias("c"), F.col(group).alias("g"), F.col(value).alias("v"))).alias("r"))
    pair = lambda x, y: F.struct(x["c"].alias("left"), y["c"].alias("right"), x["g"].alias("g"), (x["v"] - y["v"]).alias("d"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: x["c"] < y["c"]), lambda y: pair(x, y))))
    pairs = each.where(F.size("r") > 1).select(F.explode(pairs).alias("p")).select("p.*", F.lit(1.0).alias("one"))
    return bootstrap_mean(pairs, "d", "g", ["left", "right"], resamples, seed, confidence, least_groups, size="one")


def paired_means(rows: DataFrame, candidate: str, sample: str, value: str) -> DataFrame:
    """left, right, n, delta: mean difference over samples that both candidates have, for left < right."""
    a = rows.where(F.col(value).isNotNull()).select(F.col(candidate).alias("left"), sample, F.col(value).alias("x"))
    b = rows.where(F.col(value).isNotNull()).select(F.col(candidate).alias("right"), sample, F.col(value).alias("y"))
    pairs = a.join(b, sample).where(F.col("left") < F.col("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("delta"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, count: int, seed: str) -> DataFrame:
    """count rows, drawn in turn from each stratum in order of a seeded hash of the key."""
    draw = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("draw", key))
    # A row can only be drawn in one of the first `count` turns, so the final order sees count rows a stratum at most.
    turns = rows.withColumn("draw", draw).withColumn("turn", turn).where(F.col("turn") <= count)
    return turns.orderBy("turn", stratum).limit(count).drop("draw", "turn")

"""Ledgers against each other: pools, rankings, attempts and schedules. Rows of problems come out, no lists are collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, by: list[str], rank: str = "rank", item: str = "item") -> DataFrame:
    """by..., n, kinds, bag, ordered: of the items of each ranking, whatever their number.

    bag is the same for the same items as often, in any order; ordered for the same items at the same ranks. Both are sums of
    two 64-bit hashes each, so that they are built by partial aggregation.
    """
    total = lambda *c: F.concat_ws(":", *[F.sum(F.xxhash64(F.lit(seed), *c).cast("decimal(38,0)")).cast("string") for seed in (1, 2)])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(item).alias("kinds"), total(item).alias("bag"), total(rank, item).alias("ordered"))


def _said(df: DataFrame, by: list[str], what: str) -> DataFrame:
    return df.select(*by, F.lit(what).alias("problem")).distinct()


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pool_violations(pool: DataFrame, questions: DataFrame, known: DataFrame) -> DataFrame:
    """question, problem of a frozen pool: questions without a pool or not asked, unknown or repeated items, ranks that are
    not 1 to n, a wrong size.

    pool: question, rank, item; questions: question, size (of its pool); known: item.
    """
    counts = pool.groupBy("question").agg(F.count("*").alias("n"), F.countDistinct("item").alias("kinds"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    ranks = (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n"))
    return _all([
        _said(questions.join(pool, "question", "left_anti"), ["question"], "no pool"),
        _said(pool.join(questions, "question", "left_anti"), ["question"], "not asked"),
        _said(pool.join(known, "item", "left_anti"), ["question"], "unknown item"),
        _said(counts.where("kinds < n"), ["question"], "repeated item"),
        _said(counts.where(F.coalesce(ranks, F.lit(True))), ["question"], "ranks"),
        _said(counts.join(questions, "question").where("n <> size"), ["question"], "size"),
    ])


def pool_differences(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """question, first_rank, same_items: pools that are not equal rank by rank, where they first differ, and whether they hold
    the same items. Both: question, rank, item.

    Fingerprints find the questions; only theirs are compared rank by rank.
    """
    mine = fingerprints(observed, ["question"]).select("question", F.col("ordered").alias("o1"), F.col("bag").alias("b1"))
    theirs = fingerprints(expected, ["question"]).select("question", F.col("ordered").alias("o2"), F.col("bag").alias("b2"))
    other = mine.join(theirs, "question", "full").where(~F.col("o1").eqNullSafe(F.col("o2"))).select("question", F.col("b1").eqNullSafe(F.col("b2")).alias("same_items"))
    left = observed.join(other, "question", "left_semi").select("question", "rank", F.col("item").alias("x"), F.lit(True).alias("here"))
    right = expected.join(other, "question", "left_semi").select("question", "rank", F.col("item").alias("y"), F.lit(True).alias("there"))
    apart = left.join(right, ["question", "rank"], "full").where(F.col("here").isNull() | F.col("there").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return apart.groupBy("question").agg(F.min("rank").alias("first_rank")).join(other, "question")


def ranking_problems(requests: DataFrame, rankings: DataFrame, pools: DataFrame, ranked: DataFrame, schedule: DataFrame, allowed: DataFrame, size: int) -> DataFrame:
    """query, attempt, problem of saved retrieval runs, found without running them again.

    requests and rankings: query, attempt, status, latency, the ledgers of both stages; pools and ranked: query, attempt,
    rank, item, what the first stage found and how it was reordered; schedule: query, attempt; allowed: item. Problems:
    attempts that are missing, repeated or not scheduled in either ledger; ledgers that disagree; success without a pool; a
    pool of another size than `size` or all that is allowed, with repeated or forbidden items; an order that is no
    permutation of its pool.
    """
    by = ["query", "attempt"]
    out = []
    for ledger, name in ((requests, "request"), (rankings, "ranking")):
        out.append(_said(schedule.join(ledger, by, "left_anti"), by, f"{name} missing"))
        out.append(_said(ledger.groupBy(*by).count().where("count > 1"), by, f"{name} repeated"))
        out.append(_said(ledger.join(schedule, by, "left_anti"), by, f"{name} not scheduled"))
    b = rankings.select(*by, F.col("status").alias("s2"), F.col("latency").alias("l2"))
    out.append(_said(requests.join(b, by).where(~(F.col("status").eqNullSafe(F.col("s2")) & F.col("latency").eqNullSafe(F.col("l2")))), by, "ledgers disagree"))
    found = fingerprints(pools, by).select(*by, "n", "kinds", "bag")
    order = fingerprints(ranked, by).select(*by, F.col("n").alias("n_ranked"), F.col("bag").alias("ranked_bag"))
    out.append(_said(rankings.where("status = 'success'").unionByName(ranked.select(*by).distinct(), allowMissingColumns=True).join(found, by, "left_anti"), by, "no pool"))
    n_allowed = allowed.agg(F.least(F.lit(size), F.countDistinct("item")).alias("due"))  # one row
    out.append(_said(found.join(F.broadcast(n_allowed)).where("n <> due"), by, "pool size"))
    out.append(_said(found.where("kinds < n"), by, "repeated item"))
    out.append(_said(pools.join(allowed, "item", "left_anti"), by, "forbidden item"))
    out.append(_said(found.join(order, by).where("bag <> ranked_bag"), by, "no permutation"))
    return _all(out)


def paired_operational(left: DataFrame, right: DataFrame, schedule: DataFrame, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """condition, scheduled, complete, error_rate, p50, p95, reason: left less right, over whole schedules only.

    left and right: condition, slot, source_group, status, latency; schedule: condition, slot. Ledgers are aligned with the
    schedule by full outer joins before anything is subtracted: a slot that either side lacks, repeats, adds or did not
    execute leaves the condition without differences, and reason names the first such fault. Both sides of a slot must
    be of one source group. Requests that failed count for the error rate and have no latency.
    """

    def side(ledger: DataFrame, name: str) -> DataFrame:
        s = F.col("status")
        return ledger.groupBy("condition", "slot").agg(
            F.count("*").alias(f"{name}_n"), F.count_if(s == "not_executed").alias(f"{name}_idle"), F.count_if(s == "failed").alias(f"{name}_failed"),
            F.min("source_group").alias(f"{name}_group"), F.max(F.when(s == "success", F.col("latency"))).alias(f"{name}_latency"),
        )

    planned = schedule.select("condition", "slot").distinct().withColumn("planned", F.lit(True))
    rows = planned.join(side(left, "l"), ["condition", "slot"], "full").join(side(right, "r"), ["condition", "slot"], "full")
    none = F.col("l_n").isNull() | F.col("r_n").isNull()
    faults = {
        "not scheduled": F.col("planned").isNull(), "missing": none, "repeated": (F.col("l_n") > 1) | (F.col("r_n") > 1), "not executed": (F.col("l_idle") > 0) | (F.col("r_idle") > 0),
        "source groups differ": ~F.col("l_group").eqNullSafe(F.col("r_group")) & ~none,
    }
    fault = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f"{i}:{name}")) for i, (name, c) in enumerate(faults.items())])
    difference = [(F.percentile("l_latency", F.lit(p)) - F.percentile("r_latency", F.lit(p))).alias(f"p{round(100 * p)}") for p in points]
    rate = F.sum("l_failed") / F.nullif(F.sum("l_n"), F.lit(0)) - F.sum("r_failed") / F.nullif(F.sum("r_n"), F.lit(0))
    out = rows.withColumn("fault", fault).groupBy("condition").agg(F.count_if("planned").alias("scheduled"), F.min("fault").alias("fault"), rate.alias("error_rate"), *difference)
    whole = F.col("fault").isNull()
    kept: list[Column] = [F.when(whole, F.col(c)).alias(c) for c in ("error_rate", *(f"p{round(100 * p)}" for p in points))]
    return out.select("condition", "scheduled", whole.alias("complete"), *kept, F.element_at(F.split("fault", ":"), -1).alias("reason"))


def ranked_items(rows: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by..., rank, item in order from 1."""
    return rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank"), F.col(item).alias("item"))


def workload_problems(vectors: DataFrame, queries: DataFrame, dimension: int) -> DataFrame:
    """kind (record or query), id, problem of a vector workload, before anything is searched.

    vectors: id, vector; queries: id, vector, target (the record that a query was made from, or null). Vectors need the
    dimension, finite entries and a length above 0; ids must be there and be unique within their kind; targets must be
    records. One row for each id and problem; all rules but the last two are one pass without an exchange.
    """
    both = vectors.select(F.lit("record").alias("kind"), "id", "vector").unionByName(queries.select(F.lit("query").alias("kind"), "id", "vector"))
    v = F.col("vector")
    sure = lambda c: F.coalesce(c, F.lit(False))
    finite = sure(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rules = {
        "no id": F.col("id").isNull(), "no vector": v.isNull(), "dimension": sure(F.size(v) != dimension) & v.isNotNull(), "not finite": v.isNotNull() & ~finite,
        "zero vector": finite & (F.size(v) > 0) & sure(F.forall(v, lambda x: x == 0)),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = both.select("kind", "id", F.explode(broken).alias("problem")).distinct()
    repeated = both.where("id IS NOT NULL").groupBy("kind", "id").count().where("count > 1")
    lost = queries.where("target IS NOT NULL").join(vectors.select(F.col("id").alias("target")), "target", "left_anti")
    return rows.unionByName(_said(repeated, ["kind", "id"], "repeated id")).unionByName(_said(lost.withColumn("kind", F.lit("query")), ["kind", "id"], "unknown target"))

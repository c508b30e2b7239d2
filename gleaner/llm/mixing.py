"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialise

#: No document is taken more than so often.
MOST_COPIES = 2
#: The documents of one source and size are dealt into so many parts by a hash of the key, so none holds them all.
SALTS = 1024
#: Up to so many (source, size) groups the documents meet their rates by a broadcast; beyond, by a salted join.
BROADCAST_GROUPS = 100_000


def word_count(text):
    """Number of words of a text; null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """Targets of sources (source, source_size): by weight, at most MOST_COPIES times the source's size.

    Weights repeat over sources by code point, null last. What a cap leaves over goes to the others by weight, which
    ends at target = min(cap, weight * level): the level follows from a running sum over sources by cap / weight.
    One row a source, so the two windows without partitions hold a row a source.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    one = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("weight", F.element_at(weight, (F.col("place") % len(weights)).cast("int") + 1))
    one = one.withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("total", F.sum("source_size").over(every) * share).withColumn("all_w", F.sum("weight").over(every))
    one = one.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
    one = one.withColumn("w_before", F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    # The level if all sources before this one are capped and none from here on; the first that fits is the level.
    one = one.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))
    one = one.withColumn("level", F.min(fits).over(every)["level"])
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return one.select("source", "source_size", target.alias("target"))


def balance(groups: DataFrame, targets: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Rates of (source, size, n) groups: size, n and the rate that meets the source's target.

    Minimises the entropy of the rates within [0, MOST_COPIES] under one token constraint a source. The dual is
    convex with the solution rate = 2 / (1 + exp(-lambda * size / mean size)): an exponential tilt that saturates.
    Each round is one Newton step for every source at once on logit(words taken / words possible), kept in the
    bracket of earlier steps; a miss of over a millionth after the last is an error. The state has one row a source and
    is written after every round. The sums are over groups, that is over counts of documents of equal source and size, not over documents.
    """
    cap = float(MOST_COPIES)
    live = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    groups = groups.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, groups.source.eqNullSafe(targets.source)).select(
        groups.source, "size", "n", "target", "source_size",
        F.coalesce(F.col("size") * F.col("n_docs") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("x"),
    )
    groups = materialise(groups, "mix-groups")
    inf = float("inf")
    state = targets.where(live).select("source", "target", "source_size", F.lit(0.0).alias("tilt"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(inf).alias("off"))
    for _ in range(rounds):
        tilted = groups.join(state.select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s")))
        z = F.least(F.greatest(F.col("tilt") * F.col("x"), F.lit(-700.0)), F.lit(700.0))
        p = 1 / (1 + F.exp(-z))
        words = F.col("n") * F.col("size")
        sums = tilted.groupBy("s").agg(F.sum(words * p * cap).alias("f"), F.sum(words * cap * F.col("x") * p * (1 - p)).alias("slope"))
        most = F.col("source_size") * cap
        part, goal = F.col("f") / most, F.col("target") / most
        low, high = F.when(F.col("f") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("f") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        odds = lambda share: F.ln(F.try_divide(share, 1 - share))
        step = F.try_divide((odds(goal) - odds(part)) * F.col("f") * (1 - part), F.col("slope"))
        guess = F.col("tilt") + F.coalesce(step, F.lit(0.0))
        inside = F.when((guess > F.col("low")) & (guess < F.col("high")), guess).when(
            (F.col("low") > -inf) & (F.col("high") < inf), (F.col("low") + F.col("high")) / 2
        ).when(F.col("low") > -inf, F.abs("low") * 2 + 1).otherwise(-F.abs("high") * 2 - 1)
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("low", low).withColumn("high", high)
        off = F.abs(F.col("f") - F.col("target")) / F.col("target")
        state = state.select("source", "target", "source_size", F.when(off <= tolerance, F.col("tilt")).otherwise(inside).alias("tilt"), F.col("low").alias("lo"), F.col("high").alias("hi"), off.alias("off"))
        state = materialise(state, "mix-tilt")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        if worst > 1e-6:
            raise RuntimeError(f"the rates miss a target by {worst:.2g} of it after {rounds} rounds")
    found = state.select(F.col("source").alias("s"), "tilt")
    z = F.least(F.greatest(F.col("tilt") * F.col("x"), F.lit(-700.0)), F.lit(700.0))
    rate = F.when(F.col("tilt").isNotNull(), cap / (1 + F.exp(-z))).when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    return groups.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", "n", "target", "source_size", rate.alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Give every document its number of copies (0 to 2) in a mix of sources at target weights.

    Adds size (words), source_size, target (of its source), rate and copies to the rows of docs. Null text: size 0;
    null source: a source of its own, last. Documents without words are not taken (copies 0). Repeated rows are
    documents of their own; rows of equal key get the same chance. An empty table gives an empty result. Columns of
    docs with the added names are replaced. The same rows give the same result, in whatever order they are read.

    Rounding: documents of equal source and size form a group of one rate. Over groups by falling size, a running
    sum of the rates' fractions tells how many documents of each group get the extra copy, so that a source misses
    its target by at most half its largest document; within a group these are the documents with the smallest hashes
    of their key. Each group's hash at the cut is found on rows of (source, size, hash) alone: counts of SALTS ranges
    of hashes tell the range of the cut, and only that range is ordered. Texts are not exchanged, unless there are more
    than BROADCAST_GROUPS groups. A source without words has the target 0 and no copies.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*[c for c in added if c in docs.columns])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key)), 1)
    sized = docs.withColumn("size", word_count(F.col(text))).withColumn("__draw", draw)
    salt = F.floor(F.col("__draw") / F.lit((1 << 63) // SALTS)).cast("int")
    drawn = materialise(sized.select(F.col(source).alias("source"), "size", "__draw").withColumn("salt", salt), "mix-draws")
    salted = materialise(drawn.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-sizes")
    groups = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = materialise(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), "mix-sources")
    targets = materialise(source_targets(sources.drop("n_docs"), weights, share), "mix-targets")
    counted = groups.join(sources.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rates = balance(counted, targets)
    frac = F.col("rate") - F.floor("rate")
    by_size = Window.partitionBy("source").orderBy(F.desc("size"))
    rates = rates.withColumn("run", F.sum(frac * F.col("n")).over(by_size))
    extra = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - frac * F.col("n") + 0.5)
    rates = rates.withColumn("extra", F.least(extra, F.col("n"))).drop("n", "run").withColumnsRenamed({"source": "s", "size": "z"})
    rates = materialise(rates, "mix-rates")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    # The range of hashes in which a group's cut lies, and how many documents of that range get the extra copy.
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt"))
    ranges = salted.join(rates.where("extra > 0").select("s", "z", "extra"), same).withColumn("upto", upto)
    need = (F.col("extra") - (F.col("upto") - F.col("n"))).alias("need")
    ranges = ranges.where("upto >= extra and upto - n < extra").select("s", "z", F.col("salt").alias("at"), need)
    near = drawn.join(ranges, same & (F.col("salt") == F.col("at"))).groupBy("s", "z", "need", "__draw").agg(F.count("*").alias("ties"))
    near = near.withColumn("run", F.sum("ties").over(Window.partitionBy("s", "z").orderBy("__draw")))
    cuts = near.where("run >= need and run - ties < need").select(F.col("s").alias("c_s"), F.col("z").alias("c_z"), F.col("__draw").alias("cut"), "ties", (F.col("need") - F.col("run") + F.col("ties")).alias("take"))
    rated = rates.join(cuts, F.col("s").eqNullSafe(F.col("c_s")) & (F.col("z") == F.col("c_z")), "left")
    names = ["source_size", "target", "rate", "cut", "ties", "take"]
    rated = materialise(rated.select(F.col("s").alias("__source"), F.col("z").alias("__size"), *[F.col(c).alias(f"__{c}") for c in names]), "mix-cuts")
    mine = F.col(source).eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
    if rated.count() <= BROADCAST_GROUPS:
        found = sized.join(F.broadcast(rated), mine)
    else:
        spread = salted.join(rated, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))).select(*rated.columns, F.col("salt").alias("__at"))
        found = sized.withColumn("__salt", salt).join(spread, mine & (F.col("__salt") == F.col("__at")))
    below, tied = F.col("__draw") < F.col("__cut"), F.col("__draw") == F.col("__cut")
    more = F.when(F.col("__cut").isNull(), F.lit(0)).when(below | tied, F.lit(1)).otherwise(F.lit(0))
    if rated.where("__ties > __take").limit(1).count():
        # Rows of one key at a cut, of which only some get the copy: the first by a hash of their text.
        part = tied & (F.col("__ties") > F.col("__take"))
        place = F.row_number().over(Window.partitionBy("__source", "__size").orderBy(F.xxhash64(F.col(text))))
        some = found.where(part).withColumn("__more", (place <= F.col("__take")).cast("int"))
        found = found.where(~F.coalesce(part, F.lit(False))).withColumn("__more", more).unionByName(some)
    else:
        found = found.withColumn("__more", more)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor("__rate") + F.col("__more")).cast("int")
    return found.select(*docs.columns, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__rate").alias("rate"), copies.alias("copies"))

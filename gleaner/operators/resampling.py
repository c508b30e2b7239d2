"""Bootstrap by sources: multinomial draws that tasks make independently, ratios and percentiles over drawn copies.

Sources of a stratum are drawn with replacement, as many as it has. They are dealt to blocks by hash; how many of a
resample's draws fall into a block comes from halving the blocks, each half getting a binomial share that a generator
keyed by (seed, stratum, half) gives. So every task knows its block's share without seeing the others, shares add up
exactly, and a lost task draws the same again. Within its block a task draws a multinomial. All metrics of a source,
and both sides of a pair, see the same draw. Ratios only need the sums of what is drawn: sources of a large stratum that
agree in all their sums are one row there, drawn by its number of sources, which has the same distribution.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.scratch import written

#: Sources of a block, about; resamples that a task draws at a time; values of a narrow range, about.
BLOCK_SOURCES, STEP, GROUP_ROWS = 2048, 256, 512
#: Strata of more sources have equal ones drawn as one row; draws that are summed at a time; what a binomial costs in draws.
LARGE_SOURCES, STEP_DRAWS, BINOMIAL_DRAWS = 1 << 16, 1 << 18, 8
#: Ranges that are looked into are broadcast up to this number, and lists of their ends up to that one.
ASKED_ROWS, EDGE_ROWS = 100_000, 2_000
#: Narrow ranges on each side of a percentile; weights that are looked up in a range, at most, where it can be cut.
NARROW, WIDE = 16, 1 << 24
#: Blocks of a team, at most; teams that a stratum has before they grow.
TEAM_BLOCKS, TEAMS = 16, 32


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))


def block_draws(sizes: np.ndarray, block: int, resamples: int, seed: int, group: int) -> np.ndarray:
    """Of each resample's sum(sizes) draws, how many fall into a block; the number of blocks is a power of two."""
    n = np.full(resamples, int(sizes.sum()), np.int64)
    first, last = 0, len(sizes)
    while last - first > 1:
        middle = (first + last) // 2
        left, both = int(sizes[first:middle].sum()), int(sizes[first:last].sum())
        drawn = _generator(seed, group, first, last).binomial(n, left / both) if both else n * 0
        if block < middle:
            n, last = drawn, middle
        else:
            n, first = n - drawn, middle
    return n


def source_draws(n: np.ndarray, sources: int, block: int, seed: int, group: int) -> Iterator[np.ndarray]:
    """[resample, source] counts of the n draws of a block, STEP resamples at a time."""
    made = _generator(seed, group, block)
    for a in range(0, len(n), STEP):
        some = n[a : a + STEP]
        row = np.repeat(np.arange(len(some)), some)
        yield np.bincount(row * sources + made.integers(0, sources, len(row)), minlength=len(some) * sources).reshape(-1, sources)


def drawn_sums(n: np.ndarray, values: np.ndarray, times: np.ndarray, block: int, seed: int, group: int) -> np.ndarray:
    """[resample, column] sums of values [row, column] over the n draws of a block; a row stands for as many sources as `times` says.

    Where each row is one source, the draws are those of source_draws. Where rows are few for the draws, a multinomial
    over the rows takes their place.
    """
    made, out = _generator(seed, group, block), np.zeros((len(n), values.shape[1]))
    sources = int(times.sum())
    if len(times) * BINOMIAL_DRAWS < sources:
        for a in range(0, len(n), STEP):
            out[a : a + STEP] = made.multinomial(n[a : a + STEP], times / sources) @ values
        return out
    each = [np.ascontiguousarray(c) for c in np.repeat(values, times, axis=0).T]
    upto = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP_DRAWS, "right")))
        some = np.flatnonzero(n[a:b]) + a
        if len(some):
            drawn = made.integers(0, sources, int(n[a:b].sum()))
            first = np.cumsum(n[some]) - n[some]
            for i, c in enumerate(each):
                out[some, i] = np.add.reduceat(c.take(drawn, mode="clip"), first)
        a = b
    return out


def _alike(units: DataFrame, keys: list[str], source: str, columns: list[str]) -> DataFrame:
    """units with their number of sources, __m; those of a large stratum that agree in all columns are one row, of the smallest source."""
    keyed = units.withColumn("__group", F.xxhash64(*keys, "__stratum"))
    known = keyed.join(keyed.groupBy("__group").agg((F.count("*") > LARGE_SOURCES).alias("__large")), "__group")
    own = F.when(~F.col("__large"), F.col(source)).alias("__own")
    return known.groupBy(*keys, "__stratum", *columns, own).agg(F.min(source).alias(source), F.count("*").alias("__m")).drop("__own")


def _blocks(units: DataFrame, by: list[str], source: str) -> DataFrame:
    """units (by..., source, stratum, ...; one row a source) with group, block, and the sizes of all blocks of the stratum."""
    keyed = units.withColumn("__group", F.xxhash64(*by, "__stratum"))
    sizes = keyed.groupBy("__group").agg(F.count("*").alias("n"))
    # The smallest power of two that gives blocks of at most BLOCK_SOURCES on average.
    sizes = sizes.select("__group", F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK_SOURCES)))).cast("int").alias("blocks"))
    return keyed.join(sizes, "__group").withColumn("__block", F.pmod(F.xxhash64(F.lit("block"), source), F.col("blocks")).cast("int"))


def _over_blocks(units: DataFrame, by: list[str], source: str, work: Callable, schema: StructType) -> DataFrame:
    """work(rows of a block, block sizes of its stratum) for each block."""
    dealt = _blocks(units, by, source)
    counts = dealt.groupBy("__group", "__block", "blocks").agg((F.sum("__m") if "__m" in units.columns else F.count("*")).alias("k"))
    all_sizes = counts.groupBy("__group").agg(F.collect_list(F.struct("__block", "k")).alias("sizes"), F.max("blocks").alias("n_blocks"))
    known = counts.join(all_sizes, "__group").select(F.col("__group").alias("__group2"), F.col("__block").alias("__block2"), "sizes", "n_blocks")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        sizes = np.zeros(known.column("n_blocks")[0].as_py(), np.int64)
        for x in known.column("sizes")[0].as_py():
            sizes[x["__block"]] = x["k"]
        return work(rows.sort_by([(source, "ascending")]), sizes)

    # A fixed number of partitions: few bytes of sources make much work, and by their bytes they would be put into one task.
    n = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism)
    dealt, known = dealt.repartition(n, "__group", "__block"), known.repartition(n, "__group2", "__block2")
    return dealt.groupBy("__group", "__block").cogroup(known.groupBy("__group2", "__block2")).applyInArrow(run, schema)


def _units(rows: DataFrame, by: list[str], source: str, stratum: str | None, sums: list[Column]) -> DataFrame:
    """One row a source, with its stratum; a source in several strata is an error, as in any stratified draw."""
    label = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("all")
    one = rows.where(F.col(source).isNotNull()).groupBy(*by, source).agg(F.min(label).alias("__stratum"), F.max(label).alias("__other"), *sums)
    spans = F.raise_error(F.lit("a source cannot span separately resampled strata"))
    return one.withColumn("__stratum", F.when(F.col("__stratum") == F.col("__other"), F.col("__stratum")).otherwise(spans)).drop("__other")


def _reasons(estimate: Column, least: int | None, contributing: Column, defined: Column) -> Column:
    """Why an interval is withheld; null if it is not."""
    why = F.when(estimate.isNull(), "no_contributing_sources")
    why = why.otherwise("ci_support_not_frozen") if least is None else why.when(contributing < least, "insufficient_independent_sources")
    return why if least is None else why.when(F.coalesce(defined, F.lit(0)) == 0, "no_defined_resamples")


def _constant(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (rows, by) if by else (rows.withColumn("__all", F.lit(0)), ["__all"])


def bootstrap_ratios(
    rows: DataFrame, source: str, metrics: Mapping[str, tuple[Column, Column]], by: list[str], stratum: str | None = None, resamples: int = 10_000, seed: int = 42,
    confidence: float = 0.95, least: int | None | Mapping[str, int | None] = 2, named: str = "metric",
) -> DataFrame:
    """by..., metric (named), estimate, low, high, sources, contributing, defined, reason: intervals of ratios of sums over drawn sources.

    metrics: name -> (numerator, denominator), summed over the rows of the drawn sources, copies counted each time; null
    counts as nothing. A mean of documents is (value, 1 where there is a value). A source contributes to a metric if its
    denominator is not 0; with fewer than `least` of them (a number, or one by metric; None: not decided) there is no
    interval, and reason says why. A resample whose denominator is 0 is undefined and left out. Rows without source are
    left out. No rows give no result rows.
    """
    rows, keys = _constant(rows, by)
    names = list(metrics)
    sums = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"__{part}{i}") for i, pair in enumerate(metrics.values()) for part, c in zip("nd", pair, strict=True)]
    # Written, as sources are looked at several times: for sizes, draws and estimates.
    units = written(_units(rows, keys, source, stratum, sums), "units")
    columns = [f"__{part}{i}" for i in range(len(names)) for part in "nd"]
    kinds = [units.schema[c] for c in keys]
    schema = StructType([*kinds, StructField("__b", IntegerType()), *(StructField(c, DoubleType()) for c in columns)])

    def work(block: pa.Table, sizes: np.ndarray) -> pa.Table:
        at, group = block.column("__block")[0].as_py(), block.column("__group")[0].as_py()
        values = np.stack([block.column(c).to_numpy() for c in columns], axis=1)
        found = drawn_sums(block_draws(sizes, at, resamples, seed, group), values, block.column("__m").to_numpy(), at, seed, group)
        same = [block.column(c).combine_chunks().take(pa.array(np.zeros(resamples, np.int64))) for c in keys]
        return pa.table([*same, pa.array(np.arange(resamples), pa.int32()), *(pa.array(found[:, i]) for i in range(len(columns)))], names=schema.names)

    drawn = _over_blocks(_alike(units, keys, source, columns), keys, source, work, schema).groupBy(*keys, "__b").agg(*[F.sum(c).alias(c) for c in columns])
    tail = (1 - confidence) / 2
    ratio = lambda i: F.col(f"__n{i}") / F.nullif(F.col(f"__d{i}"), F.lit(0.0))
    bounds = drawn.groupBy(*keys).agg(*[x for i in range(len(names)) for x in (F.percentile(ratio(i), F.lit(tail)).alias(f"low{i}"), F.percentile(ratio(i), F.lit(1 - tail)).alias(f"high{i}"), F.count(ratio(i)).alias(f"defined{i}"))])
    whole = units.groupBy(*keys).agg(F.count("*").alias("sources"), *[x for i in range(len(names)) for x in ((F.sum(f"__n{i}") / F.nullif(F.sum(f"__d{i}"), F.lit(0.0))).alias(f"estimate{i}"), F.count_if(F.col(f"__d{i}") != 0).alias(f"contributing{i}"))])
    both = whole.join(bounds, keys)
    out = []
    for i, name in enumerate(names):
        need = least.get(name) if isinstance(least, Mapping) else least
        why = _reasons(F.col(f"estimate{i}"), need, F.col(f"contributing{i}"), F.col(f"defined{i}"))
        held = lambda c, why=why: F.when(why.isNull(), F.col(c))
        out.append(F.struct(F.lit(name).alias(named), F.col(f"estimate{i}").alias("estimate"), held(f"low{i}").alias("low"), held(f"high{i}").alias("high"), F.col("sources"), F.col(f"contributing{i}").alias("contributing"), F.col(f"defined{i}").alias("defined"), why.alias("reason")))
    return both.select(*by, F.explode(F.array(*out)).alias("m")).select(*by, "m.*")


def draws(rows: DataFrame, source: str, by: list[str], stratum: str | None = None, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """by..., source, counts: how often each resample draws a source, as compressed 32-bit numbers (see `counts_of`)."""
    units = _units(rows, by, source, stratum, [])
    schema = StructType([*(units.schema[c] for c in (*by, source)), StructField("counts", BinaryType())])

    def work(block: pa.Table, sizes: np.ndarray) -> pa.Table:
        at, group = block.column("__block")[0].as_py(), block.column("__group")[0].as_py()
        n = block_draws(sizes, at, resamples, seed, group)
        counts = np.concatenate([c.astype(np.uint32) for c in source_draws(n, block.num_rows, at, seed, group)])
        packed = [zlib.compress(np.ascontiguousarray(counts[:, i]).tobytes(), 1) for i in range(block.num_rows)]
        return pa.table([*(block.column(c) for c in (*by, source)), pa.array(packed, pa.binary())], names=schema.names)

    return _over_blocks(units, by, source, work, schema)


def counts_of(packed: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), kind)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """left with the rows of right that are alike in all of on, missing keys too; right is broadcast if it is few."""
    other = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    return left.join(F.broadcast(other) if few else other, alike, how).drop(*(f"__on_{c}" for c in on))


def blocks_of(rows: DataFrame, source: str, by: list[str], stratum: str | None = None) -> DataFrame:
    """by..., __group, __block, __blocks, __sources (rising), __sizes (of all blocks of the stratum): a row a block.

    With a seed this is all that a task needs to make the counts of `draws` anew, so that these need not be kept or sent.
    """
    units = _units(rows, by, source, stratum, [])
    schema = StructType([*(units.schema[c] for c in by), StructField("__group", LongType()), StructField("__block", IntegerType()), StructField("__blocks", IntegerType()), StructField("__sources", ArrayType(units.schema[source].dataType)), StructField("__sizes", BinaryType())])

    def work(block: pa.Table, sizes: np.ndarray) -> pa.Table:
        held = block.column(source).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        one = block.slice(0, 1)
        return pa.table([*(one.column(c) for c in (*by, "__group", "__block")), pa.array([len(sizes)], pa.int32()), lists, pa.array([zlib.compress(sizes.tobytes(), 1)], pa.binary())], names=schema.names)

    return _over_blocks(units, by, source, work, schema)


def _team() -> Column:
    """Blocks whose sums are added up before they are sent: some of a stratum that has many."""
    return F.floor(F.col("__block") / F.greatest(F.lit(1), F.least(F.lit(TEAM_BLOCKS), F.floor(F.col("__blocks") / TEAMS)))).cast("int")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers that are not negative, as narrow as the largest allows."""
    return zlib.compress(np.ascontiguousarray(numbers, np.min_scalar_type(int(numbers.max(initial=0)))).tobytes(), 1)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    plain = zlib.decompress(packed)
    return np.frombuffer(plain, f"<u{len(plain) // n}").astype(np.int64)


def _shares(n: int, percentiles: tuple[float, ...]) -> list[float]:
    """Where ranges of n values end, as shares: narrow ones in line about each percentile, beyond them twice as wide each time."""
    step = max(GROUP_ROWS, n**0.5 / 4) / n
    away = [i * step for i in range(NARROW + 1)]
    while away[-1] < 1:
        away.append(2 * away[-1])
    return sorted({p + side * x for p in percentiles for x in away for side in (-1, 1) if 0 < p + side * x < 1})


def resampled_percentiles(
    rows: DataFrame, blocks: DataFrame, source: str, value: str, by: list[str], percentiles: tuple[float, ...], stratum: str | None = None, resamples: int = 10_000, seed: int = 42,
) -> DataFrame:
    """by..., percentile, b, q: percentiles (linear between order statistics) of the values of each resample's drawn sources.

    b = resamples is the sample itself, each source once. Order statistics under weights, without a group in one task and
    without counts being sent: values are cut into ranges (which deal the work and change no result), and go to the blocks
    of their sources. A block makes its draws and adds up what they weigh in each range; sums over blocks tell which range
    holds the wanted ranks of a resample. A block then makes its draws again, and sends the weights of single values of a
    range for those resamples that look into it. Ranges in which too much is looked up are cut finer first.
    blocks: of blocks_of, read several times: hand in a written table.
    """
    label = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("all")
    known = rows.where(F.col(value).isNotNull() & F.col(source).isNotNull()).select(*by, F.col(source).alias("__s"), F.col(value).cast("double").alias("__v"), F.xxhash64(*by, label).alias("__group"))
    most = known.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = blocks.groupBy("__group").agg(F.max("__blocks").alias("__blocks"))
    known = known.join(F.broadcast(groups) if groups.count() <= ASKED_ROWS else groups, "__group")
    known = known.withColumn("__block", F.pmod(F.xxhash64(F.lit("block"), "__s"), F.col("__blocks")).cast("int")).withColumn("__team", _team()).drop("__blocks")
    dealt = blocks.withColumn("__team", _team())
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    home = ["__group", "__team"]
    key_fields = [rows.schema[c] for c in by]

    def keys_of(t: pa.Table, n: int) -> list[pa.Array]:
        return [t.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in by]

    def drawn(held: pa.Table, t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, int, Iterator[np.ndarray]]]:
        """Of each block: its rows of held, the places of their sources, the number of sources, and counts [resample, source], all ones at the end."""
        mine = held.column("__block").to_numpy()
        for i in np.flatnonzero(~pc.is_null(t.column("__block")).to_numpy()).tolist():
            at, sources = t.column("__block")[i].as_py(), t.column("__sources")[i].values
            some = np.flatnonzero(mine == at)
            if len(some):
                places = pc.index_in(held.column("__s").combine_chunks().take(pa.array(some)), value_set=sources).to_numpy()
                group = t.column("__group")[i].as_py()
                of = block_draws(np.frombuffer(zlib.decompress(t.column("__sizes")[i].as_py()), np.int64), at, resamples, seed, group)
                yield some, places, len(sources), chain(source_draws(of, len(sources), at, seed, group), [np.ones((1, len(sources)), np.int64)])

    def together(values: DataFrame, also: DataFrame, work: Callable, schema: StructType) -> DataFrame:
        """work(values of a team by block and source, their number in __m; the team's rows of also) for each team."""
        columns = [c for c in ("__block", "__s", "__range", "__v") if c in values.columns]
        counted = values.repartition(n, *home).groupBy(*home, *columns).agg(F.count("*").alias("__m"))
        return counted.groupBy(*home).cogroup(also.repartition(n, *home).groupBy(*home)).applyInArrow(work, schema)

    total = StructType([*key_fields, StructField("__range", IntegerType()), StructField("__n", LongType()), StructField("total", BinaryType())])

    def add_up(held: pa.Table, t: pa.Table) -> pa.Table:
        ranges, at = np.unique(held.column("__range").to_numpy(), return_inverse=True)
        times, sums = held.column("__m").to_numpy(), np.zeros((len(ranges), resamples + 1), np.int64)
        for some, places, sources, counts in drawn(held, t):
            weights = np.zeros((sources, len(ranges)))
            np.add.at(weights, (places, at[some]), times[some])
            kind = np.float32 if weights.max() * sources * 64 < 1 << 24 else np.float64  # sums stay exact
            weights, a = weights.astype(kind), 0
            for c in counts:
                sums[:, a : a + len(c)] += (c.astype(kind) @ weights).T.astype(np.int64)
                a += len(c)
        values = np.bincount(at, times, len(ranges)).astype(np.int64)
        return pa.table([*keys_of(t, len(ranges)), pa.array(ranges, pa.int32()), pa.array(values), pa.array([_packed(x) for x in sums], pa.binary())], names=total.names)

    def totals(t: pa.Table) -> pa.Table:
        of = sum(_unpacked(w, resamples + 1) for w in t.column("total").to_pylist())
        return pa.table([*keys_of(t, 1), pa.array([t.column("__range")[0].as_py()], pa.int32()), pa.array([pc.sum(t.column("__n")).as_py()]), pa.array([_packed(of)], pa.binary())], names=total.names)

    wanted = StructType([*key_fields, StructField("__range", IntegerType()), StructField("__n", LongType()), StructField("asked", BinaryType()), StructField("who", BinaryType())])
    request = np.dtype([("p", "<i4"), ("b", "<i4"), ("high", "?"), ("rank", "<i8"), ("part", "<f8")])

    def ask(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__range", "ascending")])
        each = np.stack([_unpacked(x, resamples + 1) for x in t.column("total").to_pylist()])
        upto = np.cumsum(each, axis=0)
        found: list[list[np.ndarray]] = [[] for _ in range(len(each))]
        b = np.flatnonzero(upto[-1] > 0)
        for p, fraction in enumerate(percentiles):
            place = (upto[-1][b] - 1) * fraction
            low = np.floor(place).astype(np.int64)
            for high in (False, True):
                rank = np.minimum(low + high, upto[-1][b] - 1)
                where = (upto[:, b] <= rank).sum(axis=0)
                for r in np.unique(where).tolist():
                    mine = np.flatnonzero(where == r)
                    asked = np.zeros(len(mine), request)
                    asked["p"], asked["b"], asked["high"], asked["part"] = p, b[mine], high, (place - low)[mine]
                    asked["rank"] = rank[mine] - (upto[r, b[mine]] - each[r, b[mine]])
                    found[r].append(asked)
        some = [i for i, f in enumerate(found) if f]
        kept, asked = t.take(pa.array(some, pa.int64())), [np.concatenate(found[i]) for i in some]
        who = [zlib.compress(np.unique(x["b"]).tobytes(), 1) for x in asked]
        return pa.table([*keys_of(t, len(some)), kept.column("__range").cast(pa.int32()), kept.column("__n"), pa.array([x.tobytes() for x in asked], pa.binary()), pa.array(who, pa.binary())], names=wanted.names)

    def placed(edges: DataFrame | None) -> DataFrame:
        if edges is None:
            return known.withColumn("__range", F.lit(0))
        return _join(known, edges, by, few=edges.count() <= EDGE_ROWS).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges")

    # Written, as the ranges are made twice and must be the same ones.
    edges = written(known.groupBy(*by).agg(F.array_distinct(F.percentile_approx("__v", _shares(most, percentiles), 100_000)).alias("__edges")), "edges") if most > GROUP_ROWS else None
    while True:
        cut = placed(edges)
        sums = together(cut.drop("__v"), dealt, add_up, total)
        requests = written(sums.groupBy(*by, "__range").applyInArrow(totals, total).groupBy(*by).applyInArrow(ask, wanted), "requests")
        wide = requests.where((F.col("__n") > 4 * GROUP_ROWS) & (F.col("__n") * F.length("asked") > WIDE * request.itemsize)).select(*by, "__range")
        if edges is None or wide.isEmpty():
            break
        more = _join(cut, wide, [*by, "__range"]).groupBy(*by, "__range").agg(F.percentile_approx("__v", [i / 16 for i in range(1, 17)]).alias("__more")).groupBy(*by).agg(F.flatten(F.collect_list("__more")).alias("__more"))
        finer = written(_join(edges, more, by, "left").select(*by, F.sort_array(F.array_union("__edges", F.coalesce("__more", F.array().cast("array<double>")))).alias("__edges")), "edges")
        if finer.agg(F.sum(F.size("__edges"))).first() == edges.agg(F.sum(F.size("__edges"))).first():
            break  # each of the wide ranges is one value
        edges = finer

    looked = reduce(lambda x, y: x & y, [cut[c].eqNullSafe(requests[c]) for c in (*by, "__range")])
    asked_ranges = requests.select(*by, "__range")
    few = cut.join(F.broadcast(asked_ranges) if requests.count() <= ASKED_ROWS else asked_ranges, looked, "left_semi")
    same = reduce(lambda x, y: x & y, [requests[c].eqNullSafe(F.col(f"t.{c}")) for c in by])
    asking = requests.join(dealt.select(*by, *home).distinct().alias("t"), same).select(*[requests[c] for c in by], *home, "__range", "who")
    kept = StructType([*key_fields, StructField("__range", IntegerType()), StructField("values", BinaryType()), StructField("weights", BinaryType())])

    def single(held: pa.Table, t: pa.Table) -> pa.Table:
        ranges, at = np.unique(held.column("__range").to_numpy(), return_inverse=True)
        asks = {r: np.frombuffer(zlib.decompress(w), np.int32) for r, w in zip(t.column("__range").to_pylist(), t.column("who").to_pylist(), strict=True) if w is not None}
        v, times, place_of = held.column("__v").to_numpy(), held.column("__m").to_numpy(), np.zeros(held.num_rows, np.int64)
        values = []
        for i in range(len(ranges)):
            distinct, place_of[at == i] = np.unique(v[at == i], return_inverse=True)
            values.append(distinct)
        who = [asks[r] for r in ranges.tolist()]
        weights = [np.zeros((len(x), len(w)), np.int64) for x, w in zip(values, who, strict=True)]
        for some, places, _, counts in drawn(held, t):
            parts = [(i, mine, place_of[some[mine]], len(np.unique(place_of[some[mine]])) == len(mine)) for i in range(len(ranges)) if len(mine := np.flatnonzero(at[some] == i))]
            a = 0
            for c in counts:
                for i, mine, rows_, apart in parts:
                    x, y = np.searchsorted(who[i], [a, a + len(c)])
                    if x < y:
                        add = (c[who[i][x:y] - a][:, places[mine]] * times[some[mine]]).T
                        if apart:
                            weights[i][rows_, x:y] += add
                        else:
                            np.add.at(weights[i][:, x:y], rows_, add)
                a += len(c)
        return pa.table([*keys_of(t, len(ranges)), pa.array(ranges, pa.int32()), pa.array([x.tobytes() for x in values], pa.binary()), pa.array([_packed(w) for w in weights], pa.binary())], names=kept.names)

    parts = together(few, dealt.unionByName(asking, allowMissingColumns=True), single, kept)
    answer = StructType([*key_fields, StructField("p", IntegerType()), StructField("b", IntegerType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("part", DoubleType())])

    def look_up(held: pa.Table, asked: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x, request) for x in asked.column("asked").to_pylist()]) if asked.num_rows else np.zeros(0, request)
        got = np.zeros(len(r))
        if len(r):
            who, each = np.unique(r["b"]), [np.frombuffer(x) for x in held.column("values").to_pylist()]
            v = np.unique(np.concatenate(each))
            w = np.zeros((len(v), len(who)), np.int64)
            for x, y in zip(each, held.column("weights").to_pylist(), strict=True):
                w[np.searchsorted(v, x)] += _unpacked(y, len(x) * len(who)).reshape(len(x), len(who))
            np.cumsum(w, axis=0, out=w)
            for a in range(0, len(r), STEP):
                some = r[a : a + STEP]
                got[a : a + STEP] = v[(w[:, np.searchsorted(who, some["b"])] <= some["rank"]).sum(axis=0)]
        side = lambda high: pa.array(got, mask=r["high"] != high)
        return pa.table([*keys_of(held, len(r)), pa.array(r["p"]), pa.array(r["b"]), side(False), side(True), pa.array(r["part"])], names=answer.names)

    found = parts.groupBy(*by, "__range").cogroup(requests.groupBy(*by, "__range")).applyInArrow(look_up, answer)
    one = found.groupBy(*by, "p", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("part").alias("part"))
    share = F.element_at(F.array(*map(F.lit, percentiles)), F.col("p") + 1)
    return one.select(*by, share.alias("percentile"), "b", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))


def _interval_rows(found: DataFrame, whole: DataFrame, by: list[str], keys: list[str], resamples: int, confidence: float, least: int | None) -> DataFrame:
    tail = (1 - confidence) / 2
    of = F.when(F.col("b") < resamples, F.col("q"))
    bounds = found.groupBy(*keys, "percentile").agg(F.percentile(of, F.lit(tail)).alias("low"), F.percentile(of, F.lit(1 - tail)).alias("high"), F.count(of).alias("defined"), F.max(F.when(F.col("b") == resamples, F.col("q"))).alias("estimate"))
    both = _join(whole, bounds, [*keys, "percentile"], "left")
    why = _reasons(F.col("estimate"), least, F.col("contributing"), F.col("defined"))
    return both.select(*by, "percentile", "estimate", F.when(why.isNull(), F.col("low")).alias("low"), F.when(why.isNull(), F.col("high")).alias("high"), "sources", "contributing", F.coalesce("defined", F.lit(0)).cast(LongType()).alias("defined"), why.alias("reason"))


def _contributing(rows: DataFrame, keys: list[str], source: str, values: tuple[str, ...], percentiles: tuple[float, ...]) -> DataFrame:
    """keys..., percentile, sources, contributing (sources that have a row with all values)."""
    has = reduce(lambda x, y: x & y, [F.col(v).isNotNull() for v in values])
    each = rows.where(F.col(source).isNotNull()).groupBy(*keys, source).agg(F.max(has).alias("__has"))
    counts = each.groupBy(*keys).agg(F.count("*").alias("sources"), F.count_if("__has").alias("contributing"))
    return counts.select(*keys, F.explode(F.array(*map(F.lit, percentiles))).alias("percentile"), "sources", "contributing")


def bootstrap_percentiles(
    rows: DataFrame, source: str, value: str, by: list[str], percentiles: tuple[float, ...] = (0.5, 0.95), stratum: str | None = None, resamples: int = 10_000, seed: int = 42,
    confidence: float = 0.95, least: int | None = 2,
) -> DataFrame:
    """by..., percentile, estimate, low, high, sources, contributing, defined, reason: intervals of percentiles over drawn sources.

    All rows of a drawn source come along, as often as it is drawn; rows without a value count for nothing. Reasons to
    withhold an interval are those of bootstrap_ratios.
    """
    rows, keys = _constant(rows, by)
    drawn = written(blocks_of(rows, source, keys, stratum), "draws")
    found = resampled_percentiles(rows, drawn, source, value, keys, percentiles, stratum, resamples, seed)
    return _interval_rows(found, _contributing(rows, keys, source, (value,), percentiles), by, keys, resamples, confidence, least)


def paired_percentiles(
    rows: DataFrame, source: str, baseline: str, candidate: str, by: list[str], percentiles: tuple[float, ...] = (0.5, 0.95), stratum: str | None = None, resamples: int = 10_000, seed: int = 42,
    confidence: float = 0.95, least: int | None = 2,
) -> DataFrame:
    """Like bootstrap_percentiles, for the candidate's percentile less the baseline's, both under one draw of sources.

    A resample is defined if both sides have a value in it.
    """
    rows, keys = _constant(rows, by)
    drawn = written(blocks_of(rows, source, keys, stratum), "draws")
    a, b = (resampled_percentiles(rows, drawn, source, c, keys, percentiles, stratum, resamples, seed) for c in (baseline, candidate))
    found = _join(a.withColumnRenamed("q", "__x"), b, [*keys, "percentile", "b"]).withColumn("q", F.col("q") - F.col("__x"))
    return _interval_rows(found, _contributing(rows, keys, source, (baseline, candidate), percentiles), by, keys, resamples, confidence, least)

"""URL filters: a blocked Bloom filter in front of an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is one 64-bit word, of four entries on average. Up to 2^17 words (1 MB) are part of the plan; more are a table.
MAX_WORDS = 1 << 17
#: Up to so many listed URLs the exact join broadcasts them; beyond, it is a shuffled join that AQE splits where skewed.
BROADCAST_ROWS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; null or no "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.element_at(F.split(rest, "[/?#]", 2), 1)
    tail = rest.substr(F.length(host) + 1, F.length(rest) + 1)
    return F.translate(host, _UPPER, _LOWER), F.element_at(F.split(tail, "[?#]", 2), 1)


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path as they are compared: percent escapes decoded where they are valid, A-Z of the host lowered, no user
    information, port or dots at the end of the host."""
    decoded = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    plain = F.regexp_replace(F.regexp_replace(decoded(host), r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.translate(F.regexp_replace(plain, r"\.+$", ""), _UPPER, _LOWER), decoded(path)


def _hashes(key: Column, n_words: int) -> tuple[Column, Column]:
    """The block of a key, and the word in which its four bits are set."""
    h = F.xxhash64(key)
    bits = [F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    mask = F.lit(0).cast("bigint")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
    return h.bitwiseAND(F.lit(n_words - 1)).cast("int"), mask


def build_filter(listed: DataFrame, key: str, n_words: int) -> list[int]:
    """The words of the blocked Bloom filter: bit_or per block, at most MAX_WORDS numbers for the driver."""
    block, word = _hashes(F.col(key), n_words)
    rows = listed.select(block.alias("b"), word.alias("w")).groupBy("b").agg(F.bit_or("w").alias("w"))
    words = [0] * n_words
    for b, w in rows.collect():
        words[b] = w
    return words


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", as_listed: bool = False) -> DataFrame:
    """Judge every row of pages by the longest listed entry that fits it.

    listed has host, path, verdict; an entry fits its host and all subdomains where the url's path starts with its
    path. Adds host, path, entry (host and path of the entry, else null) and verdict ('allow' where nothing fits).
    Null or malformed urls have an empty host and path and fit nothing unless an empty host is listed. Repeated rows
    stay. Equal entries listed twice with different verdicts: 'block' wins. Of entries of equal length the smaller
    string wins. Columns of pages named host, path, entry or verdict are replaced.
    Entries and urls are compared in canonical form (see canonical), or letter by letter with as_listed; host, path and entry
    are given as they stand.
    Candidates are all host suffixes with the path's prefixes of listed lengths; the Bloom filter passes possible
    ones, the exact join drops its false positives.
    """
    listed = (
        listed.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), F.col("verdict").alias("e_verdict"))
        .where("e_host is not null and e_path is not null")
        .groupBy("e_host", "e_path").agg(F.max("e_verdict").alias("e_verdict"))
    )
    form = (lambda h, p: (h, p)) if as_listed else canonical
    e_host, e_path = form(F.col("e_host"), F.col("e_path"))
    listed = listed.select("*", F.concat_ws("\u0000", e_host, e_path).alias("e_key"), F.length(e_path).alias("e_length"))
    # Lengths of listed paths: bounded by the longest url, not by the number of rows.
    stats = listed.agg(F.count("*").alias("n"), F.collect_set("e_length").alias("lengths")).first()
    n_words = 64
    while n_words * 4 < stats.n:
        n_words *= 2
    host, path = host_path(F.col(url))
    pages = pages.drop(*[c for c in ("host", "path", "entry", "verdict") if c in pages.columns]).withColumn("host", host).withColumn("path", path)
    m_host, m_path = form(F.col("host"), F.col("path"))
    pages = pages.withColumn("__host", m_host).withColumn("__path", m_path)
    lengths = F.array(*[F.lit(n) for n in sorted(stats.lengths)]) if stats.lengths else F.array().cast("array<int>")
    labels = F.split("__host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n)
    )
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\u0000"), p))))

    # Each distinct host and path is judged once, so copies of one url cost nothing twice.
    distinct = pages.select("__host", "__path").distinct()
    if n_words <= MAX_WORDS:
        words = F.expr(f"from_json('{build_filter(listed, 'e_key', n_words)}', 'array<bigint>')")

        def possible(key: Column) -> Column:
            block, mask = _hashes(key, n_words)
            return F.element_at(words, block + 1).bitwiseAND(mask) == mask

        hits = distinct.select("__host", "__path", F.explode(F.filter(keys, possible)).alias("e_key"))
    else:
        # A filter too large for the plan stays a table of blocks, and candidates meet theirs.
        block, mask = _hashes(F.col("e_key"), n_words)
        blocks = listed.select(block.alias("__b"), mask.alias("__w")).groupBy("__b").agg(F.bit_or("__w").alias("__w"))
        asked = distinct.select("__host", "__path", F.explode(keys).alias("e_key")).withColumn("__b", block).withColumn("__m", mask)
        hits = asked.join(blocks, "__b").where(F.col("__w").bitwiseAND(F.col("__m")) == F.col("__m")).select("__host", "__path", "e_key")
    exact = hits.join(F.broadcast(listed) if stats.n <= BROADCAST_ROWS else listed, "e_key")
    best = exact.groupBy("__host", "__path").agg(
        F.min(F.struct(-(F.length("e_host") + F.length("e_path")), F.concat("e_host", "e_path").alias("entry"), F.when(F.col("e_verdict") == "block", 0).otherwise(1).alias("o"), "e_verdict")).alias("m")
    ).select("__host", "__path", F.col("m.entry").alias("entry"), F.col("m.e_verdict").alias("verdict"))
    out = pages.join(best, ["__host", "__path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return out.select(*[c for c in pages.columns if c not in ("host", "path", "__host", "__path")], "host", "path", "entry", "verdict")

"""URL verdicts: host and path rules, and a Bloom filter cascade for a block list of sites.

The universe of keys is complete: every host of the corpus and each of its parent domains. Level 1 of the cascade encodes
the listed keys, level 2 the universe's keys that wrongly pass level 1, level 3 the listed keys that wrongly pass level 2,
and so on until a level has no false positives. A key is listed exactly if the first level that rejects it is an even one;
no key of the universe is judged wrongly, and judging needs no join. The first level's false-positive rate is chosen so
that later levels hold about as many keys as the list, hence the filters' size grows with the list (times the logarithm of
the universe's size over it), not with the corpus.

A filter is a literal of the plan, so its size is bounded: a list that would need more than MOST_BITS is dealt by hash into
shards of their own cascades, and rows pass shard after shard.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; repeated rows
are judged each; an empty table gives no rows, an empty list blocks nothing; other columns than page_id and url are not
looked at; rules of equal length can't both fit. The time for a url grows with its length and its host's labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (verdict, host, path), the contract's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The default list, made by rule: numbered hosts of six unwanted kinds under three suffixes. Others are passed as a table.
KINDS, SUFFIXES, NUMBERED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org"), 500
#: Bits of a shard's first filter, and keys so few that they are kept as they are at the end of a cascade.
MOST_BITS, FEW = 1 << 28, 64


def default_list(spark: SparkSession) -> DataFrame:
    """key: the default list; a kind's number 0 stands without a number."""
    number = F.when(F.col("id") == 0, "").otherwise(F.col("id").cast("string"))
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = spark.range(NUMBERED).select(number.alias("number"), each(KINDS).alias("kind")).select("number", "kind", each(SUFFIXES).alias("suffix"))
    return rows.select(F.concat("kind", "number", F.lit(".example."), "suffix").alias("key"))


def bit(i: Column) -> Column:
    """1 << i for i from 0 to 7."""
    return F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), (i + 1).cast("int"))


def host_of(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    rest = F.substr(url, at + 3)
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def keys_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.when(F.length(host) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of 64-bit words, or a few keys as they are."""

    words: bytes = b""
    size: int = 0
    hashes: int = 0
    seed: int = 0
    keys: tuple[str, ...] | None = None

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.size)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Whether the key is one of the few, or every position of it is set."""
        if self.keys is not None:
            return key.isin(*self.keys)
        held, words = F.lit(True), F.lit(self.words)  # one literal for all positions
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substr(words, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            held = held & (byte.bitwiseAND(bit(at % 8)) != 0)
        return held


def bits_for(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n keys, or the few themselves. The executors set the bits; the driver gets each set word once."""
    if n <= FEW:
        return Level(keys=tuple(sorted(r["key"] for r in keys.collect())))  # at most FEW rows
    empty = Level(b"", bits_for(n, rate), max(1, round(math.log2(1 / rate))), seed)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    low = F.array(*[F.lit(1 << j if j < 63 else -(1 << 63)) for j in range(64)])
    set_words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.element_at(low, (F.col("at") % 64 + 1).cast("int"))).alias("bits"))
    words = np.zeros(empty.size // 64 + 1, dtype="<i8")
    found = set_words.toPandas()  # size / 64 rows at most
    words[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return Level(words.tobytes(), empty.size, empty.hashes, seed)


def first_rate(n: int, others: int) -> float:
    """The first level's rate of false positives, for which later levels hold about as many keys as the list."""
    return min(0.5, math.sqrt(0.5) * n / max(others, 1))


def build(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The cascade's levels. universe, listed: column key, distinct; keys of listed outside the universe do no harm."""
    inside = listed
    outside = stored(universe.join(listed, "key", "left_anti"))
    levels: list[Level] = []
    n, others = inside.count(), outside.count()
    while n:
        level = build_level(inside, n, 0.5 if levels else first_rate(n, others), len(levels))
        levels.append(level)
        inside, outside = stored(outside.where(level.passes(F.col("key")))), inside
        n = inside.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether key, of the universe, is listed: the first level that rejects it, counted from 0, is odd."""
    verdict = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        verdict = F.when(~level.passes(key), F.lit(i % 2 == 1)).otherwise(verdict)
    return verdict


def rule_of(host: Column, path: Column) -> Column:
    """The longest fitting rule as (name, verdict); null where none fits."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    spark: SparkSession = pages.sparkSession
    listed = stored((default_list(spark) if listed is None else listed.select("key").where("key is not null")).distinct())
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = stored(rows.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct())
    n = listed.count()
    shards = max(1, math.ceil(bits_for(n, first_rate(n, universe.count())) / MOST_BITS))
    rows = rows.withColumn("found", F.lit(False))
    for shard in range(shards):
        own = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)) == shard  # noqa: B023, E731 - used at once
        levels = build(universe.where(own(F.col("key"))), listed.where(own(F.col("key")))) if shards > 1 else build(universe, listed)
        hit = F.exists(keys_of(F.col("host")), lambda k: (own(k) & member(levels, k)) if shards > 1 else member(levels, k))  # noqa: B023
        rows = rows.withColumn("found", F.col("found") | hit)
        if shards > 1:
            rows = stored(rows)
    return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"),
    )

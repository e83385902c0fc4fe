"""URL filtering: prefix rules, then a Bloom filter cascade over listed hosts.

The cascade's odd levels hold listed keys (first all, later those the level before let through wrongly) and its even levels
the unlisted keys of the corpus that the level before let through. Levels go on until one has no false positive over the
complete key universe, so membership of any key of the corpus is exact, and judging a row takes a few bit tests against
binary literals: no join. Building reads the distinct keys once; the driver gets only bitmaps, whose size follows the list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilum.llm._store import spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule), a rule being host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Hosts that are blocked with their subdomains where no rule decides.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Largest filter sent to the tasks, over all levels (about 40 million listed hosts); beyond it, hosts are joined.
MAX_FILTER_BYTES = 64 << 20


class TooLargeError(ValueError):
    """A cascade's levels would take more than the limit."""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or nulls. Equal rules: the first listed."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if chosen is None else chosen.otherwise(none)


def host_keys(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    parents = lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), "."))
    return F.when(F.length(host) > 0, F.element_at(F.transform(F.array(labels), parents), 1)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    bitmap: bytes

    def holds(self, key: Column) -> Column:
        """Whether all bits of ``key`` are set: true for every key put in, and for some others. The bitmap is in it once."""

        def tested(bitmap):
            test = None
            for place in _places(key, self):
                byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
                bit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
                test = bit if test is None else test & bit
            return test

        return F.exists(F.array(F.lit(bytearray(self.bitmap))), tested)


def _places(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.seed), F.lit(i), key), F.lit(level.bits).cast("long")) for i in range(level.hashes)]


def _bits(n: int, rate: float) -> int:
    return -(-max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2)) // 8) * 8


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    bits = _bits(n, rate)
    level = Level(bits, max(1, round(-math.log2(rate))), seed, b"")
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level))).alias("place"))
    # Spark's bitmap functions number positions from 1 and cut them into buckets of 32768.
    parts = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("part")).collect()
    out = bytearray(-(-bits // 32768) * 4096)
    for bucket, part in parts:
        out[(bucket - 1) * 4096 : bucket * 4096] = part
    return Level(bits, level.hashes, seed, bytes(out[: bits // 8]))


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.01, next_rate: float = 0.5, limit: int = MAX_FILTER_BYTES) -> list[Level]:
    """``listed`` and ``universe``: tables with a string column key. Raises TooLargeError if the levels outgrow ``limit``, before
    the level that does is built.

    Null keys are no keys. The list is written once, and so are the false positives of each level.
    """
    listed = written(listed.where("key is not null").select("key").distinct(), "listed-keys")
    others = universe.where("key is not null").select("key").distinct()
    inside, levels, rate = listed, [], first_rate
    n = inside.count()
    while n:
        if sum(len(x.bitmap) for x in levels) + _bits(n, rate) // 8 > limit:
            raise TooLargeError(f"the cascade takes more than {limit} bytes")
        levels.append(_level(inside, n, rate, len(levels)))
        wrong = others.where(levels[-1].holds(F.col("key")))
        if len(levels) == 1:  # the only look at the corpus's keys
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = written(wrong, "cascade")
        inside, others, rate, n = wrong, inside, next_rate, wrong.count()
    return levels


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe and the list: the first level that misses the key settles it."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def key_table(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys]).cast("array<string>")).alias("key"))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, limit: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    The rule's verdict, else block if the host or a parent domain is listed, else allow. Null urls and urls without ://
    have empty host and path, match nothing and are allowed. Repeated rows are judged alike, each on its own. A list whose
    cascade would take more than ``limit`` bytes is joined with the distinct hosts instead, to the same verdicts.
    """
    spark = pages.sparkSession
    listed = key_table(spark, LISTED) if listed is None else listed
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = hosts.select("host", F.explode(host_keys(F.col("host"))).alias("key"))
    try:
        levels = build_cascade(listed, keys.select("key"), limit=limit)
        hit = F.exists(host_keys(F.col("host")), lambda k: in_cascade(k, levels))
    except TooLargeError:
        blocked = written(keys.join(listed.where("key is not null").select("key").distinct(), "key", "left_semi").select(F.col("host").alias("__v_host")).distinct(), "blocked-hosts")
        parts = parts.join(spread_join(blocked, blocked.count()), F.col("host") == F.col("__v_host"), "left")
        hit = F.col("__v_host").isNotNull()
    ruled = parts.withColumn("__v_rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__v_rule.verdict"), F.when(hit, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("__v_rule.rule").alias("rule"), verdict.alias("verdict"))


def _sql() -> str:
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    fits = lambda rule: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*rule.split("/", 1))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(v, r)}'" for v, r in ordered) + " END"
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return rf"""
WITH p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {case(lambda v, r: r)} AS rule,
  coalesce({case(lambda v, r: v)}, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


OP2_SQL = _sql()

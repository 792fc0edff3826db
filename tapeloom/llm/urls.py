"""URL filter with a cascade of Bloom filters, in DataFrame functions only.

The listed keys and the corpus's complete key universe are known beforehand. The first filter holds the listed keys; the
second holds those keys of the universe that the first lets through wrongly; the third those listed keys that the second
claims; and so on until a level claims nothing wrongly. A key of the universe is then listed or not exactly, by walking the
levels, and no join is needed. The first level's error rate is set so that the second holds about as many keys as the list
(0.7 of it), so all levels are in proportion to the list and to the logarithm of the universe.

A level is one array of words, written to the shared folder and probed as the value of a scalar subquery, which each executor
gets once; so a long list needs room for its filter and nothing else changes with its length.

A key is a host suffix and a path prefix. A url has one for each pair of its suffixes (as many labels as listed hosts have)
and prefixes (as long as listed paths are).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the most bits of a level, half of what one value can hold; a list that needs more raises an error
MOST_BITS = 1 << 33
#: share of the other side that a level after the first claims: a half would take the least room and three times the levels
AGAIN = 0.125


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: DataFrame  # one row with the array

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for at in _places(key, self):
            word = F.element_at(self.words.scalar(), (F.shiftright(at, 6) + 1).cast("int"))
            out = out & _bit(word, at)
        return out


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _places(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level.seed * 1000 + i)), F.lit(level.bits)) for i in range(level.hashes)]


def _level(keys: DataFrame, n: int, wrong: float, seed: int, scratch: Scratch, tag: str) -> Level:
    """A filter that holds ``keys`` (column key) and claims others with probability ``wrong``."""
    bits = max(64, ceil(1.45 * n * log2(1 / wrong)))
    if bits > MOST_BITS:
        raise ValueError(f"{n} listed keys need a filter of {bits} bits, which one value can't hold: split the list")
    level = Level(bits, max(1, round(log2(1 / wrong))), seed, keys)
    at = keys.select(F.explode(F.array(*_places(F.col("key"), level))).alias("at"))
    set_ = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    every = scratch.spark.range(bits // 64 + 1).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    parts = words.groupBy(F.shiftright("word", 12).alias("part")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    parts = parts.select(F.struct("part", F.transform("w", lambda x: x["bits"]).alias("bits")).alias("p"))
    level.words = scratch.cut(parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["bits"])).alias("words")), tag)
    return level


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, tag: str, most: int = 100) -> list[Level]:
    """Levels for the keys of ``listed`` among those of ``universe`` (column key, repeats don't matter). No keys: one empty
    level. Each level holds about an eighth of the keys of the last but one, so ``most`` levels are never reached."""
    listed = scratch.cut(listed.select("key").where("key is not null").distinct(), f"{tag}-listed")
    r = listed.count()
    s = universe.agg(F.approx_count_distinct("key", 0.02).alias("n")).first()["n"]
    wrong = min(0.5, 0.7 * max(r, 1) / max(s, 1))
    levels = [_level(listed, r, wrong, 1, scratch, f"{tag}-1")]
    through = universe.select("key").where(levels[0].holds(F.col("key"))).groupBy("key").agg(F.lit(0).alias("in_list"))
    known = through.unionByName(listed.withColumn("in_list", F.lit(1))).groupBy("key").agg(F.max("in_list").alias("in_list"))
    known = scratch.cut(known, f"{tag}-known")
    claimed = [known.where("in_list = 1"), known.where("in_list = 0")]
    while n := claimed[len(levels) % 2].count():
        if len(levels) == most:
            raise RuntimeError(f"{n} keys are still told wrongly after {most} levels")
        own, other = claimed[len(levels) % 2], claimed[1 - len(levels) % 2]
        levels.append(_level(own, n, AGAIN, len(levels) + 1, scratch, f"{tag}-{len(levels) + 1}"))
        claimed[1 - (len(levels) - 1) % 2] = other.where(levels[-1].holds(F.col("key")))
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Array of the keys that a rule for this host and path could have."""
    parts = F.split(host, r"\.", -1)
    most = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filtered(pages: DataFrame, rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    rules: (host, path, verdict allow or block); the longest that fits decides, block if the same rule says both. Urls that
    no rule fits are blocked if a (host, path) of ``blocked`` fits, else allowed. A url that is null or has no ``://`` has
    an empty host and path, which no rule with a host fits. Repeated rows and rules don't matter, other columns neither; a
    null page_id stays null; an empty table gives no rows, an empty list no verdict of its own.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    # with a number for each row, which must not change when a lost task is run again: written once
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    base = scratch.cut(base.withColumn("row", F.monotonically_increasing_id()), "base")

    def shape(listed: DataFrame) -> tuple[int, list[int]]:
        got = listed.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
        return got["labels"] or 1, sorted(got["lengths"] or [1])

    def keyed(listed: DataFrame) -> DataFrame:
        return listed.withColumn("key", F.concat("host", "path"))

    rules, blocked = keyed(rules), keyed(blocked)
    asked = [keys_of(F.col("host"), F.col("path"), *shape(x)) for x in (rules, blocked)]
    listed, other = (cascade(x, base.select(F.explode(keys).alias("key")), scratch, tag) for x, keys, tag in ((rules, asked[0], "rules"), (blocked, asked[1], "blocked")))
    stop = cascade(rules.where("verdict = 'block'"), rules, scratch, "verdicts")
    # a url's keys as rows, and one row without a key that always stays
    def marked(n: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(n).alias("list"), k.alias("key")))

    none = F.struct(F.lit(2).alias("list"), F.lit(None).cast("string").alias("key"))
    as_rows = F.array_append(F.concat(*(marked(n, keys) for n, keys in enumerate(asked))), none)
    each = base.select("row", "page_id", "host", "path", F.explode(as_rows).alias("k")).select("row", "page_id", "host", "path", "k.list", "k.key")
    fits = F.when(F.col("list") == 0, member(listed, F.col("key"))).when(F.col("list") == 1, member(other, F.col("key"))).otherwise(True)
    longest = F.max(F.when(F.col("list") == 0, F.struct(F.length("key").alias("n"), "key")))
    judged = each.where(fits).groupBy("row", "page_id", "host", "path").agg(longest["key"].alias("rule"), F.max(F.col("list") == 1).alias("also"))
    blocks = F.when(F.col("rule").isNotNull(), member(stop, F.col("rule"))).otherwise(F.col("also"))
    return judged.select("page_id", "host", "path", "rule", F.when(blocks, "block").otherwise("allow").alias("verdict"))


#: fixed values: the rules of the contract, and hosts that this filter blocks where no rule fits
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BLOCKED = (("spam-farm.example.com", ""), ("spam-farm.example.net", ""))


def table(spark: SparkSession, rows: tuple[tuple[str, ...], ...], names: tuple[str, ...]) -> DataFrame:
    """A small table of constants, made in the plan."""
    rows_ = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names))) for r in rows))
    return spark.range(1).select(F.inline(rows_))

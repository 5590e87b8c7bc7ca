"""URL filter: prefix rules, then a Bloom filter cascade over the key universe.

Rules (host, path) fit a host and all its subdomains when the url's path starts
with the rule's path; the longest rule wins.  Urls without a rule are judged by
exact membership of their host in a list, answered by a cascade of Bloom
filters instead of a join:

* level 1 encodes the listed keys; every unlisted key of the corpus that it lets
  through is a known false positive, because the universe of keys is complete;
* level 2 encodes those false positives, level 3 the listed keys that level 2
  lets through, and so on until a level lets nothing through.

A key is listed iff the first level that rejects it is an even one (or none does
and the number of levels is odd): exact for every key of the universe.

Each filter is one row (an array of 64-bit words) that reaches the url scan as a
scalar subquery.  ``max_words`` bounds that row; a longer list is split by key
hash into groups, each with its own cascade, and the urls of a group are judged
in a scan that carries that group's filters only.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule and verdict allow; repeated rows get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

MAX_WORDS = 1 << 18          # 2 MB a filter
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(
            path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"),
                                    F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Level:
    seed: int
    hashes: int
    n_words: int
    words: DataFrame                 # one row: words array<bigint>

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = []
        for i in range(self.hashes):
            pos = F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.n_words * 64))
            word = F.get(words, F.floor(pos / 64).cast("int"))
            tests.append(F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)


def make_level(keys: DataFrame, n: int, fp: float, seed: int) -> Level:
    """A Bloom filter over the ``key`` column of ``keys`` (``n`` rows)."""
    hashes = max(1, round(math.log2(1 / fp)))
    n_words = max(1, math.ceil(n * hashes * 1.4427 / 64))
    pos = F.explode(F.array(*[
        F.pmod(F.xxhash64(F.lit(seed * 64 + i), F.col("key")), F.lit(n_words * 64))
        for i in range(hashes)]))
    bits = keys.select(pos.alias("pos")).select(
        F.floor(F.col("pos") / 64).alias("word"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bits"))
    every = keys.sparkSession.range(n_words).select(F.col("id").alias("word"),
                                                    F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(
        F.col("w.bits").alias("words"))
    return Level(seed, hashes, n_words, stored(row, "url-filter-level"))


@dataclass
class Cascade:
    """Exact membership for the keys of the universe it was built from."""
    levels: list[Level] = field(default_factory=list)

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(universe: DataFrame, seed: int = 1) -> Cascade:
    """``universe``: (key, listed), one row per key.  Every level needs one small
    aggregate and one count; the sets shrink geometrically."""
    keys = universe.where(F.col("key").isNotNull())
    sizes = keys.agg(F.count_if("listed").alias("yes"), F.count_if(~F.col("listed")).alias("no")).first()
    encode, other = keys.where("listed").select("key"), keys.where(~F.col("listed")).select("key")
    n, m, out = sizes["yes"], sizes["no"], Cascade()
    while n:
        # the first level is sized so that about as many false positives remain as keys
        fp = min(0.5, max(n / (2 * m), 2 ** -20)) if not out.levels and m else 1 / 16
        level = make_level(encode, n, fp, seed + len(out.levels))
        out.levels.append(level)
        if not m:
            break
        passed = stored(other.where(level.holds(F.col("key"))), "url-filter-keys")
        encode, other, n, m = passed, encode, passed.count(), n
    return out


def judge_listed(urls: DataFrame, universe: DataFrame, key: str,
                 max_words: int = MAX_WORDS) -> DataFrame:
    """``urls`` with a boolean ``listed`` for its column ``key``; ``universe`` is
    (key, listed) over every non-null key of ``urls``."""
    n = universe.where("listed").count()
    groups = max(1, math.ceil(n * 20 * 1.4427 / 64 / max_words))
    parts = []
    for g in range(groups):
        mine = lambda c: F.pmod(F.xxhash64(F.lit("group"), c), F.lit(groups)) == g
        cascade = build_cascade(universe.where(mine(F.col("key"))) if groups > 1 else universe,
                                seed=1 + 100 * g)
        rows = urls.where(mine(F.col(key))) if groups > 1 else urls
        parts.append(rows.withColumn("listed", F.coalesce(cascade.listed(F.col(key)), F.lit(False))))
    return reduce(DataFrame.unionByName, parts)


def named_on(col: str, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(col, "[.-]"), F.array(*[F.lit(w) for w in words]))


def filter_urls(pages: DataFrame, rules: list[Rule], listed_words: list[str],
                max_words: int = MAX_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed).

    A host is listed when one of ``listed_words`` is a ``-``-separated part of one
    of its labels, or when the rules block more of its pages than they allow.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    judged = urls.withColumn("hit", longest_rule(rules, F.col("host"), F.col("path")))
    universe = stored(judged.where(F.col("host") != "").groupBy(F.col("host").alias("key")).agg(
        F.count_if(F.col("hit.verdict") == "block").alias("blocked"),
        F.count_if(F.col("hit.verdict") == "allow").alias("allowed")).select(
        "key", (named_on("key", listed_words) | (F.col("blocked") > F.col("allowed"))).alias("listed")),
        "url-universe")
    out = judge_listed(judged, universe, "host", max_words)
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce("hit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
                      .alias("verdict"), "listed")


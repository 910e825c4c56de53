"""Operator 2, URL filter: an exact Bloom filter cascade over rule keys.

A key is a host suffix followed by a path prefix (``example.com/en/``).  The
key universe is every key that some URL of the corpus could match: one per
distinct (host labels, path length) shape among the rules.  Level 1 encodes
the listed keys, level 2 the universe's keys that level 1 passes wrongly,
level 3 the listed keys that level 2 passes, and so on until no error is
left; a key's membership is then decided by testing the levels in turn, in
plain column arithmetic and without a join.

The filters follow the rule list, not the corpus: level 1 takes
log2(universe / rules) bits a rule, so that level 2 encodes about as many
keys as there are rules.  Only DataFrame functions run on the main path.

Defined cases: a null URL, or one without ``://``, has an empty host and
path and no rule; repeated rows are judged alike and each kept; rows with a
null id are kept; extra columns are not read; an empty table or an empty
rule list is fine (every URL gets the default verdict); rules of one length
that fit the same URL: the one with more host characters.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Hashes of a level, each passing one wrong key in two.
FIRST_LEVEL_HASHES = 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, and the seeds of its hashes."""

    words: list[int]
    seeds: tuple[int, ...]

    def has(self, key: str) -> str:
        """SQL condition: the filter passes the key in column ``key``."""
        words = ", ".join(f"{w}L" if w != -1 << 63 else "shiftleft(1L, 63)" for w in self.words)
        tests = []
        for seed in self.seeds:
            at = _bit(key, seed, 64 * len(self.words))
            tests.append(f"getbit(element_at(array({words}), cast(floor({at} / 64) AS int) + 1), cast({at} % 64 AS int)) = 1")
        return "(" + " AND ".join(tests) + ")"


def _bit(key: str, seed: int, bits: int) -> str:
    return f"pmod(xxhash64({seed}, {key}), {bits}L)"


def make_level(keys: DataFrame, n: int, hashes: int, seed: int) -> Level:
    """The Bloom filter of ``n`` keys in the column ``key``: 1.44 bits a key and hash."""
    bits = 64 * max(1, math.ceil(1.4427 * hashes * n / 64))
    seeds = tuple(1000 * seed + i for i in range(hashes))
    rows = (keys.selectExpr(f"explode(array({', '.join(_bit('key', x, bits) for x in seeds)})) AS at")
            .groupBy(F.expr("cast(floor(at / 64) AS int) AS word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int))) AS bits")))
    words = [0] * (bits // 64)
    for r in rows.collect():  # at most one row a filter word: bounded by the rule list
        words[r["word"]] = r["bits"]
    return Level(words, seeds)


class Cascade:
    """Exact membership of a universe's keys in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: str) -> str:
        """SQL condition: a listed key leaves the levels at an even depth, any other key of the universe at an odd one."""
        out = str(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            out = f"CASE WHEN NOT {self.levels[depth].has(key)} THEN {depth % 2 == 1} ELSE {out} END"
        return out

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed``, ``universe``: distinct keys in a column ``key``."""
        n = listed.count()
        if not n:
            return Cascade([])
        total = universe.agg(F.approx_count_distinct("key")).first()[0]
        hashes = min(FIRST_LEVEL_HASHES, max(1, math.ceil(math.log2(max(2, total / n)))))
        levels = [make_level(listed, n, hashes, 1)]
        wrong = universe.filter(levels[0].has("key")).join(listed, "key", "left_anti").distinct()
        sides = [keep(wrong, "url-level"), listed]  # the side to encode next; the side it may pass wrongly
        while n := sides[0].count():
            levels.append(make_level(sides[0], n, 1, len(levels) + 1))
            sides = [sides[1].filter(levels[-1].has("key")), sides[0]]
            sides[0] = keep(sides[0], "url-level")
        return Cascade(levels)


def shapes(rules: list[Rule]) -> list[tuple[int, int]]:
    """(host labels, path length) of the keys to look up."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The URL's key of one shape, or null if it has none."""
    suffix = F.substring_index(host, ".", -labels)
    ends = F.size(F.split(host, r"\.", labels + 1)) >= labels
    return F.when(ends & (F.length(path) >= length), F.concat(suffix, F.substring(path, 1, length) if length else F.lit("")))


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (the longest that fits, else null), verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's.  ``default`` is the verdict without a rule (a key in no list).
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    keys = [candidate(F.col("host"), F.col("path"), *s) for s in shapes(rules)]
    cascades = {}
    if rules:
        # the same keys come up in most rows, so partial aggregation leaves few to shuffle
        universe = keep(rows.select(F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL").distinct(), "url-keys")
        for verdict in sorted({r.verdict for r in rules}):
            listed = spark.range(0, 1, 1, 1).select(F.explode(F.lit(sorted({r.key for r in rules if r.verdict == verdict}))).alias("key"))
            cascades[verdict] = Cascade.build(listed, universe)
    if not rules:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # a column per key and then per verdict: each is worked out once
    rows = rows.withColumns({f"key{i}": k for i, k in enumerate(keys)})
    rows = rows.selectExpr("*", *[f"{_verdict(f'key{i}', cascades)} AS verdict{i}" for i in range(len(keys))])
    found = [F.expr(f"CASE WHEN verdict{i} IS NOT NULL THEN struct(length(key{i}) AS n, length(key{i}) - {length} AS host_length, key{i} AS key, verdict{i} AS verdict) END")
             for i, (_, length) in enumerate(shapes(rules))]
    rows = rows.withColumn("best", F.array_max(F.array(*found)))
    return rows.select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _verdict(key: str, cascades: dict[str, Cascade]) -> str:
    cases = " ".join(f"WHEN {c.has(key)} THEN '{name}'" for name, c in cascades.items())
    return f"CASE WHEN {key} IS NULL THEN NULL {cases} END"

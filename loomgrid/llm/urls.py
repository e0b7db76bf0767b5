"""URL filters: a Bloom filter cascade over the corpus's whole key universe, beside ordered allow and block rules.

The universe is every host of the corpus and every parent domain of one. Level 1 holds the listed keys, level 2 the
universe's keys that level 1 wrongly lets through, level 3 the listed keys that level 2 lets through, and so on until a
level lets nothing through wrongly. Membership of any key of the universe is then exact: the first level that rejects a
key decides by its parity.

A filter's words are one row of a table: Spark fills them by an aggregate over keys, and they reach the pages as a scalar
subquery, one value for all rows of a task, so a page costs the bits that it asks for. Listed keys that no page has are left out
first. A list whose filters would outgrow ROW_BYTES is dealt by hash over several cascades, each of which is asked in turn.
Pages are never shuffled and no key is joined to them.

Defined results: a null url or one without '://' has empty host and path, fits no rule and no key, and is allowed;
repeated rows each get a row; other columns are dropped, also those named like a result; an empty list lists nothing; an empty table gives no rows; null
and empty keys of a list are passed over. A very long url is one string of one row. Of equally long rules that of the
longer host is taken, then a block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, drop_since, let, made, materialize

#: Domains that are listed as unwanted. A listed key covers its subdomains.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The words of one cascade's filters take at most about this size.
ROW_BYTES = 32 << 20
#: Words are put together in pieces of this many.
PIECE = 4096


def url_parts(url: Column) -> Column:
    """struct(host, path): host with A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    return F.struct(F.when(known, F.translate(raw, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lit("")).alias("host"), F.when(known, path).otherwise(F.lit("")).alias("path"))


def suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host, "\\.")
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int

    def position(self, key: Column, level: int, j: int) -> Column:
        # level and place first: keys of equal hash would else clash at every level
        return F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(self.bits).cast("long"))

    def holds(self, key: Column, level: int, filled: Column) -> Column:
        out = F.lit(True)
        for j in range(self.hashes):
            p = self.position(key, level, j)
            word = F.get(filled, F.floor(p / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def fill(keys: DataFrame, level: int, shape: Level, name: str) -> DataFrame:
    """One row, column name: the words of a filter over the column key. Words without a bit are 0."""
    at = keys.select(F.explode(F.array(*[shape.position(F.col("key"), level, j) for j in range(shape.hashes)])).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    set_ = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(one).alias("b"))
    every = keys.sparkSession.range(-(-shape.bits // 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = every.unionByName(set_).groupBy("w").agg(F.bit_or("b").alias("b"))
    pieces = words.groupBy(F.floor(F.col("w") / PIECE).alias("piece")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return pieces.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "words"))), lambda x: x["words"])).alias(name))


@dataclass(frozen=True)
class Cascade:
    """words: of each level, one row with an array."""

    levels: tuple[Level, ...]
    words: tuple[DataFrame, ...]

    def marked(self, df: DataFrame, name: str, keys: Column) -> DataFrame:
        """df with name: whether it was true, or one of an array of keys of the universe is listed; exact.

        The words are columns that one expression alone reads, over a table's own columns, so the optimiser puts the
        subqueries into it and no row carries them.
        """
        wide = df.select("*", *[w.scalar().alias(f"__level{n}") for n, w in enumerate(self.words, 1)])
        filled = F.struct(keys.alias("keys"), *[F.col(f"__level{n}").alias(f"level{n}") for n in range(1, len(self.words) + 1)])
        found = let(filled, lambda s: F.exists(s["keys"], lambda k: self._member(k, s)))
        return wide.select(*[c for c in df.columns if c != name], (F.col(name) | found).alias(name))

    def _member(self, key: Column, filled: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[n - 1].holds(key, n, filled[f"level{n}"]), F.lit(n % 2 == 0)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, inside: DataFrame) -> Cascade:
    """universe: distinct strings in column key, null excluded; inside: those that are listed. Levels end when one lets nothing through wrongly."""
    r = inside.count()
    if not r:
        return Cascade((), ())
    outside = materialize(universe.join(inside, "key", "left_anti"), "outside")
    rate = min(0.5, r / (math.sqrt(2) * max(1, outside.count())))
    levels: list[Level] = []
    filled: list[DataFrame] = []
    include, exclude, n_in = inside, outside, r
    while n_in:
        n = len(levels) + 1
        # a level's hash differs from the last one's, so what is let through is halved each time
        shape = Level(max(64, math.ceil(n_in * math.log2(1 / rate) / math.log(2) + 1)), max(1, round(math.log2(1 / rate))))
        levels.append(shape)
        filled.append(materialize(fill(include, n, shape, f"level{n}"), f"filter{n}"))
        wrong = materialize(exclude.where(shape.holds(F.col("key"), n, filled[-1].scalar())).select("key"), f"cascade{n}")
        n_in = wrong.count()
        include, exclude, rate = wrong, include, 0.5
    return Cascade(tuple(levels), tuple(filled))


def cascade_parts(universe_keys: int, listed_keys: int) -> int:
    """Cascades that a list is dealt over, so that the words of each stay in ROW_BYTES."""
    if not listed_keys:
        return 1
    rate = min(0.5, listed_keys / (math.sqrt(2) * max(1, universe_keys)))
    # a first level, and later ones that together hold about three bits a listed key
    bits = listed_keys * (math.log2(1 / rate) / math.log(2) + 3)
    return max(1, math.ceil(bits / 8 / ROW_BYTES))


def rule_text(rule: tuple[str, str, str]) -> str:
    return f"{rule[1]}{rule[2]}"


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equally long ones the first by host length, then block."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda x: (len(rule_text(x)), len(x[1]), x[0] == "block")):
        fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        out = F.when(fits, F.struct(F.lit(rule_text(rule)).alias("rule"), F.lit(rule[0]).alias("verdict"))).otherwise(out)
    return out


def url_filter(pages: DataFrame, *, listed: Sequence[str] | DataFrame = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, parts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (whether a cascade holds the host or a parent of it).

    listed: domains, as strings or as a table with one column. parts: cascades, if not as many as the list needs.
    """
    spark, mark = pages.sparkSession, made()
    keys = listed.toDF("key") if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    keys = materialize(keys.where(F.length("key") > 0).distinct(), "listed")
    split = materialize(pages.select("page_id", url_parts(F.col("url")).alias("u")).select("page_id", "u.host", "u.path"), "pages")
    hosts = split.select("host").where(F.col("host") != "").distinct()
    universe = materialize(hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "hosts")
    keys = materialize(keys.join(universe, "key", "left_semi"), "listed")
    parts = parts or cascade_parts(universe.count(), keys.count())
    out, words = split.withColumn("listed", F.lit(False)), []
    for k in range(parts):
        mine = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == k
        cascade = build_cascade(universe.where(mine), keys.where(mine))
        if not cascade.levels:
            continue
        own = F.filter(suffixes(F.col("host")), lambda s: F.pmod(F.xxhash64(s, F.lit(-1)), F.lit(parts)) == k)
        words += cascade.words
        out = cascade.marked(out, "listed", own)
        if parts > 1:
            out = materialize(out, "pages")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    out = out.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")
    return drop_since(mark, out, *words)

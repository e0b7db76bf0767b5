"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Documents of a source stand one after another, in the order of a hash of their ids, and are cut into blocks of as many words
(the source's last one may be shorter). A source's quota is the number of blocks that its target takes: whole passes over
its blocks and a part of one more, the last block cut where the target ends. Each pass takes the blocks in an order of its
own, a permutation that is a formula, so nothing is stored for it.

Quotas are dealt over output shards by a tree. A node holds one number a source and halves its shards; how many blocks
of each source go to the left half is a multivariate hypergeometric draw of exactly the half's blocks, as if the node's
blocks were shuffled and cut in two. Sums are exact on every level. A shard's part of a source is then a range of that
source's blocks in the order of its passes, so shards are disjoint, and each is shuffled by itself.

Documents are shuffled as ids and sizes, by ranges of (source, hash), so that a source of most rows is spread; their texts
are read for sizes alone unless carried. The sources of one node are one row: a mix names its sources. The tree's rows are
spread over tasks as soon as there are many.

Defined results: a null or blank text has size 0 and is never taken; null is a source like others and comes last; a null
doc_id stays null; repeated rows each get a row, and count each; of rows of equal ids those of smaller text hash stand first;
other columns are dropped unless carried, also those named like a result; an empty table gives no rows. A very long text
lies in many blocks, and a shard may hold a part of it; blocks of one source may number up to 2^31.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_since, let, made, materialize, partitions_for

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Primes; the first that doesn't divide a number of blocks gives the step of a pass through them.
STEPS = (2147483647, 2147483629, 2147483587)
#: Draws of a source that are looked up together.
LOOKUP = 256
#: Levels of the tree that one task makes before its nodes are dealt anew.
LEVELS = 8


@dataclass(frozen=True)
class Mix:
    """documents: row (range, at), doc_id, source, size, source_size, target, start (words of the source before it), carried.
    sources: a row each, with its quota. quotas: shard, no (of the source), first (draw) and blocks.
    pieces: shard, no, draw, range, at, pass, first_word, words: a stretch of a document's words in a shard."""

    documents: DataFrame
    sources: DataFrame
    quotas: DataFrame
    pieces: DataFrame


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with no (in order, null last), weight and target.

    Targets share `share` of all words by weight. One that would exceed most times its source stops there, and the rest
    is shared by the others. In order of size for weight, the first source that needn't stop tells the words a unit of weight.
    """
    s = sources.withColumn("no", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long"))
    s = s.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("no", F.lit(len(weights))).cast("int")).cast("double"))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(most))).withColumn("rank", F.row_number().over(Window.orderBy(F.col("top") / F.col("weight"), "no")))
    ordered = Window.orderBy("rank")
    below = F.coalesce(F.sum("top").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    every = F.sum("source_size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("unit", (every * F.lit(float(share)) - below) / above)
    free = F.when(F.col("unit") * F.col("weight") <= F.col("top"), F.struct("rank", "unit"))
    s = s.withColumn("unit", F.min(free).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["unit"])
    return s.withColumn("target", F.coalesce(F.least("top", F.col("unit") * F.col("weight")), F.col("top"))).drop("rank", "top", "unit")


def place_in_pass(block: Column, turn: Column, blocks: Column, no: Column) -> Column:
    """Where a pass takes a block: a permutation of 0 to blocks - 1."""
    step = F.lit(None).cast("long")
    for k in range(len(STEPS)):
        own = F.lit(None).cast("long")
        for j in range(len(STEPS) - 1, -1, -1):
            p = STEPS[(k + j) % len(STEPS)]
            own = F.when(F.lit(p) % blocks != 0, F.lit(p).cast("long")).otherwise(own)
        step = F.when(turn % len(STEPS) == k, own).otherwise(step)
    return F.when(blocks == 1, F.lit(0).cast("long")).otherwise((step % blocks * block + no * 7919 + turn * 104729) % blocks)


def quota(sources: DataFrame, block: int) -> DataFrame:
    """sources with blocks (in one pass), draws (the quota in blocks) and cut (words that the last draw leaves out)."""
    full = F.expr(f"CAST(ceil(source_size / {block}) AS BIGINT)")
    s = sources.where("source_size > 0").withColumn("blocks", full).withColumn("take", F.floor("target"))
    s = s.withColumn("passes", F.expr("take div source_size")).withColumn("rest", F.expr("take % source_size"))
    lack = F.col("blocks") * block - F.col("source_size")
    s = s.withColumn("short_at", place_in_pass(F.col("blocks") - 1, F.col("passes"), F.col("blocks"), F.col("no"))).withColumn("lack", lack)
    s = s.withColumn("part", F.ceil(F.col("rest") / block).cast("long"))
    s = s.withColumn("part", F.when(F.col("short_at") < F.col("part"), F.ceil((F.col("rest") + F.col("lack")) / block).cast("long")).otherwise(F.col("part")))
    drawn = F.col("part") * block - F.when(F.col("short_at") < F.col("part"), F.col("lack")).otherwise(0)
    return s.withColumn("cut", F.when(F.col("part") > 0, drawn - F.col("rest")).otherwise(F.lit(0)).cast("long")).withColumn("draws", F.expr("passes * blocks + part")).drop("passes", "rest", "short_at", "lack", "part", "take")


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` draws out of good + bad are good, for u uniform in [0, 1): the inverse of the distribution.

    Weights are taken relative to the mode's and summed outwards from it, ten standard deviations to both sides, beyond which
    a weight is lost in the sum's rounding; then they are used up in the same order.
    """

    def from_shape(s: Column) -> Column:
        lo, hi = F.greatest(F.lit(0).cast("long"), s["m"] - s["b"]), F.least(s["g"], s["m"])
        n = s["g"].cast("double") + s["b"]
        mode = F.least(hi, F.greatest(lo, F.floor((s["m"] + 1.0) * (s["g"] + 1.0) / (n + 2.0))))
        spread = F.sqrt(s["m"] * (s["g"] / n) * (s["b"] / n) * (n - s["m"]) / F.greatest(n - 1.0, F.lit(1.0)))
        steps = F.least(hi - lo, F.ceil(spread * 10) + 20)
        return F.when(hi <= lo, lo).otherwise(let(F.struct(s["g"].alias("g"), s["b"].alias("b"), s["m"].alias("m"), s["u"].alias("u"), mode.alias("mode"), F.sequence(F.lit(1).cast("long"), steps).alias("steps")), from_mode))

    def from_mode(s: Column) -> Column:
        def rise(k: Column) -> Column:
            return (s["g"] - k).cast("double") * (s["m"] - k) / ((k + 1).cast("double") * (s["b"] - s["m"] + k + 1))

        def fall(k: Column) -> Column:
            return k.cast("double") * (s["b"] - s["m"] + k) / ((s["g"] - k + 1).cast("double") * (s["m"] - k + 1))

        def start(**more: Column) -> Column:
            one = F.lit(1.0)
            return F.struct(s["mode"].alias("up"), one.alias("wu"), s["mode"].alias("down"), one.alias("wd"), *[c.alias(n) for n, c in more.items()])

        def walk(a: Column) -> tuple[Column, Column, Column, Column]:
            # weights are 0 from the ends of the range on, where a ratio would be of no meaning
            return a["up"] + 1, F.when(a["wu"] > 0, a["wu"] * rise(a["up"])).otherwise(0.0), a["down"] - 1, F.when(a["wd"] > 0, a["wd"] * fall(a["down"])).otherwise(0.0)

        def add(a: Column, _: Column) -> Column:
            up, wu, down, wd = walk(a)
            return let(F.struct(up.alias("up"), wu.alias("wu"), down.alias("down"), wd.alias("wd"), a["z"].alias("z")), lambda x: F.struct(x["up"], x["wu"], x["down"], x["wd"], (x["z"] + x["wu"] + x["wd"]).alias("z")))

        def use(a: Column, _: Column) -> Column:
            up, wu, down, wd = walk(a)
            moved = F.struct(up.alias("up"), wu.alias("wu"), down.alias("down"), wd.alias("wd"), a["left"].alias("left"))

            def settle(x: Column) -> Column:
                here = F.when(x["left"] < x["wu"], x["up"]).when(x["left"] < x["wu"] + x["wd"], x["down"])
                return F.struct(x["up"], x["wu"], x["down"], x["wd"], (x["left"] - x["wu"] - x["wd"]).alias("left"), here.alias("found"))

            return F.when(a["found"].isNotNull(), a).otherwise(let(moved, settle))

        total = F.aggregate(s["steps"], start(z=F.lit(1.0)), add, lambda a: a["z"])
        return let(
            s["u"] * total - 1.0,
            lambda left: F.when(left < 0, s["mode"]).otherwise(F.coalesce(F.aggregate(s["steps"], start(left=left, found=F.lit(None).cast("long")), use, lambda a: a["found"]), s["mode"])),
        )

    return let(F.struct(good.cast("long").alias("g"), bad.cast("long").alias("b"), drawn.cast("long").alias("m"), u.alias("u")), from_shape)


def to_left(counts: Column, drawn: Column, seed: int, lo: Column, hi: Column) -> Column:
    """How many blocks of each source are among `drawn` of all counts: each source in turn against all that follow."""

    def one(a: Column, c: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), lo, hi, F.size(a["out"])), 11) / F.lit(float(1 << 53))
        x = hypergeometric(c, a["rest"] - c, a["m"], u)
        return let(x, lambda x: F.struct((a["m"] - x).alias("m"), (a["rest"] - c).alias("rest"), F.concat(a["out"], F.array(x)).alias("out")))

    all_ = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    return F.aggregate(counts, F.struct(drawn.alias("m"), all_.alias("rest"), F.array().cast("array<bigint>").alias("out")), one, lambda a: a["out"])


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, no, first, blocks: the source's draws first to first + blocks - 1 go to the shard. sources: no, draws."""
    spark = sources.sparkSession
    row = sources.agg(F.sort_array(F.collect_list(F.struct("no", "draws"))).alias("s"))
    nodes = row.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("s", lambda x: x["no"]).alias("no"), F.transform("s", lambda x: F.lit(0).cast("long")).alias("first"), F.transform("s", lambda x: x["draws"]).alias("n"))
    for level in range(max(0, shards - 1).bit_length()):
        if level and level % LEVELS == 0:
            nodes = materialize(nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lo"), "nodes")
        nodes = nodes.withColumn("mid", F.expr("lo + (hi - lo) div 2")).withColumn("all", F.aggregate("n", F.lit(0).cast("long"), lambda a, c: a + c))
        nodes = nodes.withColumn("x", F.when(F.col("mid") > F.col("lo"), to_left(F.col("n"), F.expr("all * (mid - lo) div (hi - lo)"), seed, F.col("lo"), F.col("hi"))))
        left = F.struct("lo", F.col("mid").alias("hi"), "no", "first", F.col("x").alias("n"))
        right = F.struct(F.col("mid").alias("lo"), "hi", "no", F.zip_with("first", "x", lambda f, x: f + x).alias("first"), F.zip_with("n", "x", lambda n, x: n - x).alias("n"))
        same = F.struct("lo", "hi", "no", "first", "n")
        nodes = nodes.select(F.explode(F.when(F.col("x").isNull(), F.array(same)).otherwise(F.array(left, right))).alias("v")).select("v.*")
    parts = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("no", "first", F.col("n").alias("blocks"))).alias("q"))
    return parts.select("shard", "q.no", "q.first", "q.blocks").where("blocks > 0")


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096, shard_words: int = 1 << 23, seed: int = 11, carry: Sequence[str] = ()) -> Mix:
    """See Mix. weights repeat over the sources in order; share: the mix's words for each of the corpus's; most: passes over a source at most."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    order = [F.col("source").isNull(), "source", "h", "tie"]
    placed = sized.repartitionByRange(partitions_for(docs, 256 << 20), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    # ranges are sampled: what is numbered must be what is written
    placed = materialize(placed.withColumn("range", F.expr("shiftright(id, 33)")).withColumn("at", F.expr("id & 8589934591L")).drop("id", "h", "tie"), "placed")
    parts = materialize(placed.groupBy("range", "source").agg(F.sum("size").alias("n")), "parts")
    sources = materialize(targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), "sources")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    bases = parts.select("range", "source", before.alias("base")).withColumnsRenamed({"range": "r", "source": "s"})
    own = F.sum("size").over(Window.partitionBy("range", "source").orderBy("at")) - F.col("size")
    known = sources.join(bases, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    # ranges + sources rows at most: Spark broadcasts them while their size on disk allows it
    documents = placed.withColumn("own", own).join(materialize(known, "known"), (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    documents = documents.select("range", "at", "doc_id", "source", "no", "size", "source_size", "target", (F.col("base") + F.col("own")).alias("start"), *[f"carried_{c}" for c in carry])

    quoted = materialize(quota(sources, block), "quoted")
    words = quoted.agg(F.sum("target")).first()[0] or 0
    quotas = materialize(split_quotas(quoted, max(1, math.ceil(words / shard_words)), seed), "quotas")

    slim = documents.where("size > 0").select("range", "at", "no", "size", "start").join(quoted.select("no", "blocks", "draws", "cut", F.col("source_size").alias("all")), "no")
    each = slim.withColumn("b", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most) - 1).cast("long"))))
    each = each.withColumn("draw", F.col("pass") * F.col("blocks") + place_in_pass(F.col("b"), F.col("pass"), F.col("blocks"), F.col("no"))).where("draw < draws")
    end = F.least((F.col("b") + 1) * block, "all") - F.when(F.col("draw") == F.col("draws") - 1, F.col("cut")).otherwise(0)
    each = each.withColumn("from", F.greatest("start", F.col("b") * block)).withColumn("to", F.least(F.col("start") + F.col("size"), end)).where("to > from")
    each = each.select("no", "draw", "range", "at", "pass", (F.col("from") - F.col("start")).alias("first_word"), (F.col("to") - F.col("from")).alias("words"))
    spans = quotas.withColumn("part", F.explode(F.expr(f"sequence(first div {LOOKUP}, (first + blocks - 1) div {LOOKUP})"))).withColumnRenamed("no", "own")
    inside = (F.col("no") == F.col("own")) & (F.expr(f"draw div {LOOKUP}") == F.col("part")) & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("blocks"))
    pieces = each.join(spans, inside).select("shard", "no", "draw", "range", "at", "pass", "first_word", "words")
    return Mix(documents, quoted, quotas, pieces)


def shuffled(mix: Mix, seed: int = 11) -> DataFrame:
    """pieces with order: the place in the shard, whose pieces are shuffled by themselves."""
    key = F.xxhash64(F.lit(seed), "no", "draw", "range", "at")
    return mix.pieces.withColumn("order", F.row_number().over(Window.partitionBy("shard").orderBy(key, "no", "draw", "range", "at")) - 1)


def mixed_texts(mix: Mix, seed: int = 11) -> DataFrame:
    """shard, order, doc_id, source, text: the words of each piece, joined by one blank. The mix must carry text."""
    words = F.regexp_extract_all(F.coalesce("carried_text", F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    text = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    return shuffled(mix, seed).join(mix.documents.drop("no"), ["range", "at"]).select("shard", "order", "doc_id", "source", text.alias("text"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of a document, repeats counted."""
    mark = made()
    mix = mix_sources(docs, **options)
    sums = mix.pieces.groupBy("range", "at").agg(F.sum("words").alias("taken"))
    out = mix.documents.join(sums, ["range", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return drop_since(mark, out)

"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression.

Statistics of a text are array and string functions inside one projection: no shuffle, no Python. The list is learned
from a bounded sample of labelled rows: rules are grown one threshold at a time on two thirds of the sample, pruned on
the last third, and kept while they are precise enough.

Defined results: a null or blank text has no words and every statistic 0, so it fails the base rule; repeated rows each
get their own row; null doc_id stays null; other columns of the input and of the labels are dropped, also those named like a result; an empty table gives no rows; without
labels of both kinds the list is empty and only the base rule decides. A very long text costs n log n in one task. A
document of several labels counts as bad if one says so; of equal gains the condition that comes first by feature name
and threshold is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, let

SPACE_RUN = "[\\x20\\x09-\\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def repeated_trigram_words(words: Column, least_bits: int = 0) -> Column:
    """Words of an array that lie in a window of three found twice or more.

    Windows are hashed, and (hash prefix, position) packed into one long is sorted, so equal windows become neighbours.
    Where a prefix meets two different hashes, as in texts of millions of words, whole (hash, position) pairs are sorted
    instead, which costs more for each: n log n for any text.
    """

    def over_hashes(tri: Column) -> Column:
        bits = F.greatest(F.ceil(F.log2(F.size(tri) + F.lit(1.0))).cast("int"), F.lit(least_bits))
        # the shift's operand order is (value, places)
        return let(F.struct(tri.alias("tri"), F.expr("1").alias("one"), bits.alias("bits")), with_bits)

    def with_bits(s: Column) -> Column:
        tri = s["tri"]
        mask = F.call_function("shiftleft", F.lit(-1).cast("long"), s["bits"])
        return let(mask, lambda m: let(F.sort_array(F.transform(tri, lambda h, i: h.bitwiseAND(m).bitwiseOR(i.cast("long")))), lambda packed: positions(tri, m, packed)))

    def positions(tri: Column, m: Column, packed: Column) -> Column:
        def at(x: Column) -> Column:
            return F.get(tri, (x.bitwiseAND(F.bitwise_not(m))).cast("int"))

        def same(a: Column, b: Column) -> Column:
            return F.coalesce(at(a) == at(b), F.lit(False))

        near = F.filter(packed, lambda x, j: same(x, F.get(packed, j - 1)) | same(x, F.get(packed, j + 1)))
        found = F.sort_array(F.transform(near, lambda x: x.bitwiseAND(F.bitwise_not(m)).cast("int")))
        clash = F.exists(F.transform(packed, lambda x, j: F.coalesce((x.bitwiseAND(m) == F.get(packed, j + 1).bitwiseAND(m)) & (at(x) != at(F.get(packed, j + 1))), F.lit(False))), lambda b: b)
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column, x: Column, j: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))

        slow = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: again(s, x, j)), lambda x: x["i"])))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.when(clash, slow).otherwise(found),
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda hw: F.when(F.size(hw) < 4, F.lit(0)).otherwise(let(F.transform(F.slice(hw, 3, F.greatest(F.size(hw), F.lit(3))), lambda h, i: F.xxhash64(F.get(hw, i), F.get(hw, i + 1), h)), lambda tri: F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(over_hashes(tri)))))

    return of_words(words)


def text_stats(text: Column) -> Column:
    """A struct of STATS for a text."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE_RUN), "")

    def lines_of(s: Column) -> Column:
        return F.filter(F.split(s, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))

    return let(
        F.struct(words.alias("w"), lines_of(t).alias("l"), t.alias("t")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(s["t"], "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            repeated_trigram_words(s["w"]).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(s["t"], "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.size(s["l"]).cast("long").alias("n_lines"),
        ),
    )


def feature_columns() -> dict[str, Column]:
    """What the rules may test, from STATS; all are 0 for a text without words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """Texts that meet every (feature, side, threshold) are dropped; side is '>' or '<='."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, side, at in self.conditions:
            out = out & ((features[name] > F.lit(at)) if side == ">" else (features[name] <= F.lit(at)))
        return out


def learn_rules(rows: list[tuple[bool, dict[str, float]]], *, max_rules: int = 8, max_conditions: int = 3, thresholds: int = 48, min_precision: float = 0.9, min_cover: int = 3) -> list[Rule]:
    """Sequential covering. rows: (is bad, features). Sets of rows are bit masks, so a candidate costs two ANDs."""
    if not rows or not any(b for b, _ in rows) or all(b for b, _ in rows):
        return []
    names = sorted(rows[0][1])
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, (b, _) in enumerate(rows) if b)
    prune = sum(1 << i for i in range(len(rows)) if i % 3 == 2)
    grow = everything & ~prune
    masks: dict[tuple[str, str, float], int] = {}
    for name in names:
        order = sorted(range(len(rows)), key=lambda i: rows[i][1][name])
        values = [rows[i][1][name] for i in order]
        cuts = sorted({values[min(len(values) - 1, len(values) * q // thresholds)] for q in range(1, thresholds)} | {values[0]})
        below, at, j = 0, 0, 0
        for cut in cuts:
            while j < len(order) and values[j] <= cut:
                below |= 1 << order[j]
                j += 1
            masks[name, "<=", cut] = below
            masks[name, ">", cut] = everything & ~below
            at += 1

    def precision(mask: int) -> float:
        return ((mask & bad).bit_count() + 1) / (mask.bit_count() + 2)

    left, rules = everything, []
    while len(rules) < max_rules:
        chosen: list[tuple[str, str, float]] = []
        mask = left & grow
        if not (mask & bad):
            break
        while len(chosen) < max_conditions:
            now, best = precision(mask), None
            for cond in masks:
                m = mask & masks[cond]
                hits = (m & bad).bit_count()
                if hits < min_cover or cond in chosen:
                    continue
                gain = hits * (precision(m) - now)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, cond, m)
            if best is None:
                break
            chosen.append(best[1])
            mask = best[2]
        while len(chosen) > 1:  # prune: drop a condition while the held-back third is no worse for it
            def on_prune(conds: list) -> float:
                m = left & prune
                for c in conds:
                    m &= masks[c]
                return precision(m)

            whole = on_prune(chosen)
            shorter = max(([c for c in chosen if c != d] for d in chosen), key=on_prune)
            if on_prune(shorter) < whole:
                break
            chosen = shorter
        mask = left
        for c in chosen:
            mask &= masks[c]
        if not chosen or precision(mask) < min_precision or (mask & bad).bit_count() < min_cover:
            break
        rules.append(Rule(tuple(chosen), precision(mask), mask.bit_count()))
        left &= ~mask
    return rules


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The number of the first rule that drops a text, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(features), F.lit(i)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[tuple[bool, dict[str, float]]]:
    """At most max_labelled labelled documents, chosen by hashes of ids and rows; only those texts are measured."""
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["quality"])) for r in bounded_rows(picked, max_labelled)], "doc_id long, quality int")
    # at most max_labelled ids
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("s", text_stats(F.col("text"))).select("doc_id", "quality", "s.*")
    features = feature_columns()
    got = bounded_rows(joined.select("doc_id", "quality", *[c.alias(k) for k, c in features.items()]), max_labelled)
    got.sort(key=lambda r: (r["doc_id"], tuple(r[k] for k in features)))
    return [(r["quality"] == 0, {k: r[k] for k in features}) for r in got]


def quality_rules(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, STATS, base_failed, rule (the number of the rule that drops the text) and kept."""
    rules = learn_rules(labelled_sample(docs, labels, max_labelled))
    stats = docs.select("doc_id", text_stats(F.col("text")).alias("s")).select("doc_id", *[F.col(f"s.{k}").alias(k) for k in STATS])
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = stats.withColumn("base_failed", base).withColumn("rule", verdict(rules, feature_columns()))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())

"""License scans by diagonal voting.

Every rolling k-gram of words is hashed and joined to the positions of the templates' own k-grams; a match counts if its
words are the template's, too. It votes for the diagonal (position in the text minus position in the template). Votes on
one diagonal are a run of the template's words; neighbouring diagonals are one span with words put in or left out. A span
is verified by the share of its template's k-grams that it holds, each counted once. The fixed base phrases are templates
whose every k-gram must be on one diagonal.

The template side of the join is a constant of the plan. Each text sends one row and its matches to the aggregates, keyed
by row, so no phrase gathers the corpus; windows and aggregates of a row's matches are sorted, never held in an array.

Defined results: null or wordless text has 0 words, empty labels and score 0; a repeated row is scanned on its own; null
doc_id stays null; other columns are dropped, also those named like a result; an empty table gives no rows. A very long text costs its words once and its
matches n log n in one task. Spans of several templates may share words; each counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, lower_ascii, partitions_for

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K = 3
#: The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Well-known notices; several may share a label.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


def gram_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def template_rows(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, bool, int, list[str]]]:
    """(number from 1, label, whether it is a base phrase, k-grams, words) of each template; base phrases come first."""
    rows = []
    for n, (label, text, base) in enumerate([*((lb, t, True) for t, lb in phrases), *((lb, t, False) for lb, t in templates)], 1):
        w = words_of(text)
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows.append((n, label, base, len(w) - K + 1, w))
    return rows


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """The templates' k-grams: h, t_gram, tmpl, label, base, need, tpos."""
    rows = [(n, label, base, need, i, *w[i : i + K]) for n, label, base, need, w in template_rows(phrases, templates) for i in range(need)]
    df = spark.createDataFrame(rows, "tmpl int, label string, base boolean, need int, tpos int, a string, b string, c string")
    words = [F.col(c) for c in "abc"]
    return df.select(gram_hash(*words).alias("h"), F.concat_ws(" ", *words).alias("t_gram"), "tmpl", "label", "base", "need", "tpos")


def license_scan(docs: DataFrame, *, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, min_share: float = 0.7, max_shift: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, last, share)."""
    grams = template_grams(docs.sparkSession, phrases, templates)
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(lower_ascii(t), BREAKS), "")

    def rolling(w: Column) -> Column:
        each = F.transform(F.slice(w, K, F.greatest(F.size(w), F.lit(K))), lambda c, i: F.struct(gram_hash(F.get(w, i), F.get(w, i + 1), c).alias("h"), F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), c).alias("gram")))
        none = F.array().cast("array<struct<h:bigint,gram:string>>")
        return F.struct(F.size(w).cast("long").alias("n"), F.when(F.size(w) >= K, each).otherwise(none).alias("g"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(words, rolling).alias("s")).select("row", "doc_id", F.col("s.n").alias("n_words"), F.col("s.g").alias("g"))
    # position -1 stands for the row itself, so that a text without a match is not lost
    lead = F.array(F.lit(None).cast("struct<h:bigint,gram:string>"))
    each = rows.select("row", "doc_id", "n_words", F.posexplode(F.concat(lead, F.col("g"))).alias("p", "x")).select("row", "doc_id", "n_words", (F.col("p") - 1).alias("at"), "x.h", "x.gram")
    # some hundred rows of constants
    voted = each.join(F.broadcast(grams), "h", "left").where((F.col("at") < 0) | (F.col("gram") == F.col("t_gram")))
    votes = voted.select("row", "doc_id", "n_words", F.coalesce("tmpl", F.lit(0)).alias("tmpl"), "label", "base", "need", "tpos", "at", (F.col("at") - F.coalesce("tpos", F.lit(0))).alias("diag"))
    # the window and both aggregates use this partitioning
    dealt = votes.repartition(partitions_for(docs, 64 << 20), "row")
    w = Window.partitionBy("row", "tmpl").orderBy("diag", "at")
    near = (F.col("diag") - F.lag("diag").over(w) <= max_shift) & (F.col("at") - F.lag("at").over(w) <= K + max_shift)
    new = F.when(F.col("diag") == F.lag("diag").over(w), 0).when(F.col("base"), 1).otherwise(F.when(near, 0).otherwise(1))
    spans = dealt.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "doc_id", "n_words", "tmpl", "label", "base", "need", "span").agg(F.count_distinct("tpos").alias("hits"), F.min("diag").cast("long").alias("diag"), F.min("at").cast("long").alias("first"), (F.max("at") + K - 1).cast("long").alias("last"))
    share = F.when(F.col("tmpl") > 0, F.col("hits") / F.col("need"))
    place, found = F.col("base") & (F.col("hits") == F.col("need")), ~F.col("base") & (share >= min_share)
    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("diag"))).alias("first_word"),
        F.max(F.when(place, F.col("diag"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(place | found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(place, 1.0).when(~F.col("base"), share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, F.struct("label", "first", "last", share.alias("share"))))).alias("spans"),
    )
    return out.drop("row")

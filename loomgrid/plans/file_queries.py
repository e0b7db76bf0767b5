"""Queries of binary files: written from the derived tables, read back, and held to those tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import lexicon as x
from loomgrid.sources import bookfile as b
from loomgrid.sources import domain as d
from loomgrid.sources import mapfile as m
from loomgrid.plans.tables import materialize

from .registry import query

PER_FILE, PER_BOOK = 16, 1000
TAGS = {"header": b"MAPS", "version": b"derived/1"}
BOOK_TAGS = {"header": b"BOOK", "version": b"derived/1"}


def sets(spark, sf, **options):
    return materialize(m.write_map_sets(d.runs(spark, sf), d.maps(spark, sf), d.UNIT, d.UNIT, **TAGS, **options), "sets")


def numbered(df):
    """map_ord of all files, from a file's number and the place in it."""
    return df.withColumn("map_ord", F.col("file").cast("bigint") * PER_FILE + F.col("map_ord"))


#: Files number maps from their first one on; suppliers' keys have no gaps.
FIRST = "WITH f AS (SELECT map_ord // 16 AS file, min(map_ord) AS m FROM maps GROUP BY 1)"


@query("file_map_set", "maps runs", f"{FIRST} SELECT file * 16 + map_ord - m AS map_ord, y, x0, len, code FROM runs JOIN f ON file = map_ord // 16")
def file_map_set(spark, sf):
    """Every run of every map, out of map sets of 16 maps."""
    return numbered(m.decode_images(m.index_images(sets(spark, sf)))).select("map_ord", "y", "x0", "len", "code")


@query("file_map_index", "maps", f"{FIRST} SELECT file * 16 + map_ord - m AS map_ord, 100::BIGINT AS unit_x, 100::BIGINT AS unit_y, west, south, width, height FROM maps JOIN f ON file = map_ord // 16")
def file_map_index(spark, sf):
    """What an indexed opening knows of each map; no image is decoded."""
    return numbered(m.index_images(sets(spark, sf))).select("map_ord", "unit_x", "unit_y", "west", "south", "width", "height")


@query("file_map_some", "maps runs", f"{FIRST} SELECT file * 16 + map_ord - m AS map_ord, y, x0, len, code FROM runs JOIN maps USING (map_ord) JOIN f ON file = map_ord // 16 WHERE west < 12400 AND west + width > 12300 AND south < 2200 AND south + height > 2100")
def file_map_some(spark, sf):
    """Runs of the maps that meet a rectangle; images of the others are passed over."""
    meets = "west < 12400 AND west + width > 12300 AND south < 2200 AND south + height > 2100"
    return numbered(m.decode_images(m.index_images(sets(spark, sf)).where(meets))).select("map_ord", "y", "x0", "len", "code")


@query("file_map_blocks", "maps runs", f"{FIRST} SELECT file * 16 + map_ord - m AS map_ord, code, sum(len)::BIGINT AS n FROM runs JOIN f ON file = map_ord // 16 GROUP BY ALL")
def file_map_blocks(spark, sf):
    """Pixels by code of maps written in blocks of 16, whose edges are filled up and cut again."""
    return numbered(m.decode_images(m.index_images(sets(spark, sf, side=16)))).groupBy("map_ord", "code").agg(F.sum("len").alias("n"))


@query("file_single_map", "maps runs", "SELECT map_ord, west, south, y, x0, len, code FROM runs JOIN maps USING (map_ord)")
def file_single_map(spark, sf):
    """Files of one map, whose header has its place."""
    return m.decode_singles(sets(spark, sf, single=True)).select(F.col("file").cast("bigint").alias("map_ord"), "west", "south", "y", "x0", "len", "code")


@query("file_book", "paths", "SELECT code, l1, l2, l3, l4 FROM paths")
def file_book(spark, sf):
    """Paths out of path dictionaries of 1000 paths."""
    p = d.paths(spark, sf).select(F.array(*x.LEVELS).alias("parts"), (F.col("code") - 1).alias("idx"))
    back = b.read_books(materialize(b.write_books(p, "parts", "idx", **BOOK_TAGS, per_file=PER_BOOK), "books"))
    return back.select((F.col("file").cast("bigint") * PER_BOOK + F.col("code")).alias("code"), *[F.get("parts", k).alias(c) for k, c in enumerate(x.LEVELS)])


@query("file_book_cp932", "paths", "SELECT code, l2, l4 FROM paths")
def file_book_cp932(spark, sf):
    """The same in another encoding, read back by it."""
    p = d.paths(spark, sf).select(F.array("l2", "l4").alias("parts"), (F.col("code") - 1).alias("idx"))
    back = b.read_books(materialize(b.write_books(p, "parts", "idx", **BOOK_TAGS, per_file=PER_BOOK, encoding="cp932"), "books"), "cp932")
    return back.select((F.col("file").cast("bigint") * PER_BOOK + F.col("code")).alias("code"), *[F.get("parts", k).alias(c) for k, c in enumerate(("l2", "l4"))])


@query("file_flat_book", "paths", "SELECT (code - 1) // 1000 AS file, row_number() OVER (PARTITION BY (code - 1) // 1000 ORDER BY length(l4), code) AS code, l4 AS text FROM paths")
def file_flat_book(spark, sf):
    """Texts out of flat dictionaries, whose codes go by the number of tokens."""
    p = d.paths(spark, sf).select(F.array("l4").alias("parts"), (F.col("code") - 1).alias("idx"))
    back = b.read_books(materialize(b.write_books(p, "parts", "idx", **BOOK_TAGS, per_file=PER_BOOK, flat=True), "books"))
    return back.select(F.col("file").cast("bigint").alias("file"), "code", F.get("parts", 0).alias("text"))


@query("file_book_relations", "paths", "WITH s AS (SELECT (code - 1) // 1000 AS file, code, unnest([l1, l2, l3, l4]) AS text FROM paths), t AS (SELECT file, count(DISTINCT text) AS texts, count(DISTINCT code) AS paths FROM s GROUP BY file), c AS (SELECT file, count(DISTINCT ch) AS tokens FROM (SELECT file, unnest(string_split(text, '')) AS ch FROM s WHERE text <> '') a GROUP BY file) SELECT file, tokens, length(bin(greatest(tokens - 1, 1)))::BIGINT AS token_bits, texts, length(bin(greatest(texts - 1, 1)))::BIGINT AS code_bits, paths, true AS fits FROM t JOIN c USING (file)")
def file_book_relations(spark, sf):
    """Counts and widths that the tables of each dictionary state, and whether ids reach all of what they point into."""
    p = d.paths(spark, sf).select(F.array(*x.LEVELS).alias("parts"), (F.col("code") - 1).alias("idx"))
    books = materialize(b.write_books(p, "parts", "idx", **BOOK_TAGS, per_file=PER_BOOK), "books")
    return b.relations(books).withColumn("file", F.col("file").cast("bigint"))

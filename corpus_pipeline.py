"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote.

Defined results: a null or wordless text goes in the first stage, as it has no language; rows that repeat an id and a text are
one from the second stage on; a row without an id stays if its text is no near-duplicate of one with an id; a text of which
nothing is left stays as an empty one; other columns than those of documents are dropped, also those named like a stage's
results; an empty table gives no rows. Ties are settled as in each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize, table
from loomgrid.llm.decontaminate import decontaminate
from loomgrid.llm.langid import UNDEFINED, language_id
from loomgrid.llm.neardup import near_duplicates
from loomgrid.llm.packing import best_fit_packing
from loomgrid.llm.queries import tokenizer_path
from loomgrid.llm.suffixdedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[2:]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of one clear language; those without a letter or between two languages go."""
    judged = language_id(docs, carry=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != UNDEFINED) & ~F.col("ambiguous")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates, once. Rows without a doc_id stay if any of them does."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return left.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def no_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that start earlier; n_chars follows the text."""
    cut = suffix_dedup(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:]).where(~F.col("contaminated")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens at most."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", no_repeated_strings),
    ("benchmark_decontamination", no_benchmark),
    ("best_fit_packing", packed),
]
#: Language models, tokenizers and suffix arrays are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

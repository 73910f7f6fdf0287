"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, folder) and returns a frame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of `documents`.

Nulls in any column are kept as values (a null text counts as empty), repeated rows are rows of their own until the
near-dedup stage, which keeps one row of each group; an empty table passes through; extra columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentigrid.llm.common import table
from sentigrid.llm.decontaminate import without_leaks
from sentigrid.llm.mixing import mix
from sentigrid.llm.quality import keep_good
from sentigrid.llm.simhash import MAX_BITS, SEGMENT, SHINGLE, keep_first
from sentigrid.llm.site_lines import drop_boilerplate
from sentigrid.session import stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that the word rules and the compression bands keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows, without the lines that over a tenth of their source's documents contain."""
    slim = drop_boilerplate(docs, F.col("text"), F.col("source"), into="text")
    return slim.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates: three-word shingles, 64 bits of which two may differ, every link found."""
    return keep_first(docs, words=SHINGLE, bits=64, max_bits=MAX_BITS, width=SEGMENT)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that hold no copy of a benchmark item."""
    return without_leaks(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words (repeats counted) the mix takes of each document."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

# Compression ratios, fingerprints, alignments and random draws are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)

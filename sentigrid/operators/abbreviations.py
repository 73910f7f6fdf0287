"""Abbreviations learned from a corpus, and tokens that keep their periods.

After Kiss and Strunk (2006): a word is an abbreviation if its periods are far more frequent than chance allows, it is
short, it has inner periods, and it is rarely seen without its period. All counts are corpus-wide
aggregates, so the table is learned without any labelled text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.functions import text as tx
from sentigrid.operators.word_tables import meet
from sentigrid.session import stage_table, unnest

# --- fixed values: the published score ----------------------------------------------------
PERIOD_RATE = 0.99
THRESHOLD = 0.3
# --- end of fixed values --------------------------------------------------------------------


def _raw_words(text: Column) -> Column:
    return F.split(F.lower(text), f"[{tx.SPACE}]+")


def _type(word: Column) -> Column:
    """The type of a word and, after it, its period if it has one."""
    return F.regexp_extract(word, tx.WORD_TYPE, 0)


def word_types(text: Column) -> Column:
    """The lower-cased words as array<string>, each a type and, after it, its period if it has one."""
    return F.filter(F.transform(_raw_words(text), _type), lambda w: w.rlike(r"\p{L}"))


def period_types(text: Column) -> Column:
    """The different types of a text that stand with a period; only words that hold one are looked into."""
    dotted = F.array_distinct(F.filter(_raw_words(text), lambda w: w.contains(".")))
    return F.array_distinct(F.filter(F.transform(dotted, _type), lambda w: w.endswith(".") & w.rlike(r"\p{L}")))


def type_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_with, n_without): how often each type stands with and without a final period.

    Words are counted as they stand, and the different ones are taken apart.
    """
    words = unnest(df.select(_raw_words(F.col(text_col)).alias("_w")), F.col("_w"), "raw")
    counted = words.groupBy("raw").agg(F.count("*").alias("n")).select(_type(F.col("raw")).alias("word"), "n")
    parts = counted.filter(F.col("word").rlike(r"\p{L}")).select(
        F.regexp_extract("word", tx.WORD_TYPE, 1).alias("term"), "n",
        F.when(F.regexp_extract("word", tx.WORD_TYPE, 2) == ".", F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("period"))
    return parts.groupBy("term").agg(F.sum("period").alias("n_with"), F.sum(F.col("n") - F.col("period")).alias("n_without"))


def abbreviation_score(n_with: Column, n_without: Column, term: Column, periods: Column, words: Column) -> Column:
    """Log-likelihood ratio of a fixed high period rate against the corpus's rate, times the three published factors."""
    rate, n = periods / words, n_with + n_without
    ratio = 2 * (n_with * (F.log(F.lit(PERIOD_RATE)) - F.log(rate)) + n_without * (F.log(F.lit(1 - PERIOD_RATE)) - F.log(1 - rate)))
    letters = F.length(F.replace(term, F.lit("."), F.lit("")))
    inner = F.length(term) - letters
    return F.when(n > 0, ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -n_without))


def abbreviations(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(term, n_with, n_without, score) of the abbreviations of a corpus, without their final period."""
    counts = stage_table(type_counts(df, text_col), "word-types")
    periods, words = counts.agg(F.coalesce(F.sum("n_with"), F.lit(0)),
                                F.coalesce(F.sum(F.col("n_with") + F.col("n_without")), F.lit(0))).first()
    score = abbreviation_score(F.col("n_with"), F.col("n_without"), F.col("term"),
                               F.lit(float(periods)), F.lit(float(words or 1)))
    known = counts.filter((F.col("n_with") > 0) & (F.lit(periods) < F.lit(words)))
    return known.withColumn("score", score).filter(F.col("score") >= threshold)


def tokenize_with(df: DataFrame, table: DataFrame, prepared: Column, id_col: str = "doc_id",
                  plain_spaces: bool = False) -> DataFrame:
    """(key, tokens): `tokenize` of the prepared text where the abbreviations of a (term) table keep their period.

    The last word of a text ends a sentence whatever it is. The table may have any size: a text's own words with a
    period meet it, and the text gets back the few it holds. The key has to be unique; a null text has null tokens.
    """
    texts = stage_table(df.select(id_col, prepared.alias("_text")), "prepared-texts")
    mine = period_types(F.col("_text"))
    held = unnest(texts.select(id_col, mine.alias("_m")), F.col("_m"), "_word", id_col)
    held = stage_table(held.select(id_col, F.regexp_extract("_word", tx.WORD_TYPE, 1).alias("term")), "held-words")
    found = meet(held, table.select("term").distinct(), "term", "left_semi")
    known = found.groupBy(id_col).agg(F.collect_set("term").alias("_known"))
    none = F.array().cast("array<string>")
    both = texts.join(known, id_col, "left").withColumn("_known", F.coalesce("_known", none))
    return both.select(id_col, tx.tokenize(F.col("_text"), plain_spaces, F.col("_known")).alias("tokens"))

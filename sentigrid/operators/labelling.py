"""Weak labels and everything that explains them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentigrid.config import MAX_CLASSES, Preprocess
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.functions.lexicon import (
    EXTENDED, Lexicon, contained_terms, hit_positions, label_of, side_terms, with_label,
)

# --- fixed values: display names --------------------------------------------------------
SENTIMENT_NAMES = {"negative": "Negative", "neutral": "Neutral", "positive": "Positive"}
DEFAULT_SENTIMENT = "Neutral"
# --- end of fixed values ----------------------------------------------------------------


def sentiment_name(label: Column) -> Column:
    """Display name of a label, 'Neutral' for any other value."""
    names = F.create_map(*[F.lit(x) for pair in SENTIMENT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, label), F.lit(DEFAULT_SENTIMENT))


def lexicon_matches(df: DataFrame, lexicon: Lexicon = EXTENDED, id_col: str = "doc_id",
                    text_col: str = "text", engine: str = "builtin") -> DataFrame:
    """One row per document and matched term; a document without match keeps one row of nulls."""
    entries = lexicon.as_array()
    return df.select(id_col, hit_positions(F.lower(F.col(text_col)), lexicon, engine).alias("hits")).select(
        id_col, F.inline_outer(F.transform("hits", lambda i: F.get(entries, i)))
    )


def explain_label(df: DataFrame, lexicon: Lexicon = EXTENDED, id_col: str = "doc_id",
                  text_col: str = "text", engine: str = "builtin") -> DataFrame:
    """Matched terms and scores of both sides, the label, and the first 100 characters.

    A term of weight n stands n times among the matches, so their number is the score.
    """
    lowered, preview = F.lower(F.col(text_col)), F.substring(text_col, 1, 100).alias("preview")
    sides = ("positive", "negative")
    if engine == "builtin":
        found = df.select(id_col, preview, lowered.alias("_lowered")).select(id_col, "preview", *[
            F.coalesce(contained_terms(F.col("_lowered"), lexicon, s), F.array().cast("array<string>")).alias(f"{s}_matches")
            for s in sides])
    else:
        hits = df.select(id_col, preview, hit_positions(lowered, lexicon, engine).alias("_hits"))
        found = hits.select(id_col, "preview", *[side_terms(F.col("_hits"), lexicon, s).alias(f"{s}_matches") for s in sides])
    scored = found.withColumns({f"{s}_score": F.size(f"{s}_matches") for s in sides})
    return scored.withColumn("label", label_of(F.col("positive_score"), F.col("negative_score")))


def with_derived(df: DataFrame, options: Preprocess = Preprocess.extended(),
                 lexicon: Lexicon = EXTENDED, words: Sequence[str] = stoplists.DEFAULT,
                 text_col: str = "text") -> DataFrame:
    """Adds label (from the raw text), clean (prepared text), word_count and sentiment."""
    labelled = with_label(df, lexicon, text_col)
    return (
        labelled.withColumn("clean", tx.full_pipeline(F.col(text_col), options, words))
        .withColumn("word_count", tx.word_count(F.col("clean")))
        .withColumn("sentiment", sentiment_name(F.col("label")))
    )


def class_list(df: DataFrame, label_col: str = "label") -> list[str]:
    """The labels in alphabetical order; more than MAX_CLASSES are refused."""
    rows = df.select(label_col).distinct().orderBy(label_col).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"at most {MAX_CLASSES} classes are supported")
    return [r[0] for r in rows]


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n): rows per label, however many labels there are; rows without a label are left out."""
    return df.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))


def class_sizes(df: DataFrame, label_col: str = "label") -> dict[str, int]:
    """Rows per label in alphabetical order; more than MAX_CLASSES labels are refused."""
    rows = df.groupBy(label_col).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"at most {MAX_CLASSES} classes are supported")
    return {r[0]: r.n for r in sorted(rows, key=lambda r: r[0] or "") if r[0] is not None}


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of classes and of rows in the smallest and largest class."""
    return (
        df.groupBy(label_col).count().agg(
            F.count("*").alias("n_classes"),
            F.min("count").alias("smallest"),
            F.max("count").alias("largest"),
        )
    )


def require_min_classes(df: DataFrame, minimum: int = 2, label_col: str = "label") -> None:
    """Refuses training data with fewer than `minimum` distinct labels."""
    found = class_balance(df, label_col).first().n_classes
    if found < minimum:
        raise ValueError(f"training needs at least {minimum} different labels, found {found}")

"""Scoring new text, and explaining the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.functions import scores as sc
from sentigrid.functions import text as tx
from sentigrid.operators.analysis import class_vocab_overlap
from sentigrid.operators.features import top_features
from sentigrid.operators.labelling import sentiment_name
from sentigrid.operators.naive_bayes import NaiveBayesModel


def score(model: NaiveBayesModel, texts: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, prediction, sentiment, confidence in percent, probabilities by class).

    Every row stays; for a blank or null text prediction, sentiment, confidence and probabilities are
    null. Row by row, so `texts` may be a stream.
    """
    scored = model.score_text(texts.withColumn("_scored", F.coalesce("text", F.lit(""))), "_scored")
    said = ~tx.is_blank(F.col("text"))
    return scored.select(
        *keep,
        F.when(said, F.col("prediction")).alias("prediction"),
        F.when(said, sentiment_name(F.col("prediction"))).alias("sentiment"),
        F.when(said, sc.percent(F.array_max("probabilities"))).alias("confidence"),
        F.when(said, sc.probability_map(F.col("probabilities"), model.classes)).alias("proba"),
    )


def explain(model: NaiveBayesModel, texts: DataFrame, training: DataFrame, k: int = 10,
            show: int = 5) -> DataFrame:
    """One row per text and class: lengths, probability, the class's rows and percentage in training,
    heaviest features with their weights, and the words known from the class.

    `texts` has doc_id and text, `training` label and clean. A blank or null text keeps one row, without
    class, prediction and features.
    """
    said = ~tx.is_blank(F.col("text"))
    prepared = model.prepare(texts.withColumn("_scored", F.coalesce("text", F.lit(""))), "_scored")
    scored = top_features(model.score_terms(prepared), model.vocabulary, k)
    names = F.transform("top", lambda t: t["term"])
    per_class = scored.select(
        "doc_id",
        F.length("text").alias("text_length"),
        F.length("clean").alias("clean_length"),
        tx.word_count(F.col("clean")).alias("words_in_text"),
        F.when(said, F.col("prediction")).alias("prediction"),
        F.when(said & (F.size("top") > 0), F.array_join(names, ", ")).alias("features"),
        F.when(said & (F.size("top") > 0), F.transform("top", lambda t: t["weight"])).alias("weights"),
        F.explode_outer(F.when(said, F.arrays_zip(
            sc.class_array(model.classes).alias("label"), F.col("probabilities").alias("p")))).alias("_class"),
    ).select("*", "_class.label", "_class.p").drop("_class")
    sizes = training.filter(F.col("label").isin(*model.classes)).groupBy("label").agg(F.count("*").alias("training_rows"))
    whole = sizes.agg(F.sum("training_rows")).scalar()
    sizes = sizes.withColumn("training_percent", 100.0 * F.col("training_rows") / whole)
    overlap = class_vocab_overlap(prepared, training, show)
    return (
        per_class.join(F.broadcast(sizes), "label", "left")
        .join(overlap, ["doc_id", "label"], "left")
    )

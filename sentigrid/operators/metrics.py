"""Quality of predictions. All measures come from the (label, prediction) counts, one small
table, so the scored rows are read once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """(label, prediction, n) for every pair of classes that occur on either side."""
    counts = pair_counts(scored)
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).agg(
        F.collect_set("c").alias("cs")
    )
    grid = classes.select("cs", F.explode("cs").alias("label")).select(
        "label", F.explode("cs").alias("prediction")
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_wide(scored: DataFrame, classes: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return scored.groupBy("label").pivot("prediction", classes).count().na.fill(0)


def accuracy(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_scores(scored: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class in truth or prediction."""
    counts = pair_counts(scored)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    rated = sums.select(
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"),
        F.col("actual").alias("support"),
        "tp",
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def _weighted(measure: str) -> Column:
    return F.sum(F.col(measure) * F.col("support")) / F.sum("support")


def weighted_scores(scored: DataFrame) -> DataFrame:
    """accuracy and support-weighted precision, recall and F1 in one row."""
    return class_scores(scored).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[_weighted(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def classification_report(scored: DataFrame, digits: int = 4) -> DataFrame:
    """(row, precision, recall, f1, support): the classes, then accuracy, macro and weighted avg.

    The accuracy row shows the accuracy in every column.
    """
    measures = ["precision", "recall", "f1"]
    per_class = class_scores(scored)
    rows = per_class.select(F.col("label").alias("row"), *measures, F.col("support").cast("double").alias("support"))
    share = F.sum("tp") / F.sum("support")
    support = F.sum("support").cast("double").alias("support")
    summary = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("row"), *[share.alias(m) for m in measures], share.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in measures], support),
        F.struct(F.lit("weighted avg").alias("row"), *[_weighted(m).alias(m) for m in measures], support),
    ).alias("rows")).select(F.inline("rows"))
    table = rows.unionByName(summary)
    return table.select("row", *[F.round(m, digits).alias(m) for m in [*measures, "support"]])


def metric_rows(scored: DataFrame, model: str) -> DataFrame:
    """(model, metric, value) with accuracy, precision, recall and f1."""
    names = ["accuracy", "precision", "recall", "f1"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return weighted_scores(scored).select(F.lit(model).alias("model"), F.inline(pairs))


def metric_union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def model_comparison(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Metrics side by side, one column per model; empty unless every model has its metrics."""
    wide = metrics.groupBy("metric").pivot("model", models).agg(F.first("value"))
    return wide.na.drop(subset=models)


def mean_loss(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean cross-entropy of the true class, from a column p_true."""
    return scored.groupBy(*keys).agg(F.avg(-F.log(F.col("p_true"))).alias("loss"))


def history_summary(history: DataFrame) -> DataFrame:
    """Last values and best validation accuracy of (step, train_loss, val_loss, val_accuracy)."""
    return history.agg(
        F.max_by("train_loss", "step").alias("final_train_loss"),
        F.max_by("val_loss", "step").alias("final_val_loss"),
        F.max_by("val_accuracy", "step").alias("final_val_accuracy"),
        F.max("val_accuracy").alias("best_val_accuracy"),
    )


def label_shares(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, percent), most frequent first; the window runs over the counted labels only."""
    counts = df.groupBy(label_col).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 1)).orderBy(F.desc("n"), label_col)

"""From labelled text to a tuned and fitted model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.config import HeadTraining, Preprocess, Training
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.functions.lexicon import EXTENDED, Lexicon, with_label
from sentigrid.operators.features import Vocabulary
from sentigrid.operators.labelling import class_list, class_sizes, require_min_classes
from sentigrid.operators.minibatch_head import LinearHead
from sentigrid.operators.naive_bayes import (
    NaiveBayesModel, TermSums, alpha_sweep, best_alpha, sweep_history,
)
from sentigrid.operators.softmax_head import HISTORY_SCHEMA, SoftmaxHead, fit_softmax_head
from sentigrid.operators.split import stratified_split, three_way_split
from sentigrid.session import stage_table


def label_and_prepare(docs: DataFrame, lexicon: Lexicon = EXTENDED,
                      options: Preprocess = Preprocess.extended(),
                      words: Sequence[str] = stoplists.DEFAULT) -> DataFrame:
    """(doc_id, label, clean, terms), row by row. Labels come from the raw text. Training alone takes `label_and_terms`."""
    labelled = with_label(docs, lexicon)
    prepared = labelled.select("doc_id", "label", tx.full_pipeline(F.col("text"), options, words).alias("clean"))
    return prepared.withColumn("terms", tx.feature_terms(F.col("clean")))


def label_and_terms(docs: DataFrame, lexicon: Lexicon = EXTENDED, options: Preprocess = Preprocess.extended(),
                    words: Sequence[str] = stoplists.DEFAULT) -> DataFrame:
    """(doc_id, label, terms) with the terms of `label_and_prepare` as one text with spaces between them."""
    return with_label(docs, lexicon).select("doc_id", "label", tx.term_text(F.col("text"), options, words).alias("terms"))


@dataclass
class TrainedNaiveBayes:
    model: NaiveBayesModel
    vocabulary: Vocabulary
    sums: TermSums
    features: DataFrame
    history: DataFrame | None
    trained_on: Training

    def part(self, split: str) -> DataFrame:
        return self.features.filter(F.col("split") == split)

    def scored(self, split: str = "test") -> DataFrame:
        """The rows of one part with label, prediction, scores and probabilities."""
        return self.model.score_features(self.part(split))


def split_features(prepared: DataFrame, config: Training = Training(),
                   sizes: dict[str, int] | None = None) -> tuple[DataFrame, Vocabulary]:
    """Split, vocabulary and weights of a (doc_id, label, terms) table, terms as array or text, written once. Known class sizes save a pass."""
    if config.choose_on == "val":
        parts = three_way_split(prepared, config.test_ratio, config.validation_share, config.seed, sizes)
    else:
        parts = stratified_split(prepared, config.test_ratio, config.seed, sizes)
    fit_rows = parts if config.fit_on == "train" else prepared
    if config.fit_on == "train":
        fit_rows = fit_rows.filter(F.col("split") == "train")
    vocabulary = Vocabulary.fit(fit_rows, config.max_features)
    weighted = vocabulary.transform(parts).select("doc_id", "label", "split", "tf", "features")
    return stage_table(weighted, "features"), vocabulary


def train_naive_bayes(prepared: DataFrame, config: Training = Training(), alpha: float | None = None,
                      options: Preprocess = Preprocess.extended(),
                      words: Sequence[str] = stoplists.DEFAULT) -> TrainedNaiveBayes:
    """Fit on a staged (doc_id, label, terms) table.

    Without `alpha` the grid is swept, and the best alpha on the chosen part is used for the
    final fit. With the defaults the vocabulary sees every row and alpha is chosen on the test
    part; `fit_on` and `choose_on` in the config keep the parts apart.
    """
    sizes = class_sizes(prepared)
    classes = list(sizes)
    if len(classes) < 2:
        raise ValueError(f"training needs at least 2 different labels, found {len(classes)}")
    features, vocabulary = split_features(prepared, config, sizes)
    train = features.filter(F.col("split") == "train")
    sums = TermSums.collect(train, classes, len(vocabulary.terms))
    history = None
    if alpha is None:
        swept = alpha_sweep(features, sums, config.alphas())
        history = stage_table(sweep_history(swept, config.choose_on), "history")
        alpha = best_alpha(history).first().alpha
    model = NaiveBayesModel.fit(train, classes, vocabulary, alpha, options, list(words),
                                sums.log_prior().tolist())
    return TrainedNaiveBayes(model, vocabulary, sums, features, history, config)


def train_softmax_head(vectors: DataFrame, config: HeadTraining = HeadTraining(),
                       iterations_per_epoch: int = 20) -> tuple[SoftmaxHead | LinearHead, DataFrame, DataFrame]:
    """Fit on (doc_id, label, embedding). Gives the head, its history and the split rows."""
    require_min_classes(vectors)
    keyed = vectors.withColumn("label", F.col("label").cast("string"))
    split = three_way_split(keyed, config.test_ratio, config.validation_share, config.seed)
    rows = stage_table(split, "vectors")
    head, history = fit_softmax_head(rows, class_list(rows), config, iterations_per_epoch)
    return head, vectors.sparkSession.createDataFrame(history, HISTORY_SCHEMA), rows

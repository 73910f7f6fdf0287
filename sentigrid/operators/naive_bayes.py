"""Multinomial naive Bayes on TF-IDF weights: fit, alpha sweep, predict, save and load."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.classification import NaiveBayesModel as MLNaiveBayesModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentigrid.config import MAX_VOCABULARY, Preprocess
from sentigrid.functions import scores as sc
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.operators.features import Vocabulary, class_term_sums

# documents scored against the whole alpha grid at a time, inside one Arrow batch
_CHUNK = 256
# weights of a task: 64 MB; a sweep over more goes by blocks of classes
SWEEP_CELLS = 1 << 23


def encode_label(label: Column, classes: list[str]) -> Column:
    """Position of the label in the class list, from 0."""
    return (F.array_position(sc.class_array(classes), label) - 1).cast("int")


def decode_label(index: Column, classes: list[str]) -> Column:
    return F.get(sc.class_array(classes), index.cast("int"))


def class_log_priors(df: DataFrame) -> DataFrame:
    """ln(n_c / N), unsmoothed."""
    sizes = df.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.select("label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("log_prior"))


def theta_table(sums: DataFrame, vocabulary: DataFrame, classes: list[str], alpha: float) -> DataFrame:
    """(label, term, theta) for every class and vocabulary term:
    theta = ln((S_ct + alpha) / (S_c + alpha * V)).

    The grid is the vocabulary times the class list, independent of the number of documents.
    """
    grid = vocabulary.select("term", "position", F.explode(sc.class_array(classes)).alias("label"))
    per_class = Window.partitionBy("label")
    return (
        grid.join(sums, ["label", "position"], "left")
        .withColumn("s", F.coalesce("weight_sum", F.lit(0.0)))
        .withColumn("theta", F.log(
            (F.col("s") + alpha) / (F.sum("s").over(per_class) + alpha * F.count("*").over(per_class))))
        .select("label", "term", "position", "theta")
    )


@dataclass
class TermSums:
    """Training statistics on the driver: classes x vocabulary, so bounded in size."""

    classes: list[str]
    sizes: np.ndarray
    sums: np.ndarray

    @classmethod
    def collect(cls, train: DataFrame, classes: list[str], n_terms: int) -> "TermSums":
        if n_terms > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} terms")
        position = {c: i for i, c in enumerate(classes)}
        sizes = np.zeros(len(classes))
        for row in train.groupBy("label").count().collect():
            sizes[position[row["label"]]] = row["count"]
        sums = np.zeros((len(classes), n_terms))
        table = class_term_sums(train).toPandas()
        sums[table["label"].map(position), table["position"]] = table["weight_sum"]
        return cls(classes, sizes, sums)

    def log_prior(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.sizes / self.sizes.sum())

    def theta(self, alpha: float) -> np.ndarray:
        return np.log((self.sums + alpha) / (self.sums.sum(axis=1, keepdims=True) + alpha * self.sums.shape[1]))


def _dense_chunks(batch: pa.RecordBatch, n_terms: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, matrix) of the sparse vectors of a batch, _CHUNK rows at a time."""
    lengths = batch.column("indices").value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
    value = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    for start in range(0, batch.num_rows, _CHUNK):
        stop = min(start + _CHUNK, batch.num_rows)
        dense = np.zeros((stop - start, n_terms))
        inside = slice(ends[start], ends[stop])
        dense[np.repeat(np.arange(stop - start), lengths[start:stop]), index[inside]] = value[inside]
        yield start, stop, dense


def _counted(split: np.ndarray, alphas: list[float], right: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in np.unique(split):
        mine = split == part
        yield pa.RecordBatch.from_pydict({
            "split": [str(part)] * len(alphas),
            "alpha": pa.array(alphas, pa.float64()),
            "n": pa.array([int(mine.sum())] * len(alphas), pa.int64()),
            "correct": pa.array(right[mine].sum(axis=0).astype("int64")),
        })


def _sweep_at_once(rows: DataFrame, sums: TermSums, alphas: list[float]) -> DataFrame:
    """(split, alpha, n, correct) where the weights of all classes and alphas fit a task."""
    n_terms, n_classes = sums.sums.shape[1], len(sums.classes)
    weights = np.concatenate([sums.theta(a) for a in alphas]).T.copy()
    prior = np.tile(sums.log_prior(), len(alphas))
    digits = sc.TIE_DIGITS

    def count_correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = batch.column("label_idx").to_numpy(zero_copy_only=False)
            split = np.asarray(batch.column("split").to_pylist())
            right = np.zeros((batch.num_rows, len(alphas)), dtype=bool)
            for start, stop, dense in _dense_chunks(batch, n_terms):
                scores = np.round(dense @ weights + prior, digits)
                best = scores.reshape(stop - start, len(alphas), n_classes).argmax(axis=2)
                right[start:stop] = best == truth[start:stop, None]
            yield from _counted(split, alphas, right)

    return rows.mapInArrow(count_correct, "split string, alpha double, n bigint, correct bigint")


def _sweep_by_blocks(rows: DataFrame, sums: TermSums, alphas: list[float], width: int) -> DataFrame:
    """The same with `width` classes at a time.

    A block leaves per row and alpha its best score and class; the best of the blocks is a maximum per row, with the first
    class on ties, as in one go. No task holds more than the weights of a block.
    """
    n_terms, digits, log_prior = sums.sums.shape[1], sc.TIE_DIGITS, sums.log_prior()

    def best_of(first: int) -> DataFrame:
        mine = slice(first, min(first + width, len(sums.classes)))
        block = TermSums(sums.classes[mine], sums.sizes[mine], sums.sums[mine])
        weights = np.concatenate([block.theta(a) for a in alphas]).T.copy()
        prior = np.tile(log_prior[mine], len(alphas))
        n_classes = len(block.classes)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                top, place = np.zeros((2, batch.num_rows, len(alphas)))
                for start, stop, dense in _dense_chunks(batch, n_terms):
                    scores = np.round(dense @ weights + prior, digits).reshape(stop - start, len(alphas), n_classes)
                    place[start:stop] = scores.argmax(axis=2)
                    top[start:stop] = scores.max(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(list(top), pa.list_(pa.float64())),
                     pa.array(list((place + first).astype(np.int32)), pa.list_(pa.int32()))], names=["doc_id", "top", "place"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select("doc_id", "indices", "values").mapInArrow(find, f"doc_id {kind}, top array<double>, place array<int>")

    found = best_of(0)
    for first in range(width, len(sums.classes), width):
        found = found.unionByName(best_of(first))
    cells = found.select("doc_id", F.posexplode(F.arrays_zip("top", "place")).alias("a", "cell"))
    winner = F.max(F.struct(F.col("cell.top"), (-F.col("cell.place")).alias("place")))
    best = cells.groupBy("doc_id", "a").agg((-winner["place"]).alias("best"))
    named = best.join(rows.select("doc_id", "split", "label_idx"), "doc_id")
    alpha = F.get(F.array(*[F.lit(x) for x in alphas]), F.col("a"))
    return named.select("split", alpha.alias("alpha"), F.lit(1).cast("bigint").alias("n"),
                        (F.col("best") == F.col("label_idx")).cast("bigint").alias("correct"))


def alpha_sweep(features: DataFrame, sums: TermSums, alphas: list[float]) -> DataFrame:
    """(split, alpha, n, correct, accuracy) for every alpha, from one pass over the features.

    `features` has doc_id, label, split and a sparse vector `features`. Each Arrow batch is scored
    against all alphas at once and leaves one row per split and alpha, so the shuffle is tiny. Where the weights
    (alphas x classes x terms) exceed SWEEP_CELLS numbers, the classes are taken in blocks.
    """
    vector = F.unwrap_udt("features")
    rows = features.select(
        "doc_id", encode_label(F.col("label"), sums.classes).alias("label_idx"), "split",
        vector["indices"].alias("indices"), vector["values"].alias("values"))
    width = max(1, SWEEP_CELLS // max(1, len(alphas) * sums.sums.shape[1]))
    if width >= len(sums.classes):
        swept = _sweep_at_once(rows, sums, alphas)
    else:
        swept = _sweep_by_blocks(rows, sums, alphas, width)
    return (
        swept.groupBy("split", "alpha")
        .agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("n"))
    )


def sweep_history(swept: DataFrame, val_split: str = "test") -> DataFrame:
    """(alpha, train_score, val_score), one row per alpha."""
    def score(part: str) -> Column:
        return F.max(F.when(F.col("split") == part, F.col("accuracy")))

    return swept.groupBy("alpha").agg(score("train").alias("train_score"), score(val_split).alias("val_score"))


def best_alpha(history: DataFrame) -> DataFrame:
    """The alpha with the best validation accuracy, the smallest on a tie."""
    return history.orderBy(F.desc("val_score"), "alpha").limit(1)


@dataclass
class NaiveBayesModel:
    """A fitted model with everything needed to score raw text.

    The class scores come from the ML model (row by row in the JVM). Its class prior is
    smoothed while ours is not, so the difference is added to each score.
    """

    classes: list[str]
    log_prior: list[float]
    alpha: float
    vocabulary: Vocabulary
    ml_model: MLNaiveBayesModel
    options: Preprocess = field(default_factory=Preprocess.extended)
    words: list[str] = field(default_factory=lambda: list(stoplists.DEFAULT))

    @classmethod
    def fit(cls, train: DataFrame, classes: list[str], vocabulary: Vocabulary, alpha: float,
            options: Preprocess | None = None, words: list[str] | None = None,
            log_prior: list[float] | None = None) -> "NaiveBayesModel":
        """`train` has label and the vector `features`; known priors save a pass."""
        coded = train.select(encode_label(F.col("label"), classes).cast("double").alias("label"), "features")
        model = NaiveBayes(smoothing=alpha, modelType="multinomial").fit(coded)
        if log_prior is None:
            known = {r.label: r.log_prior for r in class_log_priors(train).collect()}
            log_prior = [known[c] for c in classes]
        return cls(classes, log_prior, alpha, vocabulary, model,
                   options or Preprocess.extended(), list(words or stoplists.DEFAULT))

    def prepare(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds clean and terms with the switches the model was trained with."""
        clean = tx.full_pipeline(F.col(text_col), self.options, self.words)
        return df.withColumn("clean", clean).withColumn("terms", tx.feature_terms(F.col("clean")))

    def score_features(self, df: DataFrame) -> DataFrame:
        """Adds scores, probabilities (both in class order) and prediction to `features` rows."""
        shift = [own - ml for own, ml in zip(self.log_prior, self.ml_model.pi.toArray().tolist())]
        model = self.ml_model.copy()
        model.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
        raw = model.transform(df)
        return (
            raw.withColumn("scores", F.zip_with(
                vector_to_array("_raw"), F.array(*[F.lit(s) for s in shift]), lambda a, b: a + b))
            .withColumn("probabilities", sc.softmax(F.col("scores")))
            .withColumn("prediction", sc.argmax_class(F.col("scores"), self.classes))
            .drop("_raw")
        )

    def score_terms(self, df: DataFrame) -> DataFrame:
        return self.score_features(self.vocabulary.transform(df))

    def score_text(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Batch or streaming: text in, prediction and probabilities out, no shuffle."""
        return self.score_terms(df.withColumn("terms", tx.term_text(F.col(text_col), self.options, self.words)))

    def probability(self, label: str) -> Column:
        return F.get(F.col("probabilities"), self.classes.index(label))

    def save(self, spark: SparkSession, path: str) -> None:
        self.ml_model.write().save(f"{path}/model")
        self.vocabulary.table(spark.range(0)).write.parquet(f"{path}/vocabulary")
        config = {"classes": self.classes, "log_prior": self.log_prior, "alpha": self.alpha,
                  "words": self.words, **asdict(self.options)}
        spark.createDataFrame(
            [config],
            "classes array<string>, log_prior array<double>, alpha double, words array<string>,"
            " clean boolean, stopwords boolean, stem boolean",
        ).write.parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NaiveBayesModel":
        config = spark.read.parquet(f"{path}/config").first()
        return cls(
            list(config.classes), list(config.log_prior), config.alpha,
            Vocabulary.from_table(spark.read.parquet(f"{path}/vocabulary")),
            MLNaiveBayesModel.load(f"{path}/model"),
            Preprocess(config.clean, config.stopwords, config.stem), list(config.words),
        )

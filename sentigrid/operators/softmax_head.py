"""Softmax classifier on dense document vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentigrid.config import HeadTraining
from sentigrid.functions import scores as sc
from sentigrid.operators.minibatch_head import LinearHead, fit_minibatch_head
from sentigrid.operators.naive_bayes import encode_label


def _vectors(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.withColumns({
        "features": array_to_vector("embedding"),
        "label_idx": encode_label(F.col("label").cast("string"), classes).cast("double"),
    })


@dataclass
class SoftmaxHead:
    """One linear layer with softmax on top of given vectors."""

    classes: list[str]
    model: MultilayerPerceptronClassificationModel

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds probabilities (in class order) and prediction to rows with an `embedding`."""
        ready = df.withColumn("_features", array_to_vector("embedding"))
        model = self.model.copy()
        model.setFeaturesCol("_features").setProbabilityCol("_p").setPredictionCol("_i").setRawPredictionCol("")
        return (
            model.transform(ready)
            .withColumn("probabilities", vector_to_array("_p"))
            .withColumn("prediction", sc.argmax_class(F.col("probabilities"), self.classes))
            .drop("_features", "_p", "_i")
        )

    def probability(self, label: str) -> Column:
        return F.get(F.col("probabilities"), self.classes.index(label))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().save(f"{path}/model")
        spark.createDataFrame([(self.classes,)], "classes array<string>").write.parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SoftmaxHead":
        classes = list(spark.read.parquet(f"{path}/config").first().classes)
        return cls(classes, MultilayerPerceptronClassificationModel.load(f"{path}/model"))


def _losses(head: SoftmaxHead | LinearHead, rows: DataFrame) -> DataFrame:
    """Mean loss and accuracy per split."""
    label = F.col("label").cast("string")
    p_true = F.get(F.col("probabilities"), encode_label(label, head.classes))
    return head.predict(rows).groupBy("split").agg(
        F.avg(-F.log(F.greatest(p_true, F.lit(1e-300)))).alias("loss"),
        F.avg((F.col("prediction") == label).cast("double")).alias("accuracy"),
    )


def fit_softmax_head(df: DataFrame, classes: list[str], config: HeadTraining = HeadTraining(),
                     iterations_per_epoch: int = 20) -> tuple[SoftmaxHead | LinearHead, list[tuple]]:
    """Train on rows with doc_id, embedding, label and split ('train' and 'val').

    Each epoch goes on from the weights of the one before. Gives the head and the history rows
    (step, train_loss, val_loss, val_accuracy). With the solver 'adamw' an epoch is one pass in mini-batches.
    """
    if config.solver == "adamw":
        return fit_minibatch_head(df, classes, config, _losses)
    data = _vectors(df, classes)
    train = data.filter(F.col("split") == "train").select("features", F.col("label_idx").alias("target"))
    dim = train.select(F.size(vector_to_array("features"))).first()[0]
    weights, head, history = None, None, []
    for epoch in range(1, config.epochs + 1):
        learner = MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="target", layers=[dim, len(classes)],
            maxIter=iterations_per_epoch, seed=config.seed, solver=config.solver,
            stepSize=config.learning_rate, blockSize=128,
        )
        if weights is not None:
            learner.setInitialWeights(weights)
        model = learner.fit(train)
        weights = model.weights
        head = SoftmaxHead(classes, model)
        rows = {r.split: r for r in _losses(head, df.filter(F.col("split").isin("train", "val"))).collect()}
        val = rows.get("val")
        history.append((float(epoch), rows["train"].loss, val.loss if val else None, val.accuracy if val else None))
    return head, history


HISTORY_SCHEMA = "step double, train_loss double, val_loss double, val_accuracy double"

"""Live scoring: a stateless stream of texts in, predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sentigrid.operators.naive_bayes import NaiveBayesModel
from sentigrid.plans.scoring import score


def table_files(folder: str, name: str) -> str:
    """A pattern for the files of a table, be it one file or a folder of files: a stream takes a single file by pattern only."""
    return f"{folder}/{{{name}}}"


def read_text_stream(spark: SparkSession, folder: str, schema: T.StructType, name_filter: str = "*.parquet",
                     max_files: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream. The folder may be a pattern, as of `table_files`."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def score_stream(model: NaiveBayesModel, texts: DataFrame, out: str, checkpoint: str, *keep: str,
                 once: bool = False) -> StreamingQuery:
    """Score a stream into parquet files.

    Scoring needs no shuffle and keeps no state, so every micro-batch is a plain map over its
    rows, and the file sink's log makes each row appear exactly once after a restart.
    """
    writer = (
        score(model, texts, *keep)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()

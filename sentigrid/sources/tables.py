"""Parquet sources and sinks, and the step from a raw table to a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# the text a null becomes when every text column is turned into strings
NULL_TEXT = "nan"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stringify_columns(df: DataFrame) -> DataFrame:
    """Text columns with nulls turned into the text 'nan'; other columns untouched."""
    text_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(NULL_TEXT)) for c in text_columns})


def select_text(df: DataFrame, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """The chosen column as `text`, next to the document key."""
    return df.select(id_col, F.col(text_col).cast("string").alias("text"))


def apply_null_policy(df: DataFrame, policy: str = "drop", text_col: str = "text") -> DataFrame:
    """'drop' removes rows without text, 'nan' keeps them with the text 'nan'."""
    if policy == "drop":
        return df.filter(F.col(text_col).isNotNull())
    if policy == "nan":
        return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(NULL_TEXT)))
    raise ValueError("the null policy is 'drop' or 'nan'")


def idle_cores(df: DataFrame) -> int | None:
    """The session's cores if the table has fewer splits than twice that, else None: see `corpus`."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if df.rdd.getNumPartitions() < 2 * cores else None


def corpus(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           null_policy: str = "drop", partitions: int | None = None) -> DataFrame:
    """A (doc_id, text) corpus ready for text work.

    It is partitioned as it was read. A file of few row groups keeps few cores busy: `partitions` deals its
    texts out by their key, at the cost of moving them once. Large tables need none of that.
    """
    picked = select_text(df, text_col, id_col).withColumnRenamed(id_col, "doc_id")
    kept = apply_null_policy(picked, null_policy)
    return kept.repartition(partitions, "doc_id") if partitions else kept


def write_table(df: DataFrame, path: str, bucket_by: str | None = None, buckets: int = 0,
                table: str | None = None, mode: str = "errorifexists") -> None:
    """Write parquet; with `bucket_by` as a bucketed table, so later per-key work needs no shuffle."""
    if bucket_by is None:
        df.write.mode(mode).parquet(path)
        return
    if not table or buckets < 1:
        raise ValueError("a bucketed table needs a name and a number of buckets")
    writer = df.write.mode(mode).format("parquet").option("path", path)
    writer.bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A bucketed table by its name; the name carries the buckets, a path alone does not."""
    return spark.read.table(table)


def write_pair(left: DataFrame, right: DataFrame, key: str, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Writes two frames into the same buckets of `key` and reads them again: their joins and groups by `key` move no rows.

    Each frame is dealt out by the key first, so that a bucket is one file. The tables' names end the path.
    """
    spark, out = left.sparkSession, []
    for side, frame in (("left", left), ("right", right)):
        name = f"{path.rstrip('/').rsplit('/', 1)[-1]}_{side}".replace("-", "_")
        write_table(frame.repartition(buckets, key), f"{path}/{side}", key, buckets, name)
        out.append(read_bucketed(spark, name))
    return out[0], out[1]

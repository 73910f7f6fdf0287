"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
# Rows of an Arrow batch that are handled at once: bounds the Python side when texts are long.
SLICE = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column, a null being the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(df: DataFrame, body: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """`body(*columns)` over slices of Arrow batches: gets lists of values, yields output rows."""
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = list(body(*(c.to_pylist() for c in part.columns)))
                if rows:
                    yield record_batch(rows, arrow)

    return df.mapInArrow(run, target)


def _arrow_schema(target) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(target)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + length) one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls in one array, and the length of each list."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

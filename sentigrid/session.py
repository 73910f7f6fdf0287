"""Session set-up and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def build_session(app: str = "sentigrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; extra settings as keyword arguments."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # texts can be long: smaller Arrow batches keep the Python workers small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables between stages: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own. On a cluster a
    machine-local folder would not be seen by the other machines, so that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get(_CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sentigrid-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, within the folder of the open `staging` block if there is one."""
    return os.path.join(_RUN.get() or os.path.join(scratch_root(spark), "sentigrid"), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Owner of the tables staged in the block: they lie in one folder, which is deleted when the block ends.

    Results are lazy and read staged tables, so write them within the block. Blocks may be nested, each has its own folder;
    other threads stage outside of it.
    """
    folder = os.path.join(scratch_root(spark), "sentigrid", f"run-{uuid.uuid4().hex}")
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Later passes read only the columns they need, and a lost executor costs a re-read
    rather than a re-run of the text work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unnest(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of the array `items`, as column `name` next to the kept columns.

    The outer form with a null check afterwards: for a plain explode the optimizer tests
    size(items) > 0 below it, which would compute an expensive array a second time.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def unnest_structs(df: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per struct of the array `items`, its fields as columns."""
    rows = unnest(df, items, "_item", *keep)
    return rows.select(*keep, "_item.*")

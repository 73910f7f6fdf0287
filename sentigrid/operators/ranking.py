"""Places in a global order, worked out in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentigrid.session import stage_table


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds each row's place (from 1) in the order given, which must be total.

    Rows are dealt out by ranges of the order; a row's place is the one in its range plus the rows of the ranges before
    it. Only one count per range is ever in one task.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage_table(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_range"))
    before = sizes.select("_range", (upto - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")

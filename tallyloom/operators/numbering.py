"""Dense numbers for rows in order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.storage import scratch_path


def in_order(rows: DataFrame, scratch: str | None = None, column: str = "position") -> DataFrame:
    """rows with a column that counts them from 0 in the order that they have: by partition, then by place in it.

    The rows are written to scratch with the task and the place that each had; both the tasks' sizes and the rows
    are read from those files, so that they agree however often either is computed. A task's first number is the
    sum of the sizes before it, of which there is one a task. scratch: a path that doesn't exist yet.
    """
    spark = rows.sparkSession
    path = scratch or scratch_path(spark)
    rows.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return placed.join(before, "task").withColumn(column, F.col("place") + F.col("before")).drop("task", "place", "before")

"""Dense ids for new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import written


def numbered(rows: DataFrame, order: list[str], after: Column, name: str = "id") -> DataFrame:
    """Rows with ids ``after + 1``, ``after + 2`` ... in the given (unique) order, without gaps.

    The rows are dealt to ranges of the order once and written; a row's id is its
    place within its range plus the rows of the ranges before.  The counts are one
    row per range, so no task sees all rows.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_place", place).join(F.broadcast(before), "_range")
        .withColumn(name, after + F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")
    )

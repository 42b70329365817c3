"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import cut


def with_index(df: DataFrame, order: list[str], name: str = "ord", parts: int | None = None) -> DataFrame:
    """Adds 0-based numbers in the order of the columns ``order``: range partitions are sorted,
    numbered inside, and shifted by the sizes of the partitions before them."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    size = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.withColumn("_in", inside).join(before, "_part").select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))

"""Ranks and top-n selections that never gather one group, however hot, in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def distributed_rank(df: DataFrame, keys: list[str], order: Column, tie: list[str], name: str = "rank_no", buckets: int = 64) -> DataFrame:
    """1-based row number within ``keys`` by ``(order, tie)``.

    ``order`` must be a bigint expression spread over the whole 64-bit range (a hash). Its top
    bits name a bucket; rows are numbered inside (keys, bucket), and the counts of the lower
    buckets, one small row each, are added. A group of any size is thus spread over ``buckets``
    tasks.
    """
    shift = 64 - (buckets - 1).bit_length()
    flipped = order.bitwiseXOR(F.lit(-(2**63)))
    d = df.withColumn("_o", order).withColumn("_b", F.shiftrightunsigned(flipped, shift))
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(
        *keys,
        "_b",
        (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before"),
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_o", *tie)
    d = d.withColumn("_rn", F.row_number().over(w)).alias("d")
    cond = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_b"]])
    out = d.join(before.alias("c"), cond)
    return out.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d._rn") + F.col("c._before")).alias(name))

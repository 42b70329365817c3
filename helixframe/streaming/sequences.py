"""Sequence operators on streams.

All functions of ``functions.sequence`` and the windowing operators are stateless expressions and
apply to a streaming DataFrame as they are. Counts by sample, anchor and target are kept with a
watermark, so that late rows are added until it passes and state is dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import clean


def windowed_counts(satc: DataFrame, time: str = "counted_at", width: str = "30 days", late: str = "60 days") -> DataFrame:
    """``(start, sample, anchor, total)``: counts of each window of ``time``; rows later than
    ``late`` behind the newest are left out by a stream. Works on batches alike."""
    d = satc.withColumn("anchor", clean("anchor")).where("sample is not null and anchor <> '' and count is not null")
    d = d.withWatermark(time, late) if satc.isStreaming else d
    g = d.groupBy(F.window(time, width).alias("w"), "sample", "anchor").agg(F.sum("count").alias("total"))
    return g.select(F.col("w.start").alias("start"), "sample", "anchor", "total")

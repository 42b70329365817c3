"""Reference-shaped relations on the test tables; queries and their SQL share these definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import clean
from helixframe.operators.indexing import with_index
from helixframe.runtime import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    """``(ord, record_id, seq)``: the cleaned anchors as sequence records."""
    a = table(spark, d, "anchor_clusters").select("ord", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("record_id"), clean("anchor").alias("seq"))
    return a.where("seq <> ''")


def satc(spark: SparkSession, d: str) -> DataFrame:
    """``(sample, anchor, target, count)``: cleaned, the last delivery of each counted row."""
    s = table(spark, d, "satc").select("sample", clean("anchor").alias("anchor"), clean("target").alias("target"), "count", "counted_at", "loaded_at")
    s = s.where("sample is not null and anchor <> '' and target <> '' and count is not null")
    last = s.groupBy("sample", "anchor", "target", "counted_at").agg(F.max(F.struct("loaded_at", "count")).alias("m"))
    return last.groupBy("sample", "anchor", "target").agg(F.sum("m.count").alias("count"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """``(ord, cluster_id, anchor)`` with cleaned anchors."""
    a = table(spark, d, "anchor_clusters").select("ord", "cluster_id", clean("anchor").alias("anchor"))
    return a.where("cluster_id is not null and anchor <> ''")


def anchor_list(spark: SparkSession, d: str) -> DataFrame:
    """``(ord, anchor)``: all anchors, those of most samples first, ties by text."""
    per = satc(spark, d).groupBy("anchor").agg((-F.count_distinct("sample")).alias("minus"))
    return with_index(per, ["minus", "anchor"], "ord").select(F.col("ord").cast("long").alias("ord"), "anchor")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """``(anchor, stats)``: the name of a part as the label of each anchor."""
    s = table(spark, d, "anchor_stats").select("anchor").where("anchor is not null").distinct()
    key = F.conv(F.substring(F.md5("anchor"), 1, 6), 16, 10).cast("long") % 200 + 1
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("stats"))
    return s.withColumn("k", key).join(p, "k").select("anchor", "stats")


def ordering(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("s"), (F.col("vec_id") % 50).cast("string")).alias("sample_name"), F.col("vec_id").alias("kmer"), F.floor(F.col("vec_id") / 50).alias("start"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("kmer"), "embedding", "label")


def bed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bed")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata")

"""Selection, lookup and re-ranking of anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.indexing import with_index

# Fixed value: labels that mark an anchor as an artefact, matched anywhere without regard to case.
ARTIFACTS = "plas|illum|syn|arp|RF|JUNK|Ral|purge|P,|Univec"

#: So many anchors and clusters does the reference keep.
ANCHORS, CLUSTERS = 150_000, 4000


def lookup(anchors: DataFrame, labels: DataFrame) -> DataFrame:
    """``(ord, query, stats)``: the label of each anchor, null where there is none. Of several
    labels the smallest counts."""
    one = labels.groupBy("anchor").agg(F.min("stats").alias("stats"))
    return anchors.join(one, "anchor", "left").select("ord", F.col("anchor").alias("query"), "stats")


def one_statistic(stats: DataFrame) -> DataFrame:
    """One row for each anchor: the row of largest effect, then of most samples."""
    best = F.max(F.struct("effect_size_bin", "number_nonzero_samples")).alias("b")
    return stats.where("anchor is not null").groupBy("anchor").agg(best).select("anchor", "b.effect_size_bin", "b.number_nonzero_samples")


def select_anchors(stats: DataFrame, labels: DataFrame, n: int = ANCHORS, cutoff: float = 0.7) -> DataFrame:
    """``(anchor, effect_size_bin, number_nonzero_samples)``: anchors of at least ``cutoff``
    effect without an artefact label, the n with most samples; ties by anchor, nulls last.
    The limit keeps n rows a task before anything is sent."""
    s = one_statistic(stats).where(F.col("effect_size_bin") >= cutoff)
    bad = labels.where(F.col("stats").rlike(f"(?i)({ARTIFACTS})")).select("anchor").distinct()
    kept = s.join(bad, "anchor", "left_anti")
    return kept.orderBy(F.desc_nulls_last("number_nonzero_samples"), "anchor").limit(n)


def reorder_clusters(clusters: DataFrame, stats: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """``(cluster_id, anchor, place)``: clusters renumbered from 1 by mean effect times mean number
    of samples, members by the product of their own. A cluster with a member that has no
    statistic (or one under the cutoff) has no mean and comes last; ties by old id, then anchor.
    Numbers come from range partitions, so neither the clusters nor a hot one meet in one task."""
    s = one_statistic(stats).where(F.col("effect_size_bin") >= cutoff)
    members = clusters.dropna(subset=["cluster_id", "anchor"]).select("cluster_id", "anchor").distinct()
    d = members.join(s, "anchor", "left")
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    means = d.groupBy("cluster_id").agg((whole("effect_size_bin") * whole("number_nonzero_samples")).alias("sort_val"))
    last = F.lit(float("inf"))
    rank = with_index(means.withColumn("minus", F.coalesce(-F.round("sort_val", 9), last)), ["minus", "cluster_id"], "n")
    own = F.round(F.col("effect_size_bin") * F.col("number_nonzero_samples"), 9)
    d = d.join(rank.select("cluster_id", (F.col("n") + 1).alias("new_id")), "cluster_id").select("new_id", "anchor", F.coalesce(-own, last).alias("minus"))
    d = with_index(d, ["new_id", "minus", "anchor"], "n")
    first = d.groupBy("new_id").agg(F.min("n").alias("first"))
    return d.join(first, "new_id").select(F.col("new_id").alias("cluster_id"), "anchor", (F.col("n") - F.col("first") + 1).alias("place"))


def top_clusters(reordered: DataFrame, most: int = CLUSTERS) -> DataFrame:
    return reordered.where(F.col("cluster_id") <= most).select("anchor")

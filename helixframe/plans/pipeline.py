"""The embedding pipeline as one composition of DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import longest_frame
from helixframe.operators.anchors import reorder_clusters, select_anchors
from helixframe.operators.cluster import shift_clusters
from helixframe.operators.features import selected_features
from helixframe.operators.kmers import distinct_kmers, kmer_ordering, windows
from helixframe.operators.satc import cluster_sample_sequence
from helixframe.operators.model import Fits, fit_labels
from helixframe.runtime import cut, growing, spread


def hashed_composition(proteins: DataFrame, dims: int = 64) -> DataFrame:
    """``(kmer, embedding)`` of ``(kmer, protein)``: hashed counts of three-letter words, a
    deterministic stand-in where no protein model is at hand."""
    import numpy as np
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        for pdf in parts:
            out = []
            for p in pdf["protein"]:
                v = np.zeros(dims)
                for i in range(len(p) - 2):
                    h = crc32(p[i : i + 3].encode())
                    v[h % dims] += 1 if h >> 16 & 1 else -1
                out.append(v.tolist())
            yield pd.DataFrame({"kmer": pdf["kmer"], "embedding": out})

    return proteins.select("kmer", "protein").mapInPandas(run, "kmer string, embedding array<double>")


def run(satc: DataFrame, stats: DataFrame, labels: DataFrame, *, anchors: int = 150_000, cutoff: float = 0.7, clusters: int = 4000, k: int = 54, keep: int = 40, max_shift: int = 5, embedder: Callable[[DataFrame], DataFrame] = hashed_composition, table: int | str = 11) -> DataFrame:
    """Long features ``(sample_name, feature, value)`` from counts and statistics: select, cluster,
    reorder, cut off, sequence, decompose, translate, embed each distinct k-mer once, select by
    variance. Stages that are read twice are written to the shared folder."""
    seqs = cut(_sequences(satc, stats, labels, anchors, cutoff, clusters, max_shift))
    unique = distinct_kmers(seqs, k, k)
    proteins = unique.select(F.col("kmer_id").alias("kmer"), longest_frame("kmer", table)["protein"].alias("protein"))
    order = kmer_ordering(seqs, k, k).select(F.col("record_id").alias("sample_name"), F.col("kmer_id").alias("kmer"), "start")
    return selected_features(cut(order), cut(embedder(proteins)), keep)


def _sequences(satc: DataFrame, stats: DataFrame, labels: DataFrame, anchors: int, cutoff: float, clusters: int, max_shift: int) -> DataFrame:
    """``(ord, record_id, seq)``: the sequence of each sample over the clusters kept."""
    chosen = cut(select_anchors(stats, labels, anchors, cutoff).withColumn("id", F.xxhash64("anchor")))
    groups = shift_clusters(chosen.select("id", F.col("anchor").alias("seq")), max_shift).join(chosen.select("id", "anchor"), "id")
    ranked = cut(reorder_clusters(groups.select("cluster_id", "anchor"), stats, cutoff).where(F.col("cluster_id") <= clusters))
    listed = ranked.select(F.col("place").cast("long").alias("ord"), "cluster_id", "anchor")
    return cluster_sample_sequence(satc, listed).select(F.xxhash64("sample").alias("ord"), F.col("sample").alias("record_id"), "seq")


def described(satc: DataFrame, stats: DataFrame, labels: DataFrame, *, anchors: int = 150_000, cutoff: float = 0.7, clusters: int = 4000, k: int = 54, keep: int = 40, max_shift: int = 5, embedder: Callable[[DataFrame], DataFrame] = hashed_composition, table: int | str = 11) -> DataFrame:
    """``(feature, samples, mean, variance)`` of the features of :func:`run` over all its rows.

    All samples with one k-mer at a position have the same values there, so the k-mers of each
    position are counted and the moments weighted by these counts: neither the windows of all
    samples nor their values are ever written or sent."""
    seqs = _sequences(satc, stats, labels, anchors, cutoff, clusters, max_shift)
    place = (F.col("start") / k).cast("long").alias("position")
    per = cut(windows(seqs, k, k).groupBy(place, "kmer").agg(F.count("*").alias("n")))
    proteins = per.select("kmer").distinct().repartition(spread(satc.sparkSession)).select("kmer", longest_frame("kmer", table)["protein"].alias("protein"))
    d = per.join(growing(cut(embedder(proteins))), "kmer").select("position", F.col("n").cast("double").alias("n"), F.posexplode("embedding").alias("d", "v"))
    v = F.col("v").cast("double")
    sums = d.groupBy("position", "d").agg(F.sum("n").alias("n"), F.sum(F.col("n") * v).alias("one"), F.sum(F.col("n") * v * v).alias("two"))
    mean = F.col("one") / F.col("n")
    scatter = F.when(F.col("n") > 1, F.greatest(F.col("two") - F.col("one") * mean, F.lit(0.0)) / (F.col("n") - 1))
    w = Window.partitionBy("position").orderBy(F.desc_nulls_last(F.round("variance", 9)), "d")
    top = sums.select("position", "d", "n", mean.alias("mean"), scatter.alias("variance")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    name = F.concat(F.lit("cluster_"), F.col("position"), F.lit("_embedding_"), F.col("d") + 1)
    return top.select(name.alias("feature"), F.col("n").cast("long").alias("samples"), "mean", "variance")


def models(features: DataFrame, metadata: DataFrame, **options) -> Fits:
    """Last stage: a sparse model for every usable label on the features of :func:`run`."""
    return fit_labels(features, metadata, **options)

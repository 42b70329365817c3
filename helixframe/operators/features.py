"""Features from k-mer embeddings: positions, variances, principal components.

Embeddings stay in long form or arrays; no table gets a column for each dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.indexing import with_index
from helixframe.runtime import cut, growing, with_totals


def positions(ordering: DataFrame) -> DataFrame:
    """``(sample_name, kmer, position)``: 0-based place of each k-mer of a sample by start."""
    w = Window.partitionBy("sample_name").orderBy("start", "kmer")
    return ordering.select("sample_name", "kmer", (F.row_number().over(w) - 1).alias("position"))


def position_kmers(ordering: DataFrame) -> DataFrame:
    """``(position, kmers)``: the different k-mers of each position, joined by commas, in the
    order of the samples in which they first appear."""
    first = positions(ordering).groupBy("position", "kmer").agg(F.min("sample_name").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct("s", "kmer")))
    return first.groupBy("position").agg(F.array_join(F.transform(listed, lambda x: x["kmer"].cast("string")), ",").alias("kmers"))


def long_features(ordering: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(sample_name, position, dim, value)``; dims count from 1. K-mers without embedding drop out."""
    d = positions(ordering).join(growing(embeddings), "kmer")
    return d.select("sample_name", "position", F.posexplode("embedding").alias("d", "v")).select(
        "sample_name", "position", (F.col("d") + 1).alias("dim"), F.col("v").cast("double").alias("value")
    )


def embedding_variance(ordering: DataFrame, embeddings: DataFrame) -> DataFrame:
    return long_features(ordering, embeddings).groupBy("position", "dim").agg(F.var_samp("value").alias("variance"))


def top_variance_features(ordering: DataFrame, embeddings: DataFrame, n: int = 10) -> DataFrame:
    """``(position, dim)`` of the n dimensions of largest variance at each position."""
    w = Window.partitionBy("position").orderBy(F.desc_nulls_last(F.round("variance", 9)), "dim")
    v = embedding_variance(ordering, embeddings).withColumn("k", F.row_number().over(w))
    return v.where(F.col("k") <= n).select("position", "dim", F.col("k").alias("feature_rank"))


def selected_features(ordering: DataFrame, embeddings: DataFrame, n: int = 10) -> DataFrame:
    """``(sample_name, feature, value)`` of the selected dimensions, ``cluster_{p}_embedding_{d}``."""
    top = top_variance_features(ordering, embeddings, n).select("position", "dim")
    name = F.concat(F.lit("cluster_"), F.col("position"), F.lit("_embedding_"), F.col("dim"))
    return long_features(ordering, embeddings).join(top, ["position", "dim"]).select("sample_name", name.alias("feature"), "value")


def first_clusters(ordering: DataFrame, embeddings: DataFrame, n: int = 200) -> DataFrame:
    return long_features(ordering, embeddings).where(F.col("position") < n)


def sparse_rows(long: DataFrame, feature: str = "feature") -> tuple[DataFrame, DataFrame]:
    """``(sample_name, indices, vals, width)`` with ascending indices, and ``(feature, i)``, the
    number of each feature by name. Of repeated values of a sample the largest counts."""
    names = cut(with_index(long.select(feature).distinct(), [feature], "i").withColumn("i", F.col("i").cast("int")))
    width = names.agg(F.count("*").cast("int").alias("width"))
    one = long.join(growing(names), feature).groupBy("sample_name", "i").agg(F.max("value").alias("value"))
    got = F.array_sort(F.collect_list(F.struct("i", "value")))
    per = one.groupBy("sample_name").agg(got.alias("x")).select("sample_name", F.col("x.i").alias("indices"), F.col("x.value").alias("vals"))
    return with_totals(per, width), names


def vectors(long: DataFrame, feature: str = "feature") -> DataFrame:
    """``(sample_name, features)``: one dense array for each sample in the order of the feature
    names; missing values are 0. The gaps between the values present are filled in one pass."""
    rows, _ = sparse_rows(long, feature)
    gap = "array_repeat(0D, {} - if(k = 0, 0, indices[k - 1] + 1))"
    parts = F.expr(f"flatten(transform(indices, (i, k) -> concat({gap.format('i')}, array(vals[k]))))")
    return rows.select("sample_name", F.concat(parts, F.expr("array_repeat(0D, width - indices[size(indices) - 1] - 1)")).alias("features"))


def prefixed_components(ordering: DataFrame, loadings: DataFrame) -> DataFrame:
    """``(sample_name, feature, value)``: the loadings of the k-mer at each position of a sample,
    named ``cluster_{p}_PC_{i}``; the wide table of samples by components in long form."""
    name = F.concat(F.lit("cluster_"), F.col("position"), F.lit("_PC_"), F.col("pc"))
    return positions(ordering).join(growing(loadings), "kmer").select("sample_name", name.alias("feature"), F.col("loading").alias("value"))


def feature_parts(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Adds ``position`` and ``dim`` taken from names ``cluster_{p}_{kind}_{d}``; null where a name
    has another form."""
    part = lambda i: F.nullif(F.regexp_extract(feature, r"^cluster_(\d+)_[A-Za-z]+_(\d+)$", i), F.lit("")).cast("long")
    return df.withColumn("position", part(1)).withColumn("dim", part(2))


def annotated(coefs: DataFrame, ordering: DataFrame) -> DataFrame:
    """Coefficients with ``position``, ``dim`` and ``kmers``, the k-mers at that position; features
    of another form, as the intercept, keep nulls."""
    kmers = position_kmers(ordering).select(F.col("position").cast("long").alias("position"), "kmers")
    return feature_parts(coefs).join(kmers, "position", "left")


def principal_components(embeddings: DataFrame, n: int = 10, scale: bool = True, drop_first: bool = False) -> tuple[DataFrame, list[float]]:
    """Loadings ``(kmer, pc, loading)`` of a PCA whose variables are the k-mers and whose
    observations are the embedding dimensions, and the variance of each component kept.

    Each k-mer is centred (and scaled) over its own dimensions; the Gram matrix of the D
    dimensions is summed over all k-mers with a summarising aggregate of D x D cells, whatever
    their number, and decomposed on the driver; loadings are then row-local products. The
    largest absolute loading of a component is made positive.
    """
    import numpy as np
    import pandas as pd

    from collections.abc import Iterator

    d = embeddings.select("kmer", F.transform("embedding", lambda x: x.cast("double")).alias("e"))

    def rows(pdf: pd.DataFrame) -> np.ndarray:
        x = np.vstack(pdf["e"].to_numpy())
        x = x - x.mean(1, keepdims=True)
        if scale:
            sd = x.std(1, ddof=1, keepdims=True)
            x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
        return x

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            if len(pdf):
                x = rows(pdf)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = d.mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if cells.empty:
        return embeddings.sparkSession.createDataFrame([], "kmer string, pc int, loading double"), []
    size = int(cells["j"].max()) + 1
    g = np.zeros((size, size))
    g[cells["i"], cells["j"]] = g[cells["j"], cells["i"]] = cells["v"]
    values, u = np.linalg.eigh(g)
    order = np.argsort(values)[::-1]
    order = order[1 : n + 1] if drop_first else order[:n]
    weights = u[:, order] / np.sqrt(np.maximum(values[order], 1e-12))

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = rows(pdf) @ weights
                k = x.shape[1]
                yield pd.DataFrame({"kmer": np.repeat(pdf["kmer"].to_numpy(), k), "pc": np.tile(np.arange(1, k + 1), len(pdf)), "loading": x.ravel()})

    kind = embeddings.schema["kmer"].dataType.simpleString()
    out = d.mapInPandas(load, f"kmer {kind}, pc int, loading double")
    sign = out.groupBy("pc").agg(F.signum(F.max_by("loading", F.struct(F.abs("loading"), F.col("kmer")))).alias("sign"))
    return out.join(sign, "pc").select("kmer", "pc", (F.col("loading") * F.col("sign")).alias("loading")), [float(v) / (size - 1) for v in values[order]]

"""Readers and writers of the delimited text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe import schemas
from helixframe.operators.indexing import with_index
from helixframe.runtime import growing


def read_tsv(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> DataFrame:
    """Tab-separated rows by position; further fields are ignored, missing ones are null."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, quote="", mode="PERMISSIVE")


def placed(df: DataFrame) -> DataFrame:
    """Adds the place of each row of a file scan: path, start of the split, row of the split.
    Splits are read in any order, but rows of one split in theirs."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``ord``, numbers from 0 in the order of path and place, to the rows of :func:`placed`."""
    return with_index(df, ["_file", "_at", "_row"], "ord").drop("_file", "_at", "_row")


def read_satc(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return read_tsv(spark, path, schemas.SATC, header)


def read_anchor_list(spark: SparkSession, path: str) -> DataFrame:
    lines = placed(spark.read.text(path)).withColumn("anchor", F.trim("value")).drop("value").where("anchor <> ''")
    return numbered(lines)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return numbered(placed(read_tsv(spark, path, schemas.CLUSTERS)))


def ranked_members(clusters: DataFrame) -> DataFrame:
    """Adds ``place``, the 1-based place of each line in its cluster, from numbers over the whole
    file less that of the cluster's first line; lines without a cluster are left out."""
    d = with_index(clusters.where("cluster_id is not null"), ["cluster_id", "ord"], "_n")
    first = d.groupBy("cluster_id").agg(F.min("_n").alias("_first"))
    return d.join(growing(first), "cluster_id").withColumn("place", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def read_sequence_table(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, seq, ord)`` of lines name, tab, sequence."""
    return numbered(placed(read_tsv(spark, path, schemas.SEQUENCE_TSV)))


def cluster_of_anchor(clusters: DataFrame) -> DataFrame:
    """``(anchor, cluster_id)``; of several lines of an anchor the last counts."""
    return clusters.dropna(subset=["anchor"]).groupBy("anchor").agg(F.max_by("cluster_id", "ord").alias("cluster_id"))


def anchors_of_cluster(clusters: DataFrame) -> DataFrame:
    """``(cluster_id, anchors)`` in file order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "anchor")))
    return clusters.where("anchor is not null").groupBy("cluster_id").agg(F.transform(listed, lambda x: x["anchor"]).alias("anchors"))


def read_stats(spark: SparkSession, path: str, cutoff: float | None = None, columns: int = 18) -> DataFrame:
    """Headered statistics, first columns only; the cut-off is applied while scanning."""
    df = spark.read.csv(path, sep="\t", header=True)
    df = df.select(*df.columns[:columns]).withColumn("effect_size_bin", F.col("effect_size_bin").try_cast("double"))
    df = df.withColumn("number_nonzero_samples", F.col("number_nonzero_samples").try_cast("long"))
    return df if cutoff is None else df.where(F.col("effect_size_bin") >= cutoff)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer, embedding)``: a name and any number of values, kept as one array."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].alias("kmer"), F.slice(f, 2, 1 << 20).cast("array<double>").alias("embedding"))


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.ORDERING).select("sample_name", "kmer", "start")


def read_metadata(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Headered metadata; without a column sample_name the first column is taken for it."""
    df = spark.read.csv(path, sep=sep, header=True)
    return df if "sample_name" in df.columns else df.withColumnRenamed(df.columns[0], "sample_name")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.BED)


def read_plain_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, seq)`` of bare sequence lines, named seq_0, seq_1, ...; lines that start
    with > are skipped."""
    lines = placed(spark.read.text(path)).where(~F.col("value").startswith(">") & (F.trim("value") != ""))
    return numbered(lines).select(F.concat(F.lit("seq_"), F.col("ord").cast("string")).alias("record_id"), F.trim("value").alias("seq"))


def urls_of(text: DataFrame, column: str = "value", pattern: str = 'url": "(ftp://[^"]*)"') -> DataFrame:
    """``(..., url)``: every address in fetched accession records, by pattern, one row each, beside
    the other columns. Null texts give no rows."""
    keep = [c for c in text.columns if c not in (column, "url")]
    return text.select(*keep, F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("url"))


def read_tensor_means(spark: SparkSession, path: str, layer: int = 33) -> DataFrame:
    """``(kmer, embedding)`` of a folder of serialized per-sequence embeddings; needs torch on the
    executors, which is optional."""

    def run(parts):
        import io

        import pandas as pd
        import torch

        for pdf in parts:
            names = [p.rsplit("/", 1)[-1].split(".")[0] for p in pdf["path"]]
            values = [torch.load(io.BytesIO(c), weights_only=True)["mean_representations"][layer].tolist() for c in pdf["content"]]
            yield pd.DataFrame({"kmer": names, "embedding": values})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(path).mapInPandas(run, "kmer string, embedding array<float>")


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, nullValue="", emptyValue="", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_name, feature, value)`` of a matrix of :func:`write_matrix` or of a headered text
    file whose first column names the sample; wide ones are melted, long ones stay. Inputs stay
    where they are."""
    parquet = not path.endswith((".tsv", ".txt", ".tsv.gz"))
    df = spark.read.parquet(path) if parquet else spark.read.csv(path, sep="\t", header=True)
    if {"sample_name", "feature", "value"} <= set(df.columns):
        return df.select("sample_name", "feature", "value")
    key, *rest = df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in rest]))
    return df.select(F.col(f"`{key}`").alias("sample_name"), cells.alias("x")).select("sample_name", "x.feature", "x.value")


def write_by_cluster(df: DataFrame, path: str, cluster: str = "cluster_id") -> None:
    df.repartition(cluster).write.partitionBy(cluster).csv(path, sep="\t")

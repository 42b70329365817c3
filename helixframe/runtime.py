"""Session helpers shared by every operator: lineage cuts and table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CODEC = "spark.sql.parquet.compression.codec"


def shared_dir(spark: SparkSession) -> str:
    """Folder in which intermediate tables are written.

    The cluster names it in ``spark.checkpoint.dir``; a folder of this machine is used only
    where the setting is absent, that is in tests and other local runs.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared one; :func:`clear` ends it."""
    return f"{shared_dir(spark)}/helixframe-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage and survives the loss of executors. Its size on disk says little
    about joins of what is exploded from it; :func:`growing` marks those.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`cut` that nothing reads any more, as the last round of a loop."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, once its results are consumed."""
    _delete(spark, run_dir(spark))


def growing(df: DataFrame) -> DataFrame:
    """Marks the side of a join that grows with the data, whatever the planner takes its size
    for: it is joined by sorting and never broadcast."""
    return df.hint("merge")


def checked(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A side of a join that is usually small: broadcast if it has at most ``most`` rows, which
    are counted, and joined by sorting beyond that. Meant for tables of :func:`cut` with few and
    narrow columns."""
    return F.broadcast(df) if df.count() <= most else growing(df)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the columns of a table that is one row, an aggregate of everything."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def spread(spark: SparkSession) -> int:
    """Partitions for rows of few bytes and much work, which must not follow their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def wide_rows(spark: SparkSession) -> None:
    """Lets the Parquet writer look at its buffers after each row, not after a hundred first: rows
    may be megabytes wide. Unless the session names a codec, files are packed by zstd, which makes
    little of long runs where snappy leaves a twentieth. Files hold the same."""
    spark.conf.set("parquet.page.size.row.check.min", "1")
    if spark.conf.get(CODEC, None) is None:
        spark.conf.set(CODEC, "zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

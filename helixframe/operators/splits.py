"""Reproducible splits, class filters and label discovery.

Random orders come from md5 of the row id, so that they are the same everywhere and in SQL too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ranking import distributed_rank
from helixframe.runtime import growing, with_totals


def draw(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def uniform(key: Column, seed: int = 42) -> Column:
    """Number in [0, 1) from the first 8 hexadecimal digits of the draw."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn(key: Column, seed: int = 42) -> Column:
    """The draw as a bigint in the same order."""
    return F.conv(F.substring(draw(key, seed), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def _numbered(df: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    """Adds ``_k``, the place of each row of a class in the order of the draw, and ``_n``, the size
    of the class. A hot class is ranked in slices of the draw."""
    d = distributed_rank(df, [by], drawn(F.col(key), seed), [draw(F.col(key), seed), key], "_k")
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    return d.join(growing(n), d[by].eqNullSafe(n["_by"])).drop("_by")


def bernoulli_split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    u = uniform(F.col(key), seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def _by_shares(train: float, val: float) -> Column:
    upto = lambda share: F.col("_k") <= F.floor(F.col("_n") * share + 1e-9)
    return F.when(upto(train), "train").when(upto(train + val), "val").otherwise("test")


def prefix_of(name: str, delimiter: str = "_") -> Column:
    return F.split_part(F.col(name), F.lit(delimiter), F.lit(1))


def prefix_split(df: DataFrame, name: str, delimiter: str = "_", train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Rows whose names share the text before the delimiter get the same split; of all prefixes
    floor(train * n) go to train, as many more as make floor((train + val) * n) to val, the rest
    to test. Adds ``prefix`` and ``split``; rows without a name are left out."""
    d = df.drop("split").withColumn("prefix", prefix_of(name, delimiter)).where("prefix is not null")
    p = d.select("prefix").distinct().withColumn("_all", F.lit(0))
    p = _numbered(p, "prefix", "_all", seed).select("prefix", _by_shares(train, val).alias("split"))
    return d.join(growing(p), "prefix")


def prefix_stratified_split(df: DataFrame, name: str, meta: DataFrame, delimiter: str = "_", train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """As :func:`prefix_split`, with the shares met among the prefixes of each class of ``meta``
    ``(prefix, metadata)``; rows whose prefix has no class there are left out."""
    d = df.drop("split").withColumn("prefix", prefix_of(name, delimiter))
    p = meta.select("prefix", "metadata").dropna().distinct()
    p = _numbered(p, "prefix", "metadata", seed).select("prefix", _by_shares(train, val).alias("split"))
    return d.join(growing(p), "prefix")


def stratified_split(df: DataFrame, key: str, by: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Shares of every class: floor(train * n) rows to train, as many more as make
    floor((train + val) * n) to val, the rest to test. Null classes form one class."""
    d = _numbered(df, key, by, seed)
    return d.withColumn("split", _by_shares(train, val)).drop("_k", "_n")


def balanced_split(df: DataFrame, key: str, by: str, train: float = 0.5, even: bool = False, seed: int = 42) -> DataFrame:
    """Every class gives floor(train * size of the smallest class) rows to train; the others test,
    or, with ``even``, only as many as even out all classes. Rows without a class are left out."""
    d = df.where(F.col(by).isNotNull())
    least = d.groupBy(by).count().agg(F.min("count").alias("_m"))
    d = with_totals(_numbered(d, key, by, seed), least)
    d = d.withColumn("split", F.when(F.col("_k") <= F.floor(F.col("_m") * train + 1e-9), "train").otherwise("test"))
    if even:
        d = d.where(F.col("_k") <= F.col("_m"))
    return d.drop("_k", "_n", "_m")


def balanced_three_way_split(df: DataFrame, key: str, by: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Every class gives floor(train * size of the smallest class) rows to train; of the rest of
    each class floor(val / (val + test) * rest) go to val, the others to test. Rows without a
    class are left out."""
    d = df.where(F.col(by).isNotNull())
    least = d.groupBy(by).count().agg(F.min("count").alias("_m"))
    d = with_totals(_numbered(d, key, by, seed), least)
    first = F.floor(F.col("_m") * train + 1e-9)
    second = first + F.floor((F.col("_n") - first) * (val / (val + test)) + 1e-9)
    split = F.when(F.col("_k") <= first, "train").when(F.col("_k") <= second, "val").otherwise("test")
    return d.withColumn("split", split).drop("_k", "_n", "_m")


def mutual(left: DataFrame, right: DataFrame, key: str = "sample_name") -> tuple[DataFrame, DataFrame]:
    """Rows of both tables whose key the other one has too."""
    keep = lambda a, b: a.join(growing(b.select(key).dropna().distinct()), key, "left_semi")
    return keep(left, right), keep(right, left)


def replicate_train(df: DataFrame, n: int) -> DataFrame:
    """Train rows n times (at least once), the others once."""
    times = F.when(F.col("split") == "train", max(n, 1)).otherwise(1)
    return df.select("*", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def class_filter(df: DataFrame, by: str, minimum: int, inclusive: bool = False) -> DataFrame:
    """Rows whose class has more than ``minimum`` rows (or at least so many). Null and empty
    classes are left out. The counts are aggregated before they meet the rows."""
    d = df.withColumn(by, F.nullif(F.col(by), F.lit(""))).where(F.col(by).isNotNull())
    n = d.groupBy(by).count()
    big = n.where(F.col("count") >= minimum if inclusive else F.col("count") > minimum).select(by)
    return d.join(big, by, "left_semi")


def usable_labels(meta: DataFrame, minimum: int = 30) -> DataFrame:
    """``(metadata, classes)`` of a long table (metadata, class): categories with at least two
    classes of more than ``minimum`` rows each."""
    n = meta.where("metadata is not null and class is not null and class <> ''").groupBy("metadata", "class").count().where(F.col("count") > minimum)
    return n.groupBy("metadata").agg(F.count("*").alias("classes")).where("classes >= 2")


def prefix_metadata(bed: DataFrame, meta: DataFrame, delimiter: str = "_") -> DataFrame:
    """``(prefix, metadata)``: first non-empty value of each prefix by bed order; of several
    values of a sample the last listed counts."""
    m = meta.dropna(subset=["sample_name"]).groupBy("sample_name").agg(F.max_by("class", "ord").alias("value"))
    d = bed.dropna(subset=["sample_name"]).join(m, "sample_name").where("value is not null and value <> ''")
    p = d.withColumn("prefix", F.split_part("sample_name", F.lit(delimiter), F.lit(1)))
    return p.groupBy("prefix").agg(F.min_by("value", "ord").alias("metadata"))

"""A sample whose class shares match targets, by a divisor method with floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranking import distributed_rank
from helixframe.runtime import cut


def class_key(c: Column) -> Column:
    """Classes compare without regard to case, outer blanks, or which and how many of blank,
    underscore and hyphen stand between words. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s_\- ]+", " ")))


def current_samples(df: DataFrame) -> DataFrame:
    """``(sample_name, metadata, class)``: of each sample and category the row with the largest
    ord. Rows with a null sample_name or metadata are left out; a null class stays."""
    d = df.select("ord", "sample_name", "metadata", F.col("class").alias("class")).where("sample_name is not null and metadata is not null")
    last = d.groupBy("sample_name", "metadata").agg(F.max_by("class", "ord").alias("class"))
    return last


def targets_of(targets: DataFrame) -> DataFrame:
    t = targets.select("metadata", F.col("class").alias("class"), "target_share", "min_rows", "sample_size")
    wanted = F.greatest(F.round(F.round(F.col("target_share") * F.col("sample_size"), 6)).cast("long"), F.coalesce("min_rows", F.lit(0)))
    return t.withColumn("key", class_key(F.col("class"))).withColumn("wanted", wanted)


def pool_of(meta: DataFrame, targets: DataFrame) -> DataFrame:
    """Samples that can be drawn, each with its target row. The target table is a fixed report
    form; Spark broadcasts it only if it is as small as that."""
    m = current_samples(meta).withColumn("key", class_key(F.col("class"))).drop("class")
    return m.join(targets_of(targets), ["metadata", "key"])


def draw(meta: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``(metadata, class, sample_name, rank_no)``: sample_size samples of each category.

    Within a class samples are numbered in random (hashed) order; the ``rank``-th has priority
    ``(rank - 0.5) / target_share``, so that taking the smallest priorities of the category hands
    out its seats by the divisor method of odd numbers. The first ``min_rows`` of each class come
    before all others. A class that runs out simply has no further rows: its seats go to the
    others in proportion. A class of share 0 is used for its floor only.

    The cut is found from a histogram of priorities; only the cell in which the sample fills up is
    ranked, everything below it is taken as it is. Nulls as in :func:`current_samples`; a table
    without matching rows gives no rows.
    """
    return _drawn(meta, targets, seed)[0]


def _drawn(meta: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The drawn rows, and all rows on offer with their rank in the class."""
    pool = pool_of(meta, targets).select("metadata", "class", "sample_name", "target_share", "min_rows", "sample_size")
    ranked = distributed_rank(pool, ["metadata", "class"], F.xxhash64("sample_name", F.lit(seed)), ["sample_name"], "rank_no")
    prio = F.when(F.col("rank_no") <= F.coalesce("min_rows", F.lit(0)), F.lit(-1.0)).when(F.col("target_share") > 0, (F.col("rank_no") - 0.5) / F.col("target_share"))
    # a class is drawn about share * size deep; the cell is the priority in 1/256 of that depth
    cell = F.least(F.floor(F.col("priority") * 256 / F.greatest("sample_size", F.lit(1))), F.lit(1 << 40)).cast("long")
    offered = cut(ranked.withColumn("priority", prio).withColumn("cell", cell))
    ranked = offered.where("priority is not null")
    hist = ranked.groupBy("metadata", "cell").agg(F.count("*").alias("c"))
    below = F.sum("c").over(Window.partitionBy("metadata").orderBy("cell")) - F.col("c")
    hist = hist.select("metadata", "cell", "c", below.alias("below"))
    d = ranked.join(hist, ["metadata", "cell"]).where("below < sample_size")
    whole = d.where("below + c <= sample_size")
    edge = d.where("below + c > sample_size")
    w = Window.partitionBy("metadata").orderBy("priority", "class", F.xxhash64("sample_name", F.lit(seed)), "sample_name")
    edge = edge.withColumn("pos", F.row_number().over(w)).where("pos <= sample_size - below").drop("pos")
    return whole.union(edge).select("metadata", "class", "sample_name", "rank_no"), offered


def report(meta: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """One row for each target: rows wanted, available, drawn and missing.

    Every class is offered the larger of its share and its floor; what it has to offer is counted
    over the numbered rows of :func:`draw`, what it got over the drawn ones.
    """
    drawn, offered = _drawn(meta, targets, seed)
    got = drawn.groupBy("metadata", "class").agg(F.count("*").alias("drawn"))
    have = offered.groupBy("metadata", "class").agg(F.max("rank_no").alias("available"))
    t = targets_of(targets).select("metadata", "class", "wanted")
    t = t.join(have, ["metadata", "class"], "left").join(got, ["metadata", "class"], "left")
    t = t.select("metadata", "class", "wanted", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
    return t.withColumn("missing", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)))


def shortages(meta: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``(metadata, class, wanted, available, drawn)`` of the rows of :func:`report` whose class
    has fewer samples than it is offered."""
    return report(meta, targets, seed).where("available < wanted").select("metadata", "class", "wanted", "available", "drawn")

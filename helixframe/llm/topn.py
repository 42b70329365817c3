"""Top N records within every group: score histograms, a safe threshold, exact ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import cut, growing

#: Cells of the score histogram.
CELLS = 64


def score_bounds(df: DataFrame, score: str, cells: int = CELLS) -> list[float]:
    """Ascending cell borders, approximate quantiles of the score over the whole table. Any
    borders give right results; quantiles give cells of about equal size."""
    points = [i / cells for i in range(1, cells)]
    row = df.select(F.percentile_approx(F.col(score).cast("double"), F.array(*map(F.lit, points)), 2000).alias("q")).first()
    return sorted({float(x) for x in (row.q or [])})


def cell_of(score: Column, bounds: list[float]) -> Column:
    """Number of borders below the score: never decreasing in it."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < score.cast("double")))


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int = 5, salts: int = 16) -> DataFrame:
    """The ``n`` rows of each group with the smallest ``score``, equal scores by ``tie``.

    Returns ``group, tie, score, position``. Rows with a null group or score are left out; a null
    tie comes first; smaller groups give all their rows; rows equal in both stand in any order.
    Extra columns are ignored.

    One pass counts rows by group and score cell; in each group the first cell up to which at
    least ``n`` rows lie is a safe threshold. Rows above it are filtered, which leaves about n
    rows a group unless scores are tied. The rest are ranked twice with the tie key: within
    ``salts`` slices of a group, then over the survivors, at most salts * n, so that a group made
    of one huge tie is not ranked in one task either.
    """
    d = df.select(F.col(group).alias("g"), F.col(score).alias("v"), F.col(tie).alias("t")).where("g is not null and v is not null")
    bounds = score_bounds(d, "v")
    d = d.withColumn("cell", cell_of(F.col("v"), bounds))
    hist = d.groupBy("g", "cell").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("cell"))
    limit = cut(
        hist.withColumn("upto", upto)
        .groupBy("g")
        .agg(F.min(F.when(F.col("upto") >= n, F.col("cell"))).alias("last"), F.sum("c").alias("all"))
        .where(F.col("all") > n)
        .select("g", "last")
    )
    # the limits stand once for each salt, so that the rows of a hot group meet them in many tasks
    limit = limit.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = d.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("long"))
    kept = salted.join(growing(limit), ["g", "salt"], "left").where("last is null or cell <= last")
    order = [F.col("v").asc(), F.col("t").asc_nulls_first()]
    part = kept.withColumn("rn", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("rn") <= n)
    out = part.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("position") <= n)
    return out.select(F.col("g").alias(group), F.col("t").alias(tie), F.col("v").alias(score), "position")

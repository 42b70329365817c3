"""Connected components by hooking, shortcutting and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.runtime import cut, drop, growing


def scramble(v: Column) -> Column:
    """One-to-one shuffle of 64-bit ids (xorshift), so that chains of increasing ids do not
    make long chains of parents."""
    for left, right in ((13, 7), (17, 11)):
        v = v.bitwiseXOR(F.shiftleft(v, left))
        v = v.bitwiseXOR(F.shiftrightunsigned(v, right))
    return v


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every end of an edge; component is its smallest id.

    Each round hooks every vertex to its smallest neighbour, shortcuts the parent table once
    against itself, and replaces the ends of all edges by their parents. The edge table shrinks
    by a constant factor a round, so the rounds are logarithmic in the number of vertices and
    no vertex, link or component ever reaches the driver. Hot vertices are harmless: all
    aggregates are minima, combined before the shuffle.

    Edges with a null end are ignored; self loops give a component of one; no edges give no rows.
    """
    e = edges.select(F.col(src).cast("long").alias("a0"), F.col(dst).cast("long").alias("b0")).dropna()
    ids = cut(
        e.select(F.explode(F.array("a0", "b0")).alias("id")).distinct().withColumn("label", scramble(F.col("id")))
    )
    live = cut(
        e.select(scramble(F.col("a0")).alias("a"), scramble(F.col("b0")).alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    label = ids
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("p")
        )
        hook = cut(hook)
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = cut(hook.join(growing(up), "p").select("v", F.col("pp").alias("p")))
        old = label, live, hook, parent
        label = cut(
            label.join(growing(parent.withColumnRenamed("v", "label")), "label", "left").select(
                "id", F.coalesce("p", "label").alias("label")
            )
        )
        live = cut(
            live.join(growing(parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))), "a")
            .join(growing(parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        drop(*old)
    smallest = label.groupBy("label").agg(F.min("id").alias("component"))
    return label.join(growing(smallest), "label").select("id", "component")

"""Clustering of sequences by shift overlap and edit distance.

Pairs come from keys of pieces of the sequences, never from comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.blockjoin import HOT, joined
from helixframe.operators.graph import connected_components
from helixframe.operators.indexing import with_index
from helixframe.operators.power import power_vector
from helixframe.runtime import cut, drop, growing


#: Sequences for each leader wanted among which leaders are looked for first.
FIRST = 2


def shift_edges(seqs: DataFrame, max_shift: int = 5) -> DataFrame:
    """``(src, dst)`` for ``(id, seq)`` of one length: src without its first letters equals dst
    without as many last ones, for some shift up to ``max_shift``. Distinct, self loops included.
    ``max_shift`` must be smaller than the sequences."""
    d = seqs.select("id", "seq", F.explode(F.sequence(F.lit(1), F.lit(max_shift))).alias("shift")).where(F.length("seq") > F.col("shift"))
    right = d.select(F.col("id").alias("src"), "shift", F.expr("substring(seq, shift + 1)").alias("key"))
    left = d.select(F.col("id").alias("dst"), "shift", F.expr("substring(seq, 1, length(seq) - shift)").alias("key"))
    return right.join(growing(left), ["shift", "key"]).select("src", "dst").distinct()


def clusters_by_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cluster_id, id)`` for all nodes: components numbered from 0 by size, largest first, then
    by smallest id. Nodes without an edge are clusters of one."""
    comp = connected_components(edges, "src", "dst").select("id", "component")
    lab = cut(nodes.select("id").join(growing(comp), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    size = lab.groupBy("component").agg((-F.count("*")).alias("minus"))
    num = with_index(size, ["minus", "component"], "cluster_id")
    return lab.join(growing(num), "component").select("cluster_id", "id")


def shift_clusters(seqs: DataFrame, max_shift: int = 5, merge_unknown: bool = False) -> DataFrame:
    """Connected components of :func:`shift_edges`; ``merge_unknown`` first turns every letter
    other than A, C, G and T into N, so that they equal each other."""
    s = seqs.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "N")) if merge_unknown else seqs
    return clusters_by_size(seqs, shift_edges(s, max_shift))


def edit_distance_join(left: DataFrame, right: DataFrame, d: int, hot: int = HOT) -> DataFrame:
    """``(a, b, dist)`` for ``left(a, sa)`` and ``right(b, sb)`` within ``d`` edits: blocks of both
    meet in tasks (:mod:`helixframe.operators.blockjoin`), the smaller side is indexed there. Null
    sequences match nothing."""
    return joined(left.select(F.col("a").alias("id"), F.col("sa").alias("s")), right.select(F.col("b").alias("id"), F.col("sb").alias("s")), d, hot)


def lev_pairs(seqs: DataFrame, d: int = 5) -> DataFrame:
    """``(src, dst, dist)`` with src < dst for ``(id, seq)``."""
    return joined(seqs.select("id", F.col("seq").alias("s")), None, d).toDF("src", "dst", "dist")


def lev_clusters(seqs: DataFrame, d: int = 5) -> DataFrame:
    return clusters_by_size(seqs, cut(lev_pairs(seqs, d).select("src", "dst")))


def nearest_seed(seqs: DataFrame, seeds: DataFrame, bound: int) -> DataFrame:
    """``(id, seed_id, dist)``: the nearest seed at a distance under ``bound``, the smallest id
    among equals; sequences without one are left out."""
    hits = edit_distance_join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("sa")), seeds.select(F.col("seed_id").alias("b"), F.col("seq").alias("sb")), bound - 1)
    best = hits.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select(F.col("a").alias("id"), F.col("m.b").alias("seed_id"), F.col("m.dist").alias("dist"))


def sampled_pairs(seqs: DataFrame, d: int = 5, share: float = 0.5, seed: int = 7) -> DataFrame:
    """``(src, dst, dist)`` of two samples of the sequences, each of about ``share`` of them by
    hash, within ``d`` edits; src and dst may come in either order and be equal."""
    part = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 20)) < int(share * (1 << 20))
    a = seqs.where(part(0)).select(F.col("id").alias("a"), F.col("seq").alias("sa"))
    b = seqs.where(part(1)).select(F.col("id").alias("b"), F.col("seq").alias("sb"))
    return edit_distance_join(a, b, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist")


def assign_to_clusters(seqs: DataFrame, clusters: DataFrame, threshold: int = 10, most: int | None = None, seed: int = 7) -> DataFrame:
    """``(id, cluster_id, dist)``: the cluster with the nearest member within ``threshold``; among
    equals the one listed first. ``clusters`` is (ord, cluster_id, seq). With ``most`` each cluster
    is known by so many of its members, drawn by hash; ranks are cut before the shuffle too."""
    first = clusters.groupBy("cluster_id").agg(F.min("ord").alias("listed"))
    if most is not None:
        w = Window.partitionBy("cluster_id").orderBy(F.xxhash64("ord", F.lit(seed)), "ord")
        clusters = clusters.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    m = clusters.join(growing(first), "cluster_id").groupBy(F.col("seq").alias("sb")).agg(F.min(F.struct("listed", "cluster_id")).alias("c"))
    m = with_index(m.where("sb is not null"), ["sb"], "b")
    m = cut(m.withColumn("b", F.col("b").cast("long")))
    hits = edit_distance_join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("sa")), m.select("b", "sb"), threshold).join(growing(m.select("b", "c")), "b")
    best = hits.groupBy("a").agg(F.min(F.struct("dist", "c")).alias("m"))
    return best.select(F.col("a").alias("id"), F.col("m.c.cluster_id").alias("cluster_id"), F.col("m.dist").alias("dist"))


def leader_clusters(seqs: DataFrame, d: int = 10, order: Column | str | None = None, most: int | None = None, seed: int = 7) -> DataFrame:
    """``(id, leader)``: greedy leaders in the order of ``order``, every sequence closer than ``d``
    to a leader follows the nearest one.

    The sequential scan makes a sequence a leader unless an earlier leader is nearer than d. Its
    result is the first independent set of the graph of near pairs, found in rounds: sequences
    all of whose earlier neighbours are settled followers lead, their later neighbours follow.
    Without ``order`` sequences are shuffled by hash, as the scan asks for; then the rounds, which
    are the length of the longest chain of ascending neighbours at most, are few (logarithmic in
    the rows). With ``most`` the scan ends after so many leaders, and sequences near none of them
    get no row; leaders are then looked for among the first ``FIRST * most`` sequences, and among
    more as long as those hold too few.
    """
    by = F.xxhash64("id", F.lit(seed)) if order is None else (F.col(order) if isinstance(order, str) else order)
    rank = F.struct(by.alias("by"), F.col("id").alias("own"))
    ranks = cut(seqs.select("id", rank.alias("r"), "seq"))
    total = ranks.count()
    first = total if most is None else FIRST * most
    while True:
        # leaders among the first are leaders whatever follows them
        some = ranks if first >= total else cut(ranks.orderBy("r").limit(first))
        leaders, near = _leaders(some, d)
        if most is None or first >= total or leaders.count() >= most:
            break
        first *= 8
    if most is not None:
        leaders = cut(leaders.join(growing(ranks.select("id", "r")), "id").orderBy("r").limit(most).select("id"))
    if first >= total:
        # the near pairs of all are known, and leaders are not near each other
        near = near.select(F.col("src").alias("a"), F.col("dst").alias("b"), "dist").union(near.select("dst", "src", "dist"))
        near = near.join(growing(leaders.select(F.col("id").alias("a"))), "a")
    else:
        led = ranks.join(growing(leaders), "id", "left_semi").select(F.col("id").alias("a"), F.col("seq").alias("sa"))
        near = edit_distance_join(led, ranks.select(F.col("id").alias("b"), F.col("seq").alias("sb")), d - 1)
    best = near.groupBy("b").agg(F.min(F.struct("dist", "a")).alias("m")).select(F.col("b").alias("id"), F.col("m.a").alias("leader"))
    return leaders.select("id", F.col("id").alias("leader")).union(best.join(growing(leaders), "id", "left_anti"))


def _leaders(ranks: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """``(id)`` of the leaders of ``(id, r, seq)`` in the order of r, and the near pairs ``(src, dst,
    dist)`` of all, src before dst."""
    near = lev_pairs(ranks.select("id", "seq"), d - 1)
    near = near.join(growing(ranks.select(F.col("id").alias("src"), F.col("r").alias("rs"))), "src").join(growing(ranks.select(F.col("id").alias("dst"), F.col("r").alias("rd"))), "dst")
    up = F.col("rs") < F.col("rd")
    near = cut(near.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"), "dist"))
    state = cut(ranks.select("id").withColumn("lead", F.lit(None).cast("boolean")))
    while True:
        before = near.join(growing(state.select(F.col("id").alias("src"), "lead")), "src").groupBy("dst").agg(
            F.max(F.coalesce("lead", F.lit(False))).alias("led"), F.max(F.col("lead").isNull()).alias("open")
        )
        s = state.join(growing(before), state["id"] == before["dst"], "left")
        now = F.when(F.col("led"), False).when(~F.coalesce("open", F.lit(False)), True)
        old, state = state, cut(s.select("id", F.coalesce("lead", now).alias("lead")))
        drop(old)
        if state.where("lead is null").isEmpty():
            return cut(state.where("lead").select("id")), near


def spectral_clusters(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """``(id, cluster)`` by power iteration on ``(src, dst, weight)`` and k-means of the vector, of
    which different values are taken once, with their number; labels carry no order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = cut(power_vector(edges, iterations))
    x = cut(v.groupBy("v").agg(F.count("*").cast("double").alias("n"))).withColumn("x", array_to_vector(F.array("v")))
    found = KMeans(k=k, seed=0, featuresCol="x", weightCol="n").fit(x).transform(x).select("v", F.col("prediction").alias("cluster"))
    return v.join(growing(found), "v").select("id", "cluster")


def profile_clusters(seqs: DataFrame, clusters: int = 3000, k: int = 3, seed: int = 7) -> DataFrame:
    """``(id, cluster)`` by bisecting k-means on counts of k-letter words; at most ``clusters``."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import CountVectorizer

    from helixframe.operators.kmers import window_array

    words = seqs.select("id", window_array(F.col("seq"), k, 1).alias("words")).where("words is not null")
    v = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5**k).fit(words).transform(words)
    return BisectingKMeans(k=clusters, seed=seed).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def ordered_by_effect(members: DataFrame, stats: DataFrame) -> DataFrame:
    """``(place, cluster, anchor, effect_size_bin)`` of ``members(cluster, anchor)``: by cluster,
    then largest effect, nulls last, then text; numbered from 0 over range partitions."""
    d = members.join(growing(stats.select("anchor", "effect_size_bin")), "anchor", "left")
    d = d.withColumn("_minus", F.coalesce(-F.col("effect_size_bin"), F.lit(float("inf"))))
    return with_index(d, ["cluster", "_minus", "anchor"], "place").select("place", "cluster", "anchor", "effect_size_bin")

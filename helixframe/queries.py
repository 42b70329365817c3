"""Queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import anchors, cluster, features, kmers, model, satc, splits
from helixframe.operators.graph import connected_components
from helixframe.operators.indexing import with_index
from helixframe.plans import pipeline
from helixframe.plans import relations as rel
from helixframe.runtime import cut, growing, new_path, table
from helixframe.sources import fasta, tables
from helixframe.streaming.sequences import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CLEAN = "regexp_replace(upper({}), '[^ACGTN]', '', 'g')"
READS = f"reads AS (SELECT ord, 'r' || ord AS record_id, {CLEAN.format('anchor')} AS seq FROM anchor_clusters WHERE {CLEAN.format('anchor')} <> '')"
SATC = f"""c0 AS (SELECT sample, {CLEAN.format('anchor')} AS anchor, {CLEAN.format('target')} AS target, count, counted_at, loaded_at FROM satc),
    c1 AS (SELECT sample, anchor, target, counted_at, max(struct_pack(l := loaded_at, c := count)).c AS count FROM c0
           WHERE sample IS NOT NULL AND anchor <> '' AND target <> '' AND count IS NOT NULL GROUP BY ALL),
    sa AS (SELECT sample, anchor, target, CAST(sum(count) AS BIGINT) AS count FROM c1 GROUP BY ALL)"""
ANCHORS = "al AS (SELECT row_number() OVER (ORDER BY c DESC, anchor) - 1 AS ord, anchor FROM (SELECT anchor, count(DISTINCT sample) AS c FROM sa GROUP BY anchor))"
CLUSTERS = f"cl AS (SELECT ord, cluster_id, {CLEAN.format('anchor')} AS anchor FROM anchor_clusters WHERE cluster_id IS NOT NULL AND {CLEAN.format('anchor')} <> '')"
RC = "translate(reverse({}), 'ACGT', 'TGCA')"
STATS = "st AS (SELECT anchor, b.e AS effect_size_bin, b.n AS number_nonzero_samples FROM (SELECT anchor, max(struct_pack(e := coalesce(effect_size_bin, -1), n := coalesce(number_nonzero_samples, -1))) AS b FROM anchor_stats WHERE anchor IS NOT NULL GROUP BY anchor))"
LABELS = "lb AS (SELECT anchor, p_name AS stats FROM (SELECT DISTINCT anchor FROM anchor_stats WHERE anchor IS NOT NULL) JOIN part ON p_partkey = CAST('0x' || substr(md5(anchor), 1, 6) AS BIGINT) % 200 + 1)"
ORDERING = "od AS (SELECT 's' || (vec_id % 50) AS sample_name, vec_id AS kmer, vec_id // 50 AS start FROM embeddings), ps AS (SELECT *, row_number() OVER (PARTITION BY sample_name ORDER BY start, kmer) - 1 AS position FROM od)"
LONG = ORDERING + ", lf AS (SELECT sample_name, position, d AS dim, CAST(embedding[d] AS DOUBLE) AS value FROM ps JOIN embeddings ON vec_id = kmer, unnest(range(1, len(embedding) + 1)) AS u(d))"


def protein(s: str) -> str:
    """Translation by table 1 in SQL; codons with N are resolved only by their first two letters."""
    i = lambda j: f"instr('TCAG', substr({s}, 3 * i + {j}, 1))"
    plain = f"substr('{sq.STANDARD}', CAST(({i(1)} - 1) * 16 + ({i(2)} - 1) * 4 + {i(3)} AS BIGINT), 1)"
    four = f"substr('{sq.STANDARD}', CAST(({i(1)} - 1) * 16 + ({i(2)} - 1) * 4 + 1 AS BIGINT), 1)"
    whole = f"CASE WHEN {i(1)} > 0 AND {i(2)} > 0 AND {i(3)} > 0 THEN {plain} WHEN substr({s}, 3 * i + 1, 2) IN ('CT', 'GT', 'TC', 'CC', 'AC', 'GC', 'CG', 'GG') THEN {four} ELSE 'X' END"
    return f"array_to_string(list_transform(range(length({s}) // 3), lambda i: {whole}), '')"


def peptide(p: str) -> str:
    t = f"regexp_replace(split_part({p}, '*', 1), '^X+|X+$', '', 'g')"
    return f"CASE WHEN length({t}) < 5 THEN 'X' ELSE {t} END"


@query(f"WITH {READS} SELECT record_id, {RC.format('seq')} AS seq FROM reads")
def revcomp(s, d):
    return rel.reads(s, d).select("record_id", sq.reverse_complement("seq").alias("seq"))


@query(f"WITH {READS} SELECT record_id, translate(translate(substr(reverse(replace(seq, 'N', '')), 1, 40), 'A', 'T'), 'C', 'G') AS seq FROM reads")
def jumble_chain(s, d):
    return rel.reads(s, d).select("record_id", sq.jumble("seq", drop_n=True, backwards=True, length=40, at=True, cg=True).alias("seq"))


@query()
def random_mutation(s, d):
    return rel.reads(s, d).select("record_id", sq.mutate("seq", "record_id", 0.1, 3).alias("seq"))


@query(f"WITH {READS} SELECT record_id, i AS start, i + 27 AS \"end\", substr(seq, CAST(i + 1 AS BIGINT), 27) AS kmer FROM reads, unnest(range(0, length(seq) - 26, 9)) AS u(i)")
def kmers_step(s, d):
    return kmers.windows(rel.reads(s, d), 27, 9).select("record_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kmer")


@query(f"WITH {READS}, b AS (SELECT record_id, '+' AS strand, seq FROM reads UNION ALL SELECT record_id, '-', {RC.format('seq')} FROM reads) SELECT record_id, strand, substr(seq, CAST(i + 1 AS BIGINT), 27) AS kmer FROM b, unnest(range(0, length(seq) - 26, 9)) AS u(i)")
def kmers_both_strands(s, d):
    return kmers.windows(rel.reads(s, d), 27, 9, True).select("record_id", "strand", "kmer")


@query(f"WITH {READS} SELECT motif, count(*) AS n FROM (SELECT substr(seq, CAST(i + 1 AS BIGINT), 9) AS motif FROM reads, unnest(range(0, length(seq) - 8)) AS u(i)) GROUP BY motif")
def motifs(s, d):
    return kmers.motifs(rel.reads(s, d), 9).groupBy("motif").agg(F.count("*").alias("n"))


KM = f"{READS}, w AS (SELECT ord, record_id, i AS start, substr(seq, CAST(i + 1 AS BIGINT), 18) AS kmer FROM reads, unnest(range(0, length(seq) - 17, 18)) AS u(i)), f AS (SELECT kmer, min(struct_pack(o := ord, s := start)) AS f FROM w GROUP BY kmer), dk AS (SELECT '18mer_' || (row_number() OVER (ORDER BY f) - 1) AS kmer_id, kmer FROM f)"


@query(f"WITH {KM} SELECT kmer_id, kmer FROM dk")
def kmer_decomposition(s, d):
    return kmers.distinct_kmers(rel.reads(s, d), 18)


@query(f"WITH {KM} SELECT record_id, kmer, kmer_id, start, start + 18 AS \"end\" FROM w JOIN dk USING (kmer)")
def kmer_ordering(s, d):
    o = kmers.kmer_ordering(rel.reads(s, d), 18)
    return o.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(f"""WITH {READS}, {SATC}, a0 AS (SELECT DISTINCT anchor FROM sa), aa AS (SELECT anchor FROM a0 UNION SELECT {RC.format('anchor')} FROM a0), ks AS (SELECT DISTINCT length(anchor) AS k FROM a0),
    b AS (SELECT record_id, seq AS s, false AS rc FROM reads UNION ALL SELECT record_id, {RC.format('seq')}, true FROM reads),
    w AS (SELECT record_id, rc, substr(s, CAST(i + 1 AS BIGINT), k) AS anchor, substr(s, CAST(i + k + 1 AS BIGINT), 5) AS target FROM b, ks, unnest(range(0, length(s) - k)) AS u(i))
    SELECT record_id, anchor, target, rc AS reverse_complement FROM w JOIN aa USING (anchor)""")
def anchor_hits(s, d):
    listed = cut(rel.satc(s, d).select("anchor").distinct().withColumn("ord", F.lit(0).cast("long")))
    lengths = [x["k"] for x in listed.select(F.length("anchor").alias("k")).distinct().collect()]
    scans = [kmers.anchor_hits(rel.reads(s, d), listed.where(F.length("anchor") == k), 5, k) for k in sorted(lengths)]
    return reduce(DataFrame.union, scans or [kmers.anchor_hits(rel.reads(s, d), listed, 5)])


@query(f"WITH {READS} SELECT record_id, {protein('seq')} AS f1, {protein('(substr(seq, 2) || chr(78))')} AS f2, {protein('(substr(seq, 3) || chr(78) || chr(78))')} AS f3 FROM reads")
def translate_frames(s, d):
    return rel.reads(s, d).select("record_id", *[sq.translate(sq.frame("seq", i)).alias(f"f{i + 1}") for i in range(3)])


@query(f"""WITH {READS}, fr AS (SELECT record_id, f + 1 AS frame, substr(seq, CAST(f + 1 AS BIGINT)) || repeat('N', CAST(f AS BIGINT)) AS s FROM reads, unnest(range(3)) AS u(f)
      UNION ALL SELECT record_id, f + 4, substr({RC.format('seq')}, CAST(f + 1 AS BIGINT)) || repeat('N', CAST(f AS BIGINT)) FROM reads, unnest(range(3)) AS u(f)),
    p AS (SELECT record_id, frame, {protein('s')} AS aa FROM fr), q AS (SELECT record_id, frame, {peptide('aa')} AS protein FROM p)
    SELECT record_id, frame, protein FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY -length(protein), frame) AS k FROM q) WHERE k = 1""")
def longest_orf(s, d):
    x = rel.reads(s, d).select("record_id", sq.longest_frame("seq").alias("x"))
    return x.select("record_id", F.col("x.frame").cast("long").alias("frame"), "x.protein")


def _retry(c: str) -> str:
    one, two, three = protein(c), protein(f"(substr({c}, 2) || chr(78))"), protein(f"(substr({c}, 3) || chr(78) || chr(78))")
    return f"CASE WHEN NOT contains({one}, '*') THEN {one} WHEN NOT contains({two}, '*') THEN {two} ELSE {three} END"


@query(f"WITH {SATC} SELECT sample, anchor AS anchor_nt, {_retry('anchor')} AS anchor_aa, {_retry('target')} AS target_aa, count FROM sa")
def translated_satc(s, d):
    return satc.translated(rel.satc(s, d), retry=True)


@query(f"WITH {SATC} SELECT * FROM sa")
def satc_build(s, d):
    return rel.satc(s, d)


@query(f"WITH {SATC} SELECT sample, substr(anchor || target, 1, 27) AS anchor, substr(anchor || target, 28) AS target, count FROM sa")
def satc_from_legacy(s, d):
    lines = rel.satc(s, d).select(F.concat_ws(" ", "count", F.concat("anchor", "target"), "sample").alias("value"))
    return satc.from_legacy(lines, 27)


@query(f"WITH {SATC} SELECT sample, anchor, target, count, target_rank FROM (SELECT *, row_number() OVER (PARTITION BY sample, anchor ORDER BY count DESC, target) AS target_rank FROM sa) WHERE target_rank <= 2")
def top_targets(s, d):
    return satc.top_targets(rel.satc(s, d), 2).withColumn("target_rank", F.col("target_rank").cast("long"))


BEST = "bt AS (SELECT sample, anchor, target FROM (SELECT *, row_number() OVER (PARTITION BY sample, anchor ORDER BY count DESC, target) AS k FROM sa) WHERE k = 1)"


@query(f"WITH {SATC}, {BEST} SELECT * FROM bt")
def argmax_target(s, d):
    return satc.argmax_target(rel.satc(s, d))


GRID = f"{SATC}, {ANCHORS}, {BEST}, sm AS (SELECT DISTINCT sample FROM sa SEMI JOIN al USING (anchor)), g AS (SELECT sm.sample, al.ord, al.anchor, coalesce(bt.target, repeat('N', 27)) AS target FROM sm CROSS JOIN al LEFT JOIN bt ON bt.sample = sm.sample AND bt.anchor = al.anchor)"


@query(f"WITH {GRID} SELECT sample, string_agg(target, '' ORDER BY ord) AS seq FROM g GROUP BY sample")
def featurize(s, d):
    return satc.featurize(rel.satc(s, d), cut(rel.anchor_list(s, d)))


@query(f"WITH {GRID} SELECT sample, string_agg(anchor || target, '' ORDER BY ord) AS seq FROM g GROUP BY sample")
def featurize_with_anchor(s, d):
    return satc.featurize(rel.satc(s, d), cut(rel.anchor_list(s, d)), include_anchor=True)


def _rep(order: str) -> str:
    return f"""WITH {SATC}, {CLUSTERS}, o AS (SELECT anchor, arg_max(cluster_id, ord) AS cluster_id, max(ord) AS ord FROM cl GROUP BY anchor), j AS (SELECT sa.*, o.cluster_id, o.ord FROM sa JOIN o USING (anchor)),
    r AS (SELECT DISTINCT ON (sample, cluster_id) sample, cluster_id, anchor FROM j ORDER BY sample, cluster_id, {order}),
    t AS (SELECT j.*, row_number() OVER (PARTITION BY sample, anchor ORDER BY count DESC, target) AS k FROM j SEMI JOIN r USING (sample, cluster_id, anchor)),
    p AS (SELECT sample, anchor, string_agg(target, '' ORDER BY k) || repeat('N', 27 * (2 - count(*))) AS x FROM t WHERE k <= 2 GROUP BY sample, anchor)
    SELECT sample, string_agg(x, '' ORDER BY anchor) AS seq FROM p GROUP BY sample"""


@query(_rep("anchor"))
def representative_sequence(s, d):
    return satc.representative_sequence(rel.satc(s, d), rel.clusters(s, d), 2)


@query(_rep("ord, anchor"))
def representative_in_order(s, d):
    return satc.representative_sequence(rel.satc(s, d), rel.clusters(s, d), 2, representative="cluster_order")


@query(f"WITH {SATC}, p AS (SELECT anchor, target, sum(count) AS c FROM sa GROUP BY ALL) SELECT anchor, round(max(c) / sum(c), 6) AS effect_size_bin, any_value(n) AS number_nonzero_samples FROM p JOIN (SELECT anchor, count(DISTINCT sample) AS n FROM sa GROUP BY anchor) USING (anchor) GROUP BY anchor")
def anchor_statistics(s, d):
    return satc.anchor_statistics(rel.satc(s, d)).withColumn("effect_size_bin", F.round("effect_size_bin", 6))


@query(f"WITH {SATC}, {ANCHORS}, {LABELS} SELECT ord, anchor AS query, stats FROM al LEFT JOIN lb USING (anchor)")
def sequence_lookup(s, d):
    return anchors.lookup(rel.anchor_list(s, d), rel.labels(s, d))


@query(f"WITH {STATS}, {LABELS} SELECT anchor, effect_size_bin, number_nonzero_samples FROM st ANTI JOIN (SELECT anchor FROM lb WHERE regexp_matches(stats, '(?i)(plas|illum|syn|arp|RF|JUNK|Ral|purge|P,|Univec)')) USING (anchor) WHERE effect_size_bin >= 0.7 ORDER BY number_nonzero_samples DESC, anchor LIMIT 150000")
def select_anchors(s, d):
    a = anchors.select_anchors(table(s, d, "anchor_stats"), rel.labels(s, d))
    return a.withColumn("number_nonzero_samples", F.coalesce("number_nonzero_samples", F.lit(-1)))


RE = f"""{STATS}, {CLUSTERS}, m AS (SELECT DISTINCT cluster_id, anchor FROM cl), j AS (SELECT m.*, effect_size_bin AS e, nullif(number_nonzero_samples, -1) AS n FROM m LEFT JOIN (SELECT * FROM st WHERE effect_size_bin >= 0.7) st USING (anchor)),
    v AS (SELECT cluster_id, round(CASE WHEN count(e) = count(*) THEN avg(e) END * CASE WHEN count(n) = count(*) THEN avg(n) END, 9) AS sv FROM j GROUP BY cluster_id), r AS (SELECT cluster_id, row_number() OVER (ORDER BY sv DESC NULLS LAST, cluster_id) AS nid FROM v),
    ro AS (SELECT nid AS cluster_id, anchor, row_number() OVER (PARTITION BY nid ORDER BY round(e * n, 9) DESC NULLS LAST, anchor) AS place FROM j JOIN r USING (cluster_id))"""


@query(f"WITH {RE} SELECT * FROM ro")
def reorder_clusters(s, d):
    r = anchors.reorder_clusters(rel.clusters(s, d), table(s, d, "anchor_stats"))
    return r.select(F.col("cluster_id").cast("long").alias("cluster_id"), "anchor", F.col("place").cast("long").alias("place"))


@query(f"WITH {RE} SELECT anchor FROM ro WHERE cluster_id <= 4000")
def top_clusters(s, d):
    return anchors.top_clusters(anchors.reorder_clusters(rel.clusters(s, d), table(s, d, "anchor_stats")))


CS = f"""{SATC}, {BEST}, {RE}, li AS (SELECT cluster_id, anchor, place AS ord FROM ro WHERE cluster_id <= 4000), dj AS (SELECT bt.sample, li.cluster_id, arg_min(bt.anchor || bt.target, li.ord) AS x FROM bt JOIN li USING (anchor) GROUP BY ALL),
    df AS (SELECT cluster_id, arg_min(anchor, ord) || repeat('N', 27) AS x FROM li GROUP BY cluster_id)"""


@query(f"WITH {CS} SELECT s.sample, string_agg(coalesce(dj.x, df.x), '' ORDER BY df.cluster_id) AS seq FROM (SELECT DISTINCT sample FROM dj) s CROSS JOIN df LEFT JOIN dj ON dj.sample = s.sample AND dj.cluster_id = df.cluster_id GROUP BY s.sample")
def cluster_sample_sequence(s, d):
    ranked = cut(anchors.reorder_clusters(rel.clusters(s, d), table(s, d, "anchor_stats")).where(F.col("cluster_id") <= anchors.CLUSTERS))
    return satc.cluster_sample_sequence(rel.satc(s, d), ranked.select(F.col("place").alias("ord"), "cluster_id", "anchor"))


def _shifted(s, d):
    """Pieces of the cleaned anchors, eight letters one apart: many overlap by shifts."""
    w = kmers.windows(rel.reads(s, d), 40, 7).select("kmer").distinct()
    return w.select(F.conv(F.substring(F.md5("kmer"), 1, 15), 16, 10).cast("long").alias("id"), F.col("kmer").alias("seq"))


SH = f"{READS}, w AS (SELECT DISTINCT substr(seq, CAST(i + 1 AS BIGINT), 40) AS seq FROM reads, unnest(range(0, length(seq) - 39, 7)) AS u(i)), nd AS (SELECT CAST('0x' || substr(md5(seq), 1, 15) AS BIGINT) AS id, seq FROM w), sl AS (SELECT id, k, substr(seq, CAST(k + 1 AS BIGINT)) AS e, substr(seq, 1, CAST(40 - k AS BIGINT)) AS b FROM nd, unnest(range(1, 8)) AS u(k)), ed AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM sl a JOIN sl b ON a.k = b.k AND a.e = b.b)"


@query(f"WITH {SH} SELECT src, dst FROM ed")
def shift_edges(s, d):
    return cluster.shift_edges(_shifted(s, d), 7)


@query(f"""WITH RECURSIVE {SH}, sy AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), rc(id, low) USING KEY (id) AS (SELECT id, id FROM nd UNION SELECT sy.dst, min(rc.low) FROM rc JOIN sy ON sy.src = rc.id JOIN recurring.rc r ON r.id = sy.dst WHERE rc.low < r.low GROUP BY sy.dst)
    SELECT dense_rank() OVER (ORDER BY -n, low) - 1 AS cluster_id, id FROM (SELECT id, low, count(*) OVER (PARTITION BY low) AS n FROM rc)""")
def shift_clusters(s, d):
    return cluster.shift_clusters(cut(_shifted(s, d)), 7)


def _lev_nodes(s, d):
    return rel.reads(s, d).groupBy("seq").agg(F.min("ord").alias("id"))


@query()  # all pairs in SQL take minutes on the whole table; tests compare a small one by brute force
def lev_pairs(s, d):
    return cluster.lev_pairs(cut(_lev_nodes(s, d))).withColumn("dist", F.col("dist").cast("long"))


@query()
def lev_clusters(s, d):
    return cluster.lev_clusters(cut(_lev_nodes(s, d)))


SEEDS = f"{READS}, nd AS (SELECT seq, min(ord) AS id FROM reads GROUP BY seq), sd AS (SELECT id AS seed_id, seq FROM nd WHERE id % 100 = 0)"


@query(f"WITH {SEEDS} SELECT id, seed_id, dist FROM (SELECT nd.id, sd.seed_id, levenshtein(nd.seq, sd.seq) AS dist FROM nd JOIN sd ON abs(length(nd.seq) - length(sd.seq)) <= 5) WHERE dist <= 5")
def lev_search(s, d):
    """The sequences whose id is divisible by 100 against all, within five edits."""
    n = cut(_lev_nodes(s, d))
    hits = cluster.edit_distance_join(n.select(F.col("id").alias("a"), F.col("seq").alias("sa")), n.where("id % 100 = 0").select(F.col("id").alias("b"), F.col("seq").alias("sb")), 5)
    return hits.select(F.col("a").alias("id"), F.col("b").alias("seed_id"), F.col("dist").cast("long").alias("dist"))


@query()
def lev_sampled(s, d):
    return cluster.sampled_pairs(cut(_lev_nodes(s, d)))


@query(f"WITH {SEEDS} SELECT id, seed_id, dist FROM (SELECT id, seed_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, seed_id) AS k FROM (SELECT nd.id, sd.seed_id, levenshtein(nd.seq, sd.seq) AS dist FROM nd JOIN sd ON abs(length(nd.seq) - length(sd.seq)) < 10) WHERE dist < 10) WHERE k = 1")
def nearest_seed(s, d):
    n = cut(_lev_nodes(s, d))
    return cluster.nearest_seed(n, n.where("id % 100 = 0").select(F.col("id").alias("seed_id"), "seq"), 10).withColumn("dist", F.col("dist").cast("long"))


@query(f"WITH {SEEDS}, {CLUSTERS}, f AS (SELECT cluster_id, min(ord) AS listed FROM cl GROUP BY cluster_id) SELECT id, cluster_id, dist FROM (SELECT sd.seed_id AS id, cl.cluster_id, levenshtein(sd.seq, cl.anchor) AS dist, row_number() OVER (PARTITION BY sd.seed_id ORDER BY levenshtein(sd.seq, cl.anchor), listed) AS k FROM sd JOIN cl ON levenshtein(sd.seq, cl.anchor) <= 10 JOIN f USING (cluster_id)) WHERE k = 1")
def assign_to_clusters(s, d):
    """The sequences whose id is divisible by 100, against every member of every cluster."""
    c = rel.clusters(s, d).withColumnRenamed("anchor", "seq")
    return cluster.assign_to_clusters(cut(_lev_nodes(s, d).where("id % 100 = 0")), c, 10).withColumn("dist", F.col("dist").cast("long"))


@query()
def leader_clusters(s, d):
    """The scan over all sequences, so that each has a leader; the reference ends at 5,000 leaders."""
    return cluster.leader_clusters(cut(_lev_nodes(s, d)), 10)


@query()
def spectral_clusters(s, d):
    """As many clusters as the reference asks for, 5,000, or half the linked sequences if fewer."""
    nodes = cut(_lev_nodes(s, d))
    pairs = cut(cluster.lev_pairs(nodes).select("src", "dst", (F.lit(6.0) - F.col("dist")).alias("weight")))
    linked = pairs.select("src").union(pairs.select("dst")).distinct().count()
    k = max(min(5000, linked // 2), 2)
    found = cut(cluster.spectral_clusters(pairs, k))
    # sequences without an edge are clusters of their own
    alone = with_index(nodes.select("id").join(growing(found), "id", "left_anti"), ["id"], "i")
    return found.select("id", F.col("cluster").cast("long").alias("cluster")).union(alone.select("id", (F.col("i") + k).cast("long").alias("cluster")))


@query()
def profile_clusters(s, d):
    return cluster.profile_clusters(cut(_lev_nodes(s, d)))


@query(f"""WITH {CLUSTERS}, {STATS}, m AS (SELECT DISTINCT cluster_id AS cluster, anchor FROM cl), e AS (SELECT anchor, nullif(effect_size_bin, -1) AS effect_size_bin FROM st)
    SELECT row_number() OVER (ORDER BY cluster, effect_size_bin DESC NULLS LAST, anchor) - 1 AS place, cluster, anchor, effect_size_bin FROM m LEFT JOIN e USING (anchor)""")
def members_by_effect(s, d):
    m = rel.clusters(s, d).select(F.col("cluster_id").alias("cluster"), "anchor").distinct()
    return cluster.ordered_by_effect(m, anchors.one_statistic(table(s, d, "anchor_stats"))).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {LONG} SELECT position, string_agg(kmer, ',' ORDER BY s, kmer) AS kmers FROM (SELECT position, kmer, min(sample_name) AS s FROM ps GROUP BY ALL) GROUP BY position")
def position_kmers(s, d):
    return features.position_kmers(rel.ordering(s, d)).withColumn("position", F.col("position").cast("long"))


VAR = LONG + ", va AS (SELECT position, dim, var_samp(value) AS variance FROM lf GROUP BY ALL)"


@query(f"WITH {VAR} SELECT position, dim, round(variance, 6) AS variance FROM va")
def embedding_variance(s, d):
    v = features.embedding_variance(rel.ordering(s, d), rel.embeddings(s, d))
    return v.select(F.col("position").cast("long").alias("position"), F.col("dim").cast("long").alias("dim"), F.round("variance", 6).alias("variance"))


@query(f"WITH {VAR} SELECT position, dim, feature_rank FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY round(variance, 9) DESC NULLS LAST, dim) AS feature_rank FROM va) WHERE feature_rank <= 10")
def top_variance_features(s, d):
    v = features.top_variance_features(rel.ordering(s, d), rel.embeddings(s, d))
    return v.select(*[F.col(c).cast("long").alias(c) for c in ("position", "dim", "feature_rank")])


@query(f"WITH {VAR}, t AS (SELECT position, dim FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY round(variance, 9) DESC NULLS LAST, dim) AS k FROM va) WHERE k <= 10) SELECT sample_name, 'cluster_' || position || '_embedding_' || dim AS feature, round(value, 6) AS value FROM lf SEMI JOIN t USING (position, dim)")
def selected_features(s, d):
    return features.selected_features(rel.ordering(s, d), rel.embeddings(s, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {LONG} SELECT sample_name, position, dim, round(value, 6) AS value FROM lf WHERE position < 5")
def cluster_embeddings(s, d):
    v = features.first_clusters(rel.ordering(s, d), rel.embeddings(s, d), 5)
    return v.select("sample_name", F.col("position").cast("long").alias("position"), F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query()
def pca_loadings(s, d):
    return features.principal_components(rel.embeddings(s, d), 10)[0]


@query("SELECT metadata, count(*) AS classes FROM (SELECT metadata, class FROM metadata WHERE metadata IS NOT NULL AND class <> '' GROUP BY ALL HAVING count(*) > 30) GROUP BY metadata HAVING count(*) >= 2")
def usable_labels(s, d):
    return splits.usable_labels(rel.metadata(s, d), 30)


@query("SELECT ord, class FROM (SELECT *, count(*) OVER (PARTITION BY class) AS n FROM metadata WHERE class <> '') WHERE n > 30")
def class_filter(s, d):
    return splits.class_filter(rel.metadata(s, d), "class", 30).select("ord", "class")


@query("WITH m AS (SELECT sample_name, last(class ORDER BY ord) AS v FROM metadata WHERE sample_name IS NOT NULL GROUP BY 1) SELECT split_part(sample_name, '_', 1) AS prefix, arg_min(v, ord) AS metadata FROM bed JOIN m USING (sample_name) WHERE v <> '' GROUP BY 1")
def bed_prefix_metadata(s, d):
    return splits.prefix_metadata(rel.bed(s, d), rel.metadata(s, d))


def _u(key: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '#42'), 1, 8) AS BIGINT) / 4294967296.0"


BERN = "CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END"


@query(f"SELECT ord, {BERN} AS split FROM (SELECT ord, {_u('ord')} AS u FROM bed)")
def bernoulli_split(s, d):
    return splits.bernoulli_split(rel.bed(s, d), "ord").select("ord", "split")


SHARES = "CASE WHEN k <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END"


@query(f"WITH p AS (SELECT prefix, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(prefix || '#42'), prefix) AS k FROM (SELECT DISTINCT split_part(sample_name, '_', 1) AS prefix FROM bed WHERE sample_name IS NOT NULL)) SELECT ord, {SHARES} AS split FROM bed JOIN p ON prefix = split_part(sample_name, '_', 1)")
def prefix_split(s, d):
    return splits.prefix_split(rel.bed(s, d), "sample_name").select("ord", "split")


PREFIX_META = "WITH m AS (SELECT sample_name, last(class ORDER BY ord) AS v FROM metadata WHERE sample_name IS NOT NULL GROUP BY 1), pm AS (SELECT split_part(sample_name, '_', 1) AS prefix, arg_min(v, ord) AS metadata FROM bed JOIN m USING (sample_name) WHERE v <> '' GROUP BY 1)"


@query(f"{PREFIX_META}, p AS (SELECT prefix, count(*) OVER (PARTITION BY metadata) AS n, row_number() OVER (PARTITION BY metadata ORDER BY md5(prefix || '#42'), prefix) AS k FROM pm) SELECT ord, {SHARES} AS split FROM bed JOIN p ON prefix = split_part(sample_name, '_', 1)")
def prefix_stratified_split(s, d):
    return splits.prefix_stratified_split(rel.bed(s, d), "sample_name", splits.prefix_metadata(rel.bed(s, d), rel.metadata(s, d))).select("ord", "split")


@query("""WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM metadata WHERE metadata IS NOT NULL GROUP BY metadata)),
    x AS (SELECT ord, count(*) OVER (PARTITION BY metadata) AS n, row_number() OVER (PARTITION BY metadata ORDER BY md5(ord || '#42'), ord) AS k, floor(m * 0.7 + 1e-9) AS f FROM metadata, m WHERE metadata IS NOT NULL)
    SELECT ord, CASE WHEN k <= f THEN 'train' WHEN k <= f + floor((n - f) * 0.5 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM x""")
def balanced_three_way_split(s, d):
    return splits.balanced_three_way_split(rel.metadata(s, d), "ord", "metadata").select("ord", "split")


@query("""SELECT ord, CASE WHEN k <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN k <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT ord, count(*) OVER (PARTITION BY metadata) AS n, row_number() OVER (PARTITION BY metadata ORDER BY md5(ord || '#42'), ord) AS k FROM metadata)""")
def stratified_split(s, d):
    return splits.stratified_split(rel.metadata(s, d), "ord", "metadata").select("ord", "split")


@query("""WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM metadata WHERE metadata IS NOT NULL GROUP BY metadata)) SELECT ord, CASE WHEN k <= floor(m * 0.5 + 1e-9) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT ord, row_number() OVER (PARTITION BY metadata ORDER BY md5(ord || '#42'), ord) AS k FROM metadata WHERE metadata IS NOT NULL), m WHERE k <= m""")
def balanced_split(s, d):
    return splits.balanced_split(rel.metadata(s, d), "ord", "metadata", even=True).select("ord", "split")


@query(f"SELECT ord, copy FROM (SELECT ord, {BERN} AS split FROM (SELECT ord, {_u('ord')} AS u FROM bed)), unnest(range(1, CASE WHEN split = 'train' THEN 4 ELSE 2 END)) AS x(copy)")
def replicate_train(s, d):
    r = splits.replicate_train(splits.bernoulli_split(rel.bed(s, d), "ord"), 3)
    return r.select("ord", F.col("copy").cast("long").alias("copy"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[a-z.]+@([a-z]+)', 1)) AS url FROM documents")
def urls(s, d):
    return tables.urls_of(table(s, d, "documents").select("doc_id", "text"), "text", "[a-z.]+@([a-z]+)")


@query("SELECT time_bucket(INTERVAL '30 days', counted_at, TIMESTAMP '1970-01-01') AS start, sample, " + CLEAN.format("anchor") + " AS anchor, CAST(sum(count) AS BIGINT) AS total FROM satc WHERE sample IS NOT NULL AND count IS NOT NULL AND " + CLEAN.format("anchor") + " <> '' AND counted_at IS NOT NULL GROUP BY ALL")
def windowed_counts_batch(s, d):
    return windowed_counts(table(s, d, "satc"))


@query(f"WITH {READS} SELECT record_id, seq FROM reads")
def fasta_roundtrip(s, d):
    path = new_path(s, "fasta")
    fasta.write_fasta(rel.reads(s, d), path, 60)
    return fasta.read_fasta(s, path).select("record_id", "seq")


@query(f"WITH {READS} SELECT 'seq_' || (row_number() OVER (ORDER BY ord) - 1) AS record_id, seq FROM reads")
def enumerate_rows(s, d):
    return with_index(rel.reads(s, d).select("ord", "seq"), ["ord"], "i").select(F.concat(F.lit("seq_"), F.col("i").cast("string")).alias("record_id"), "seq")


@query("SELECT a.c_custkey AS id, min(b.c_custkey) AS component FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY 1")
def components(s, d):
    c = table(s, d, "customer")
    hub = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("hub"))
    return connected_components(c.join(hub, "c_nationkey").select(F.col("c_custkey").alias("src"), F.col("hub").alias("dst")))


def _labelled(s, d):
    return rel.embeddings(s, d).select(F.col("kmer").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


@query()
def lasso_coefficients(s, d):
    data = splits.balanced_split(_labelled(s, d), "id", "label", 0.8)
    m, classes, _ = model.fit_lasso(data.where("split = 'train'"), "id", "features", "label")
    return model.nonzero(model.coefficients(s, m, classes, [f"embedding_{i + 1}" for i in range(m.numFeatures)]))


@query()
def lasso_scores(s, d):
    data = splits.balanced_split(_labelled(s, d), "id", "label", 0.8)
    d1, classes = model.labelled(data, "features", "label")
    m, _, _ = model.fit_lasso(data.where("split = 'train'"), "id", "features", "label")
    return model.scores(model.confusion(m.transform(d1.where("split = 'test'"))))


PREDICTED = "pr AS (SELECT CAST(label AS VARCHAR) AS t, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS g FROM embeddings WHERE label IS NOT NULL), cm AS (SELECT t AS true_class, g AS predicted_class, count(*) AS n FROM pr GROUP BY ALL)"


def _predicted(s, d):
    """A guess for each vector that is wrong for every third."""
    guess = F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(s, d, "embeddings").where("label is not null").select(F.col("label").cast("string").alias("t"), guess.cast("string").alias("g"))


@query(f"WITH {PREDICTED} SELECT * FROM cm")
def confusion_counts(s, d):
    return model.confusion(_predicted(s, d), "t", "g")


@query(f"""WITH {PREDICTED}, a AS (SELECT sum(n) AS every, sum(n) FILTER (true_class = predicted_class) AS hit FROM cm), t AS (SELECT true_class AS class, sum(n) AS p, coalesce(sum(n) FILTER (true_class = predicted_class), 0) AS tp FROM cm GROUP BY 1), g AS (SELECT predicted_class AS class, sum(n) AS g FROM cm GROUP BY 1)
    SELECT class, round(tp / p, 6) AS sensitivity, round(1 - (coalesce(g, 0) - tp) / (every - p), 6) AS specificity, round(hit / every, 6) AS accuracy FROM t LEFT JOIN g USING (class), a""")
def confusion_scores(s, d):
    x = model.scores(model.confusion(_predicted(s, d), "t", "g"))
    return x.select("class", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "accuracy")])


def _composition(s, d):
    """``(sample_name, feature, value)``: how often each three-letter word stands in the targets of
    a sample, weighted by count, on a logarithmic scale."""
    t = rel.satc(s, d).select(F.col("sample").alias("sample_name"), "count", F.col("target").alias("seq"))
    w = kmers.windows(t, 3).groupBy("sample_name", F.col("kmer").alias("feature")).agg(F.sum("count").alias("n"))
    return w.select("sample_name", "feature", F.log1p("n").alias("value"))


LS = f"""{SATC}, m AS (SELECT sample_name, metadata AS label, arg_max(coalesce(class, ''), ord) AS class FROM metadata WHERE sample_name IS NOT NULL AND metadata IS NOT NULL GROUP BY ALL),
    nw AS (SELECT * FROM m WHERE class <> '' AND sample_name IN (SELECT sample FROM sa WHERE length(target) >= 3)), sz AS (SELECT label, class, count(*) AS n FROM nw GROUP BY ALL HAVING count(*) > 30),
    pl AS (SELECT label, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS classes, min(n) AS least FROM sz GROUP BY label),
    st AS (SELECT *, CASE WHEN n_rows < 90 THEN 'too few rows' WHEN classes < 2 THEN 'too few classes' WHEN classes > 200 THEN 'too many classes' ELSE 'ready' END AS status FROM pl)"""


@query(f"WITH {LS} SELECT label, status, n_rows, classes FROM st")
def label_status(s, d):
    return model.label_samples(_composition(s, d), rel.metadata(s, d))[1]


@query(f"WITH {LS} SELECT label, sample_name, class, CASE WHEN k <= floor(least * 0.5 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM (SELECT nw.*, least, row_number() OVER (PARTITION BY nw.label, nw.class ORDER BY md5(nw.sample_name || '#42'), nw.sample_name) AS k FROM nw JOIN sz USING (label, class) JOIN st ON st.label = nw.label AND st.status = 'ready')")
def label_samples(s, d):
    return model.label_samples(_composition(s, d), rel.metadata(s, d))[0]


@query()
def label_models(s, d):
    """The loop over all usable labels, with the coefficients of each."""
    return model.fit_labels(_composition(s, d), rel.metadata(s, d)).whole().coefficients


@query()
def grouped_lasso(s, d):
    lab = table(s, d, "embeddings").select(F.concat(F.lit("s"), (F.col("vec_id") % 50).cast("string")).alias("sample_name"), "label")
    lab = lab.groupBy("sample_name").agg((F.max_by("label", F.col("label")) % 2).cast("string").alias("label"))
    return model.grouped_lasso(cut(features.long_features(rel.ordering(s, d), rel.embeddings(s, d))), lab)


@query()
def grouped_two_stage(s, d):
    """Words of three letters as positions, their counts in four parts of a sample's targets as
    dimensions: the first stage at each word, the second on what it keeps."""
    t = rel.satc(s, d).select(F.col("sample").alias("sample_name"), "count", "target", F.col("target").alias("seq"))
    w = kmers.windows(t, 3).where(~F.contains("kmer", F.lit("N"))).groupBy("sample_name", "kmer", (F.pmod(F.xxhash64("target"), F.lit(4)) + 1).alias("dim")).agg(F.sum("count").alias("n"))
    position = sum((F.instr(F.lit("ACGT"), F.substring("kmer", i + 1, 1)) - 1) * 4**i for i in range(3))
    long = w.select("sample_name", position.cast("long").alias("position"), "dim", F.log1p("n").alias("value"))
    return model.grouped_two_stage(long, rel.metadata(s, d)).whole().coefficients


@query(f"WITH {LONG}, nm AS (SELECT DISTINCT 'cluster_' || position || '_embedding_' || dim AS feature, position AS p, dim AS e FROM lf), k AS (SELECT position, string_agg(kmer, ',' ORDER BY s, kmer) AS kmers FROM (SELECT position, kmer, min(sample_name) AS s FROM ps GROUP BY ALL) GROUP BY position) SELECT feature, p AS position, e AS dim, kmers FROM nm LEFT JOIN k ON k.position = p")
def annotated_features(s, d):
    long = features.selected_features(rel.ordering(s, d), rel.embeddings(s, d), 1 << 30)
    a = features.annotated(long.select("feature").distinct(), rel.ordering(s, d))
    return a.select("feature", *[F.col(c).cast("long").alias(c) for c in ("position", "dim")], "kmers")


@query()
def pc_features(s, d):
    return features.prefixed_components(rel.ordering(s, d), features.principal_components(rel.embeddings(s, d), 10)[0])


@query()
def embedding_pipeline(s, d):
    """The pipeline at its defaults, each feature described over all samples: the values themselves
    are samples times features, 76 million rows at the smallest bench size."""
    f = pipeline.described(rel.satc(s, d), table(s, d, "anchor_stats"), rel.labels(s, d))
    return f.select("feature", "samples", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query()
def text_sources(s, d):
    """SATC, cluster and BED tables written as tab-separated text and read again."""
    path = new_path(s, "tsv")
    tables.write_tsv(rel.satc(s, d), path)
    return tables.read_satc(s, path)


ORACLE["text_sources"] = ORACLE["satc_build"]


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, record_id, seq FROM reads")
def sequence_table_file(s, d):
    path = new_path(s, "tsv")
    tables.write_tsv(rel.reads(s, d).orderBy("ord").select("record_id", "seq"), path)
    return tables.read_sequence_table(s, path).select(F.col("ord").cast("long").alias("ord"), "record_id", "seq")


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, seq AS anchor FROM reads")
def anchor_list_file(s, d):
    path = new_path(s, "txt")
    rel.reads(s, d).orderBy("ord").select("seq").write.text(path)
    return tables.read_anchor_list(s, path).select(F.col("ord").cast("long").alias("ord"), "anchor")


def _cluster_file(s, d):
    path = new_path(s, "tsv")
    tables.write_tsv(rel.clusters(s, d).orderBy("ord").select("cluster_id", "anchor"), path)
    return tables.read_clusters(s, path)


@query(f"WITH {CLUSTERS} SELECT anchor, arg_max(cluster_id, ord) AS cluster_id FROM cl GROUP BY anchor")
def cluster_of_anchor_file(s, d):
    return tables.cluster_of_anchor(_cluster_file(s, d))


@query(f"WITH {CLUSTERS} SELECT cluster_id, md5(string_agg(anchor, ',' ORDER BY ord)) AS anchors FROM cl GROUP BY cluster_id")
def anchors_of_cluster_file(s, d):
    return tables.anchors_of_cluster(_cluster_file(s, d)).select("cluster_id", F.md5(F.array_join("anchors", ",")).alias("anchors"))


@query(f"WITH {CLUSTERS} SELECT cluster_id, anchor, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) AS place FROM cl")
def ranked_members_file(s, d):
    return tables.ranked_members(_cluster_file(s, d)).select("cluster_id", "anchor", F.col("place").cast("long").alias("place"))


@query("SELECT anchor, effect_size_bin, coalesce(number_nonzero_samples, -1) AS number_nonzero_samples FROM anchor_stats WHERE effect_size_bin >= 0.7 AND anchor IS NOT NULL")
def stats_file(s, d):
    path = new_path(s, "tsv")
    tables.write_tsv(table(s, d, "anchor_stats").where("anchor is not null"), path, header=True)
    return tables.read_stats(s, path, 0.7).withColumn("number_nonzero_samples", F.coalesce("number_nonzero_samples", F.lit(-1)))


@query("SELECT CAST(vec_id AS VARCHAR) AS kmer, CAST(len(embedding) AS BIGINT) AS dims, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[-1]::DOUBLE, 5) AS last FROM embeddings")
def embeddings_file(s, d):
    path = new_path(s, "tsv")
    e = rel.embeddings(s, d)
    e.select(F.concat_ws("\t", F.col("kmer").cast("string"), F.col("embedding").cast("array<double>").cast("array<string>"))).write.text(path)
    e = tables.read_embeddings(s, path)
    return e.select("kmer", F.size("embedding").cast("long").alias("dims"), F.round(F.element_at("embedding", 1), 5).alias("first"), F.round(F.element_at("embedding", -1), 5).alias("last"))


@query(f"WITH {ORDERING} SELECT sample_name, CAST(kmer AS VARCHAR) AS kmer, start FROM od")
def ordering_file(s, d):
    path = new_path(s, "tsv")
    o = rel.ordering(s, d).select("sample_name", F.lit("ACGT").alias("seq"), "kmer", "start", (F.col("start") + 27).alias("end"))
    tables.write_tsv(o, path)
    return tables.read_ordering(s, path)


@query("SELECT sample_name, metadata, class FROM (SELECT sample_name, metadata, nullif(class, '') AS class FROM metadata WHERE sample_name <> '' AND metadata <> '')")
def metadata_file(s, d):
    """The key column goes by another name in the file."""
    path = new_path(s, "tsv")
    m = rel.metadata(s, d).where("sample_name <> '' and metadata <> ''").select(F.col("sample_name").alias("Run"), "metadata", "class")
    tables.write_tsv(m, path, header=True)
    return tables.read_metadata(s, path)


@query("SELECT sample_name, start, coalesce(stop, -1) AS stop FROM bed WHERE sample_name <> '' AND sample_name = trim(sample_name)")
def bed_file(s, d):
    path = new_path(s, "bed")
    tables.write_tsv(rel.bed(s, d).where("sample_name <> '' and sample_name = trim(sample_name)").select("sample_name", "start", "stop"), path)
    return tables.read_bed(s, path).withColumn("stop", F.coalesce("stop", F.lit(-1)))


@query(f"WITH {LONG} SELECT sample_name, 'cluster_' || position || '_embedding_' || dim AS feature, value FROM lf WHERE position < 5")
def matrix_file(s, d):
    path = new_path(s, "matrix")
    long = features.first_clusters(rel.ordering(s, d), rel.embeddings(s, d), 5)
    name = F.concat(F.lit("cluster_"), F.col("position"), F.lit("_embedding_"), F.col("dim"))
    tables.write_matrix(long.select("sample_name", name.alias("feature"), "value"), path)
    return tables.read_matrix(s, path)


@query(f"WITH {READS} SELECT 'seq_' || (row_number() OVER (ORDER BY ord) - 1) AS record_id, seq FROM reads")
def plain_sequences_file(s, d):
    path = new_path(s, "txt")
    rel.reads(s, d).orderBy("ord").select("seq").write.text(path)
    return tables.read_plain_sequences(s, path)


@query(f"WITH {READS} SELECT record_id, seq, repeat('I', CAST(length(seq) AS BIGINT)) AS quality FROM reads")
def fastq_file(s, d):
    path = new_path(s, "fastq")
    r = rel.reads(s, d)
    r.select(F.concat(F.lit("@"), "record_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))).write.text(path)
    return fasta.read_fastq(s, path).select("record_id", "seq", "quality")

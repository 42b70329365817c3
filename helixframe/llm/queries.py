"""Queries of the eight training-data problems and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import clusters, leakage, neardup, pii, sampling, splits, tokenizer, topn
from helixframe.runtime import growing, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "anchor_clusters"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "anchor_clusters"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.conflicts(table(spark, d, "bed"), table(spark, d, "split_targets")).select("donor")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "bed"), table(spark, d, "split_targets"))


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each split, and its rows whose donor lies in another split too."""
    bed = table(spark, d, "bed").select("ord", splits.donor_of(F.col("sample_name")).alias("donor"))
    s = splits.assign_splits(table(spark, d, "bed"), table(spark, d, "split_targets")).join(growing(bed), "ord")
    torn = s.groupBy("donor").agg(F.count_distinct("split").alias("k")).where("donor is not null and k > 1").select("donor")
    torn = s.join(growing(torn), "donor", "left_semi").groupBy("split").agg(F.count("*").alias("torn"))
    return s.groupBy("split").agg(F.count("*").alias("n_rows")).join(torn, "split", "left").select("split", "n_rows", F.coalesce("torn", F.lit(0)).alias("torn"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "anchor_clusters"), "cluster_id", "rank", "ord", 5).select("cluster_id", "ord")


def p3_top_samples(spark: SparkSession, d: str) -> DataFrame:
    """The five targets counted most often for each anchor of satc, its hot anchor included."""
    satc = table(spark, d, "satc").where("target is not null").groupBy("anchor", "target").agg(F.sum("count").alias("total"))
    best = topn.top_n(satc.withColumn("score", -F.col("total")), "anchor", "score", "target", 5)
    return best.select("anchor", "target", (-F.col("score")).cast("long").alias("total"), F.col("position").cast("long").alias("position"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shortages(table(spark, d, "metadata"), table(spark, d, "class_targets")).select("metadata", "class")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "metadata"), table(spark, d, "class_targets"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "metadata"), table(spark, d, "class_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.linked_groups(table(spark, d, "anchor_clusters"))


def p5_communities(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_communities(table(spark, d, "anchor_clusters"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decode(tokenizer.encode(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leakage.proximity_matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(table(spark, d, "documents")).select("doc_id", "kind", "begin_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_splits, p2_balance, p3_found, p3_top_samples, p4_found, p4_sample, p4_report, p5_found, p5_communities, p6_ids, p6_decoded, p7_found, p7_proximity, p8_found, p8_redacted)
}

ORACLE: dict[str, str] = {
    "p2_found": r"""
        WITH b AS (SELECT regexp_extract(trim(sample_name), '^([A-Za-z]+)[^A-Za-z0-9]?([0-9]+)', ['l', 'n']) AS x, lower(trim(split)) AS s FROM bed WHERE sample_name IS NOT NULL),
        c AS (SELECT upper(x.l) || ltrim(x.n, '0') AS donor,
                     CASE WHEN s IN ('train', 'training', 'trn') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'dev', 'development') THEN 'val'
                          WHEN s IN ('test', 'testing', 'tst') THEN 'test' END AS named FROM b WHERE x.n <> '')
        SELECT donor FROM c GROUP BY donor HAVING count(DISTINCT named) >= 2""",
    "p2_balance": """
        WITH t AS (SELECT split, CAST(floor(share * (SELECT count(*) FROM bed) + 0.5) AS BIGINT) AS n, row_number() OVER (ORDER BY share DESC, split DESC) AS k FROM split_targets)
        SELECT split, CAST(CASE WHEN k = 1 THEN (SELECT count(*) FROM bed) - (SELECT sum(n) FROM t WHERE k > 1) ELSE n END AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS torn FROM t""",
    "p3_found": """
        SELECT cluster_id, ord FROM (
            SELECT cluster_id, ord, row_number() OVER (PARTITION BY cluster_id ORDER BY rank, ord) AS k
            FROM anchor_clusters WHERE cluster_id IS NOT NULL AND rank IS NOT NULL) WHERE k <= 5""",
    "p3_top_samples": """
        SELECT anchor, target, CAST(total AS BIGINT) AS total, position FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY total DESC, target) AS position FROM (
                SELECT anchor, target, sum(count) AS total FROM satc WHERE target IS NOT NULL AND anchor IS NOT NULL GROUP BY anchor, target HAVING sum(count) IS NOT NULL))
        WHERE position <= 5""",
    "p4_found": r"""
        WITH m AS (SELECT sample_name, metadata, arg_max(coalesce(class, ''), ord) AS class FROM metadata WHERE sample_name IS NOT NULL AND metadata IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT metadata, lower(trim(regexp_replace(class, '[\s_-]+', ' ', 'g'))) AS key, count(*) AS n FROM m GROUP BY 1, 2)
        SELECT t.metadata, t.class FROM class_targets t LEFT JOIN k ON k.metadata = t.metadata AND k.key = lower(t.class)
        WHERE coalesce(k.n, 0) < greatest(round(t.target_share * t.sample_size), t.min_rows)""",
    "p4_report": r"""
        WITH m AS (SELECT sample_name, metadata, arg_max(coalesce(class, ''), ord) AS class FROM metadata WHERE sample_name IS NOT NULL AND metadata IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT metadata, lower(trim(regexp_replace(class, '[\s_-]+', ' ', 'g'))) AS key, count(*) AS n FROM m GROUP BY 1, 2),
        t AS (SELECT t.*, CAST(greatest(round(round(t.target_share * t.sample_size, 6)), t.min_rows) AS BIGINT) AS wanted, coalesce(k.n, 0) AS available
              FROM class_targets t LEFT JOIN k ON k.metadata = t.metadata AND k.key = lower(trim(regexp_replace(t.class, '[\s_-]+', ' ', 'g')))),
        o AS (SELECT metadata, class, sample_size, i, CASE WHEN i <= min_rows THEN -1 WHEN target_share > 0 THEN (i - 0.5::DOUBLE) / target_share END AS p FROM t, unnest(range(1, available + 1)) AS u(i)),
        d AS (SELECT metadata, class, count(*) AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY metadata ORDER BY p, class, i) AS r FROM o WHERE p IS NOT NULL) WHERE r <= sample_size GROUP BY 1, 2)
        SELECT metadata, class, wanted, available, coalesce(drawn, 0) AS drawn, greatest(wanted - coalesce(drawn, 0), 0) AS missing FROM t LEFT JOIN d USING (metadata, class)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

"""The model half: splits, label loop, two-stage lasso, annotation, against hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import queries
from helixframe.operators import crossval, features, model, splits


@pytest.fixture(scope="module")
def labelled(spark):
    """Features a and b tell the classes of label m apart, c is noise; label few has few rows."""
    r = random.Random(1)
    rows, meta = [], []
    for i in range(240):
        c = "xyz"[i % 3]
        for f, v in (("a", (c == "x") * 2.0), ("b", (c == "y") * 2.0), ("c", 0.0)):
            rows.append((f"s{i}", f, v + r.gauss(0, 0.2)))
        meta += [(2 * i, f"s{i}", "m", c), (2 * i + 1, f"s{i}", "few", c if i < 60 else "")]
    meta += [(1000 + i, f"other{i}", "m", "x") for i in range(50)] + [(2000, None, "m", "x"), (2001, "s0", None, "x"), (2002, "s1", "one", "w")]
    return spark.createDataFrame(rows, "sample_name string, feature string, value double"), spark.createDataFrame(meta, "ord long, sample_name string, metadata string, class string")


def test_label_samples(spark, labelled):
    long, meta = labelled
    d, status = model.label_samples(long, meta, minimum=10)
    assert {tuple(x) for x in status.collect()} == {("m", "ready", 240, 3), ("few", "too few rows", 60, 3)}
    n = {(x["class"], x["split"]): x["count"] for x in d.groupBy("class", "split").count().collect()}
    assert n == {(c, s): 40 for c in "xyz" for s in ("train", "test")}
    assert {x["status"] for x in model.label_samples(long, meta, minimum=10, max_classes=2)[1].collect()} == {"too many classes", "too few rows"}
    assert model.label_samples(long.where("false"), meta)[0].count() == 0


def test_fit_labels(spark, labelled):
    long, meta = labelled
    got = model.fit_labels(long, meta, samples={"minimum": 10}, penalties=3, folds=2)
    assert {(x["label"], x["status"]) for x in got.labels.collect()} == {("m", "fitted"), ("few", "too few rows")}
    assert all(x["accuracy"] > 0.95 for x in got.scores.collect()) and got.scores.count() == 3
    assert sum(x["n"] for x in got.confusion.collect()) == 120
    assert {"Intercept", "a", "b"} <= {x["feature"] for x in got.coefficients.collect()}
    none = model.fit_labels(long, meta, samples={"rows": 10_000})
    assert none.coefficients.count() == none.scores.count() == 0


def test_failed_fits_are_skipped(spark, labelled, monkeypatch):
    long, meta = labelled
    tries = []
    monkeypatch.setattr(model, "fit_lasso", lambda *a, **k: tries.append(1) or 1 / 0)
    got = model.fit_labels(long, meta, samples={"minimum": 10})
    assert len(tries) == 2 and "no fit" in {x["status"] for x in got.labels.collect()}


def test_two_stages(spark, labelled):
    _, meta = labelled
    r, rows = random.Random(2), []
    for i in range(240):
        for p in (1, 2):
            for dim in (1, 2, 3):
                told = {(1, 1): "x", (2, 3): "y"}.get((p, dim)) == "xyz"[i % 3]
                rows.append((f"s{i}", p, dim, told * 2.0 + r.gauss(0, 0.2)))
    ordered = spark.createDataFrame(rows, "sample_name string, position long, dim int, value double")
    kept = {tuple(x) for x in model.grouped_lasso(ordered, meta.where("metadata = 'm'").selectExpr("sample_name", "class as label")).collect()}
    assert {(1, 1), (2, 3)} <= kept
    got = model.grouped_two_stage(ordered, meta, samples={"minimum": 10}, penalties=3, folds=2)
    named = {x["feature"] for x in got.coefficients.where("coefficient <> 0").collect()}
    assert {"cluster_1_embedding_1", "cluster_2_embedding_3"} <= named
    assert all(x["accuracy"] > 0.9 for x in got.scores.collect())
    o = spark.createDataFrame([("s0", "k1", 0), ("s0", "k2", 1), ("s1", "k3", 0)], "sample_name string, kmer string, start int")
    a = {x["feature"]: x["kmers"] for x in features.annotated(spark.createDataFrame([("cluster_0_embedding_1",), ("Intercept",)], "feature string"), o).collect()}
    assert a == {"cluster_0_embedding_1": "k1,k3", "Intercept": None}


def test_penalty_path(spark, labelled):
    long, meta = labelled
    d, _ = model.labelled(features.vectors(long).join(meta.where("metadata = 'm'"), "sample_name"), "features", "class")
    path, _ = model.penalty_path(d, 4)
    assert path == sorted(path, reverse=True) and abs(path[-1] / path[0] - 0.01) < 1e-9
    assert not model._lasso(path[0] * 1.01, 50).fit(d).coefficientMatrix.toArray().any()
    assert model._lasso(path[0] * 0.8, 50).fit(d).coefficientMatrix.toArray().any()


def test_joint_folds_agree_with_single_fits(spark, labelled):
    long, meta = labelled
    long = long.withColumn("value", long["value"] + F.xxhash64("sample_name", "feature") % 100 / 60)  # not all rows can be right
    d, _ = model.labelled(features.vectors(long).join(meta.where("metadata = 'm'"), "sample_name"), "features", "class")
    d = d.withColumn("fold", F.pmod(F.xxhash64("sample_name"), F.lit(2)).cast("int")).persist()
    path, every = model.penalty_path(d, 4)
    sizes = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}
    rows = d.select(F.col("features").alias("x"), "y", "fold").repartition(3)
    args = (every["mean"].toArray(), every["std"].toArray(), 3, path, sizes)
    hits = crossval.right_of_path(rows, *args)
    single = [sum(model._lasso(p, 50).fit(d.where(F.col("fold") != f)).transform(d.where(F.col("fold") == f)).where("prediction = y").count() for f in sizes) for p in path]
    assert all(abs(a - b) <= 6 for a, b in zip(hits, single, strict=True)) and max(hits) > min(hits)
    kept = crossval.TOGETHER, crossval.FAN_IN, crossval.BLOCK
    args = (*args[:3], path[:2], sizes)
    try:  # penalties one after the other, sums added up in tasks, one row a block
        crossval.TOGETHER, crossval.FAN_IN, crossval.BLOCK = 1, 1, 1
        apart = crossval.right_of_path(rows, *args, steps=6)
    finally:
        crossval.TOGETHER, crossval.FAN_IN, crossval.BLOCK = kept
    assert len(apart) == 2 and apart[0] == hits[0] and abs(apart[1] - single[1]) <= 24


def test_split_modes(spark):
    d = spark.createDataFrame([(i, f"p{i % 20}_x{i}", "ab"[i % 2], "old") for i in range(200)], "id long, name string, c string, split string")
    n = {x["split"]: x["n"] for x in splits.prefix_split(d, "name").select("prefix", "split").distinct().groupBy("split").count().withColumnRenamed("count", "n").collect()}
    assert n == {"train": 14, "val": 3, "test": 3}
    m = d.selectExpr("split_part(name, '_', 1) as prefix", "c as metadata").distinct()
    n = {(x["c"], x["split"]): x["count"] for x in splits.prefix_stratified_split(d, "name", m).select("prefix", "c", "split").distinct().groupBy("c", "split").count().collect()}
    assert n == {(c, s): k for c in "ab" for s, k in (("train", 7), ("val", 1), ("test", 2))}
    e = d.where("c = 'a' or id < 40")  # 100 of a, 20 of b
    n = {(x["c"], x["split"]): x["count"] for x in splits.balanced_three_way_split(e, "id", "c").groupBy("c", "split").count().collect()}
    assert n == {("a", "train"): 14, ("b", "train"): 14, ("a", "val"): 43, ("a", "test"): 43, ("b", "val"): 3, ("b", "test"): 3}


def test_first_stage_ends_at_the_lasso(spark, labelled):
    """Newton steps end where the slopes balance the penalty; grouped once, the first stage keeps the same."""
    r = np.random.default_rng(3)
    y = np.repeat(np.arange(30), 20 * np.r_[1:31])[:9000]
    x = np.hstack([r.normal(size=(len(y), 3)) + 0.1 * y[:, None] * np.array([1, 0, 0]), np.ones((len(y), 1))])
    x[:, :3] = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    a = model._newton(x, y, 0.004, np.zeros((4, y.max() + 1)), 80)
    _, slope, _ = model._slopes(x, y, a)
    kept = a[:-1] != 0
    assert np.abs(slope[-1]).max() < 1e-4 and np.abs(slope[:-1]).max() < 0.004 + 1e-4
    assert kept[0].any() and not kept.all() and np.abs(slope[:-1] + 0.004 * np.sign(a[:-1]))[kept].max() < 1e-4
    rows = [(f"s{i}", p, d, float((i % 2 and p == d) + r.normal() * 0.3)) for i in range(90) for p in (1, 2) for d in (1, 2, 3)]
    long = spark.createDataFrame(rows, "sample_name string, position long, dim int, value double")
    lab = spark.createDataFrame([(f"s{i}", "ab"[i % 2]) for i in range(90)], "sample_name string, label string")
    one, two = (sorted(map(tuple, model.grouped_lasso(x, lab, penalties=4).collect())) for x in (long, model.by_position(long)))
    assert one == two and {(1, 1), (2, 2)} <= set(one)


def test_failed_fits_are_no_result(spark, tmp_path, monkeypatch):
    """A query of which one label could not be fitted says so, in place of the other labels' rows."""
    r = random.Random(4)
    rows = [(f"s{i}", "A" * 27, "".join(r.choice(("AC", "GT")[i % 2]) for _ in range(27)), 3, None, None) for i in range(120)]
    spark.createDataFrame(rows, "sample string, anchor string, target string, count long, counted_at timestamp, loaded_at timestamp").write.parquet(f"{tmp_path}/satc.parquet")
    meta = [(k, f"s{i}", m, "ab"[(i + (i % 10 == 0)) % 2]) for i in range(120) for k, m in ((2 * i, "m"), (2 * i + 1, "n"))]
    spark.createDataFrame(meta, "ord long, sample_name string, metadata string, class string").write.parquet(f"{tmp_path}/metadata.parquet")
    fit, tries = model.fit_lasso, []
    monkeypatch.setattr(model, "AT_ONCE", 1)
    monkeypatch.setattr(model, "grouped_lasso", lambda d, lab: d.select("position", F.explode(F.map_keys("v")).alias("dim")).distinct())
    monkeypatch.setattr(model, "fit_lasso", lambda *a, **k: tries.append(1) or (1 / 0 if len(tries) < 3 else fit(*a, penalties=2, folds=2)))
    with pytest.raises(RuntimeError, match="fits failed: m: ZeroDivisionError"):
        queries.grouped_two_stage(spark, str(tmp_path))
    assert len(tries) == 3

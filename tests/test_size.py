"""Operators do their whole job with little: what they write, compare or hold is measured."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_tables import lev

from helixframe.operators import blockjoin, cluster, model, power, satc
from helixframe.plans import pipeline
from helixframe.runtime import run_dir
from pyspark.sql import functions as F


def texts(seed, n, size=54):
    r = random.Random(seed)
    return ["".join(r.choices("ACGT", k=size)) for _ in range(n)]


def near(seed, s, n):
    r, s = random.Random(seed), list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i : i + 1] = r.choice([[], [r.choice("ACGT")], [s[i], r.choice("ACGT")]])
    return "".join(s)


def written(spark):
    """Rows of all intermediate tables."""
    return sum(pq.read_metadata(x).num_rows for x in Path(run_dir(spark).removeprefix("file://")).rglob("*.parquet"))


def test_assignment_writes_no_candidates(spark):
    members, asked = texts(1, 10_000), texts(2, 1000)
    asked[0] = near(3, members[7], 9)
    q = spark.createDataFrame(list(enumerate(asked)), "id long, seq string")
    c = spark.createDataFrame([(i, i % 50, s) for i, s in enumerate(members)], "ord long, cluster_id long, seq string")
    before = written(spark)
    assert [tuple(x) for x in cluster.assign_to_clusters(q, c).collect()] == [(0, 7, lev(asked[0], members[7]))]
    assert written(spark) - before < 6 * len(members)


@pytest.mark.parametrize("hot", [400, 3])
def test_blocks(spark, monkeypatch, hot):
    """Pairs of every two blocks are found, of any letters and lengths, short ones and hot pieces included."""
    monkeypatch.setattr(blockjoin, "BLOCK", 60)
    monkeypatch.setattr(blockjoin, "LOOKED_UP", 40)
    rows = ["", "A", "é", "né", *texts(4, 6, 30), *texts(5, 6, 80)]
    rows += [near(i, s, i % 7) for s in list(rows[4:]) for i in range(6)] + ["GATTACAGATTACA" + s for s in texts(6, 60, 9)]
    rows = sorted({*rows, rows[5].replace("A", "ä", 1)})
    d = spark.createDataFrame([(str(i), s) for i, s in enumerate(rows)], "id string, seq string")
    want = {(str(i), str(j), lev(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if abs(len(a) - len(b)) <= 4 and lev(a, b) <= 4}
    got = [tuple(x) for x in cluster.edit_distance_join(d.toDF("a", "sa"), d.toDF("b", "sb"), 4, hot).collect()]
    assert len(got) == len(want) and set(got) == want
    own = [tuple(x) for x in cluster.lev_pairs(d, 4).collect()]
    assert len(own) == len(set(own)) and set(own) == {x for x in want if x[0] < x[1]}


def test_leaders_are_sought_among_the_first(spark, monkeypatch):
    rows = texts(7, 400)
    rows += [near(i, s, 3) for i, s in enumerate(rows)]
    seen = []
    pairs = cluster.lev_pairs
    monkeypatch.setattr(cluster, "lev_pairs", lambda d, *a: (seen.append(d.count()), pairs(d, *a))[1])
    got = {x["id"]: x["leader"] for x in cluster.leader_clusters(spark.createDataFrame(list(enumerate(rows)), "id long, seq string"), 10, "id", 20).collect()}
    assert got == {i: i % 400 for i in range(800) if i % 400 < 20}
    assert sum(seen) <= 20 * cluster.FIRST
    # few leaders among the first: more are looked at
    rows = [near(i, rows[0], 2) for i in range(60)] + texts(8, 40)
    rows = list(dict.fromkeys(rows))
    n = sum(lev(rows[0], s) < 10 for s in rows)
    got = {x["leader"] for x in cluster.leader_clusters(spark.createDataFrame(list(enumerate(rows)), "id long, seq string"), 10, "id", 20).collect()}
    assert got == {0, *range(n, n + 19)}


def test_links_are_computed_once(spark, monkeypatch):
    """Components read their links more than once: they are a table, not a join that runs again."""
    given, of = [], cluster.clusters_by_size
    monkeypatch.setattr(cluster, "clusters_by_size", lambda n, e: (given.append(e), of(n, e))[1])
    d = spark.createDataFrame([(0, "ACGTACGTACGT"), (1, "ACGTACGTACG"), (2, "TTTTTTTTTTTT")], "id long, seq string")
    assert {tuple(x) for x in cluster.lev_clusters(d, 3).collect()} == {(0, 0), (0, 1), (1, 2)}
    assert given[0]._cut_path in "".join(given[0].inputFiles())


def test_features_are_described_by_counted_kmers(spark, monkeypatch):
    """The description equals that of all values, which are never made for it."""
    r, names = random.Random(9), sorted(set(texts(9, 30, 27)))
    c = spark.createDataFrame([(f"s{i}", a, x, 1) for i in range(12) for a in names for x in [r.choice(texts(10, 3, 27))] if r.random() < 0.6], "sample string, anchor string, target string, count long")
    st = spark.createDataFrame([(a, 0.8 + i / 1000, 5 + i) for i, a in enumerate(names)], "anchor string, effect_size_bin double, number_nonzero_samples long")
    lab = spark.createDataFrame([(names[0], "clean")], "anchor string, stats string")
    every = pipeline.run(c, st, lab, keep=5).groupBy("feature").agg(F.count("*"), F.round(F.avg("value"), 6), F.round(F.var_samp("value"), 6))
    want = {tuple(x) for x in every.collect()}
    monkeypatch.setattr(pipeline, "selected_features", None)
    got = pipeline.described(c, st, lab, keep=5).select("feature", "samples", F.round("mean", 6), F.round("variance", 6))
    assert {tuple(x) for x in got.collect()} == want and len(want) == 150


def test_wide_rows_are_written_one_by_one(spark):
    """The Parquet writer would hold a hundred rows of megabytes before it looks at its buffers."""
    spark.conf.unset("parquet.page.size.row.check.min")
    d = spark.createDataFrame([("s1", "AAA", "GG", 3)], "sample string, anchor string, target string, count long")
    got = satc.featurize(d, spark.createDataFrame([(0, "AAA")], "ord long, anchor string"), 2).collect()
    assert [tuple(x) for x in got] == [("s1", "GG")] and spark.conf.get("parquet.page.size.row.check.min") == "1"


def test_power_iteration_by_components(spark, monkeypatch):
    """The vector of whole components equals that of one matrix, joins for large ones included, and
    its clusters those of Spark ML, without an exchange for each step."""
    from pyspark.ml.clustering import PowerIterationClustering

    r = random.Random(8)
    pairs = [(i, j, float(r.randint(1, 5))) for n in range(12) for i in range(9 * n, 9 * n + 9) for j in range(i + 1, 9 * n + 9) if j == i + 1 or r.random() < n / 12]
    e = spark.createDataFrame(pairs, "src long, dst long, weight double")
    a = np.zeros((108, 108))
    for i, j, x in pairs:
        a[i, j] = a[j, i] = x
    want, moved = a.sum(1) / a.sum(), []
    for _ in range(20):
        new = (a @ want) / a.sum(1)
        new /= new.sum()
        moved.append(np.abs(new - want).sum())
        want = new
        if len(moved) > 1 and abs(moved[-1] - moved[-2]) <= 1e-5 / 108:
            break
    for large in (power.LARGE, 40):
        monkeypatch.setattr(power, "LARGE", large)
        got = dict(map(tuple, power.power_vector(e).collect()))
        assert len(got) == 108 and np.allclose([got[i] for i in range(108)], want, rtol=1e-9)
    assert power.power_vector(e.where("false")).count() == 0
    two = e.where("src < 9 or src >= 99")
    parts = lambda d: {frozenset(x["id"] for x in d if x["cluster"] == c) for c in {x["cluster"] for x in d}}
    own, ml = cluster.spectral_clusters(two, 2).collect(), PowerIterationClustering(k=2, maxIter=20, weightCol="weight", initMode="degree").assignClusters(two).collect()
    assert parts(own) == parts(ml) and len(parts(own)) == 2


def test_candidates_are_sifted_by_letter_pairs(monkeypatch):
    """Most candidates of a half are left out before they are scanned, none within its edits."""
    one, two = texts(21, 1500), texts(22, 1500)
    two += [near(i, s, i % 9) for i, s in enumerate(one[:300])]
    (fa, oa), (fb, ob) = (blockjoin.letters(pa.array(x)) for x in (one, two))
    fa, fb, kinds = blockjoin.coded(fa, fb)
    scan, scanned = blockjoin._scan, []

    def counted(bits, table, i, j, m, n, steps):
        if n is None:
            scanned.append(len(i))
        return scan(bits, table, i, j, m, n, steps)

    def pairs():
        scanned.clear()
        found = blockjoin.block_pairs(blockjoin.Texts(fa, oa), blockjoin.Texts(fb, ob), 8, kinds)
        return set(zip(*(x.tolist() for x in found), strict=True)), sum(scanned)

    monkeypatch.setattr(blockjoin, "_scan", counted)
    found, some = pairs()
    monkeypatch.setattr(blockjoin.Texts, "grams", lambda self, width, backwards, kind: np.zeros(len(self.size), np.uint64))
    every, most = pairs()
    assert found == every and len(found) > 250 and some < 0.7 * most


def test_bounds_share_the_products_of_columns():
    """Slopes and bounds equal those made row by row, also far from 0, without a table for each class and column."""
    import tracemalloc

    r = np.random.default_rng(5)
    x, y = np.hstack([r.normal(size=(300, 4)), np.ones((300, 1))]), r.integers(0, 40, 300)
    for scale in (1.0, 1e4):
        a = r.normal(size=(5, 40)) * scale
        z = x @ a
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        tracemalloc.start()
        loss, slope, bound = model._slopes(x, y, a)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = (z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) - z[np.arange(300), y]).mean()
        assert np.isclose(loss, want) and np.allclose(slope, x.T @ (q - np.eye(40)[y]) / 300)
        assert np.allclose(bound, np.einsum("nk,ni,nj->kij", q, x, x) / 300)
        assert most < 4 * q.nbytes


@pytest.mark.parametrize("lead", [False, True])
def test_wide_rows_are_packed(spark, tmp_path, lead):
    """What a sample lacks takes little room in a file, and the codec that a session names stays."""
    names = texts(17, 2000, 27)
    d = spark.createDataFrame([(f"s{i}", names[7 * i], "GATTACA", 3) for i in range(3)], "sample string, anchor string, target string, count long")
    a = spark.createDataFrame(list(enumerate(names)), "ord long, anchor string")
    sizes = []
    for codec in (None, "snappy"):
        spark.conf.unset("spark.sql.parquet.compression.codec")
        if codec:
            spark.conf.set("spark.sql.parquet.compression.codec", codec)
        satc.featurize(d, a, 27, lead).write.parquet(f"{tmp_path}/{codec}")
        got = {x["sample"]: x["seq"] for x in spark.read.parquet(f"{tmp_path}/{codec}").collect()}
        assert got == {f"s{i}": "".join(n * lead + ("GATTACA" if k == 7 * i else "N" * 27) for k, n in enumerate(names)) for i in range(3)}
        sizes.append(sum(x.stat().st_size for x in (tmp_path / str(codec)).glob("*.parquet")))
        assert spark.conf.get("spark.sql.parquet.compression.codec") == (codec or "zstd")
    spark.conf.unset("spark.sql.parquet.compression.codec")
    assert sizes[0] < 0.8 * sizes[1]

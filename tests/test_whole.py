"""Queries do the whole job: small tables in which a cut would lose rows, against brute force."""

import random

import pytest
from test_tables import lev

from helixframe import queries
from helixframe.operators import cluster
from pyspark.sql import functions as F


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i : i + 1] = r.choice([[], [r.choice("ACGT")], [s[i], r.choice("ACGT")]])
    return "".join(s)


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    """Folder with ``anchor_clusters``, and its rows: few of the numbers are multiples of 100."""
    r, rows = random.Random(11), []
    for c in range(12):
        base = "".join(r.choice("ACGT") for _ in range(54))
        rows += [(len(rows) + k, c, mutated(r, base, r.randrange(0, 9))) for k in range(6)]
    rows += [(len(rows), None, mutated(r, rows[7][2], 2))]
    d = tmp_path_factory.mktemp("listed")
    spark.createDataFrame(rows, "ord long, cluster_id long, anchor string").write.parquet(f"{d}/anchor_clusters.parquet")
    return str(d), rows


def nodes(rows):
    first = {}
    for o, _, s in rows:
        first.setdefault(s, o)
    return first


def test_assign_to_all_members(spark, listed):
    d, rows = listed
    low = {}
    for o, c, _ in rows:
        low.setdefault(c, o)
    want = set()
    for s, i in nodes(rows).items():
        x, _, c = min((lev(s, m), low[c], c) for _, c, m in rows if c is not None)
        want.add((i, c, x))
    n = spark.createDataFrame([(i, s) for s, i in nodes(rows).items()], "id long, seq string")
    c = spark.createDataFrame(rows, "ord long, cluster_id long, seq string").where("cluster_id is not null")
    got = {tuple(x) for x in cluster.assign_to_clusters(n, c).collect()}
    assert got == want and len({c for _, c, _ in got}) == 12
    # the query takes the sequences whose id is divisible by 100 against every member
    assert {tuple(x) for x in queries.assign_to_clusters(spark, d).collect()} == {x for x in want if x[0] % 100 == 0}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Folder with 600 anchors, each a cluster of its own and seen in one of three samples."""
    r, d = random.Random(12), tmp_path_factory.mktemp("many")
    names = sorted({"".join(r.choice("ACGT") for _ in range(27)) for _ in range(600)})
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put([(i, i, a) for i, a in enumerate(names)], "ord long, cluster_id long, anchor string", "anchor_clusters")
    put([(a, 0.9, 1) for a in names], "anchor string, effect_size_bin double, number_nonzero_samples long", "anchor_stats")
    put([(i, "clean") for i in range(1, 201)], "p_partkey long, p_name string", "part")
    satc = "sample string, anchor string, target string, count long, counted_at timestamp, loaded_at timestamp"
    put([(f"s{i % 3}", a, a[::-1], 1, None, None) for i, a in enumerate(names)], satc, "satc")
    return str(d), names


def test_production_sizes(spark, many):
    d, names = many
    assert {x["anchor"] for x in queries.select_anchors(spark, d).collect()} == set(names)
    assert {x["anchor"] for x in queries.top_clusters(spark, d).collect()} == set(names)
    want = {f"s{j}": "".join(a + (a[::-1] if i % 3 == j else "N" * 27) for i, a in enumerate(names)) for j in range(3)}
    assert {x["sample"]: x["seq"] for x in queries.cluster_sample_sequence(spark, d).collect()} == want
    # every place of 600 clusters has one k-mer of 54 letters a sample, of which 40 dimensions are kept
    assert queries.embedding_pipeline(spark, d).select("feature").distinct().count() == 600 * 40


def test_all_anchors(spark, many, tmp_path):
    d, names = many
    got = queries.sequence_lookup(spark, d).collect()
    assert {x["query"] for x in got} == set(names) and {x["ord"] for x in got} == set(range(600))
    want = {f"s{j}": "".join(a[::-1] if i % 3 == j else "N" * 27 for i, a in enumerate(names)) for j in range(3)}
    # all anchors have one sample, so the list is in the order of their text
    assert {x["sample"]: x["seq"] for x in queries.featurize(spark, d).collect()} == want
    # reads hold a late and a shorter anchor at whole length, and one that only starts like an anchor
    reads = ["CC" + names[500] + "GATTA", "CC" + names[3][:20] + "GATTA", names[400][:12] + "A" * 20]
    spark.createDataFrame([(i, i, x) for i, x in enumerate(reads)], "ord long, cluster_id long, anchor string").write.parquet(f"{tmp_path}/anchor_clusters.parquet")
    t = spark.read.parquet(f"{d}/satc.parquet")
    t.union(t.limit(1).withColumn("anchor", F.lit(names[3][:20]))).write.parquet(f"{tmp_path}/satc.parquet")
    hits = {(x["record_id"], x["anchor"], x["target"]) for x in queries.anchor_hits(spark, str(tmp_path)).collect()}
    assert hits >= {("r0", names[500], "GATTA"), ("r1", names[3][:20], "GATTA")}
    assert not any(x[0] == "r2" for x in hits)


def test_five_edits(spark, listed):
    d, rows = listed
    seen = nodes(rows)
    want = {(i, j, lev(a, b)) for a, i in seen.items() for b, j in seen.items() if i < j and lev(a, b) <= 5}
    assert {tuple(x) for x in queries.lev_pairs(spark, d).collect()} == want and any(x > 3 for _, _, x in want)
    low = {i: i for i in seen.values()}
    for _ in low:
        for i, j, _ in want:
            low[i] = low[j] = min(low[i], low[j])
    groups = {}
    for x in queries.lev_clusters(spark, d).collect():
        groups.setdefault(x["cluster_id"], set()).add(x["id"])
    assert {min(g): g for g in groups.values()} == {m: {i for i in low if low[i] == m} for m in set(low.values())}
    spectral = {x["id"]: x["cluster"] for x in queries.spectral_clusters(spark, d).collect()}
    alone = set(low) - {i for x in want for i in x[:2]}
    assert set(spectral) == set(low) and alone and len({spectral[i] for i in alone}) == len(alone)


@pytest.mark.parametrize("lead", [False, True])
def test_features_of_every_anchor(spark, many, monkeypatch, lead):
    """The list of anchors has no end of its own: the SQL has none."""
    d, names = many
    monkeypatch.setattr(queries.anchors, "ANCHORS", 10)
    got = (queries.featurize_with_anchor if lead else queries.featurize)(spark, d).collect()
    want = {f"s{j}": "".join(a * lead + (a[::-1] if i % 3 == j else "N" * 27) for i, a in enumerate(names)) for j in range(3)}
    assert {x["sample"]: x["seq"] for x in got} == want


def test_every_sequence_has_a_leader(spark, tmp_path, monkeypatch):
    """The query's scan ends with the sequences, and the near pairs it has found are not sought again."""
    r = random.Random(13)
    rows = ["".join(r.choice("ACGT") for _ in range(54)) for _ in range(5200)]
    rows += [mutated(r, s, 3) for s in rows[::200]]
    spark.createDataFrame([(i, i, s) for i, s in enumerate(rows)], "ord long, cluster_id long, anchor string").write.parquet(f"{tmp_path}/anchor_clusters.parquet")
    monkeypatch.setattr(cluster, "edit_distance_join", None)
    got = {x["id"]: x["leader"] for x in queries.leader_clusters(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(rows))) and len(set(got.values())) == 5200
    assert all(got[200 * k] == got[5200 + k] in (200 * k, 5200 + k) for k in range(26))

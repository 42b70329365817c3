"""Hand-derived cases of count tables, anchors, clustering, splits, features and sources."""

import gzip
import random

import numpy as np
import pytest

from helixframe.operators import anchors, cluster, features, satc, splits
from helixframe.operators.graph import connected_components
from helixframe.operators.indexing import with_index
from helixframe.operators.ranking import distributed_rank
from helixframe.sources import fasta, tables
from pyspark.sql import functions as F

S = "sample string, anchor string, target string, count long"


def seqs(df):
    return {x["sample"]: x["seq"] for x in df.collect()}


def test_featurize(spark):
    d = spark.createDataFrame([("s1", "AAA", "GG", 3), ("s1", "AAA", "AC", 3), ("s2", "CCC", "TT", 1), (None, "AAA", "GG", 1), ("s9", "TTT", "GG", 1)], S)
    a = spark.createDataFrame([(0, "AAA"), (1, "CCC")], "ord long, anchor string")
    assert seqs(satc.featurize(d, a, 2)) == {"s1": "ACNN", "s2": "NNTT"}
    assert seqs(satc.featurize(d, a, 2, True)) == {"s1": "AAAACCCCNN", "s2": "AAANNCCCTT"}
    assert satc.featurize(d.where("false"), a, 2).count() == 0


def test_representatives(spark):
    c = spark.createDataFrame([(0, 1, "GGG"), (1, 1, "AAA"), (2, 2, "CCC")], "ord long, cluster_id long, anchor string")
    d = spark.createDataFrame([("s1", "GGG", "TT", 5), ("s1", "AAA", "AC", 1), ("s1", "CCC", "TA", 2)], S)
    assert seqs(satc.representative_sequence(d, c)) == {"s1": "ACTA"}
    assert seqs(satc.representative_sequence(d, c, representative="cluster_order")) == {"s1": "TATT"}
    n = "N" * 27
    assert seqs(satc.representative_sequence(d, c, 2)) == {"s1": f"AC{n}TA{n}"}
    more = d.union(spark.createDataFrame([("s2", "AAA", "AC", 1)], S))
    assert seqs(satc.cluster_sample_sequence(more, c)) == {"s1": "GGGTTCCCTA", "s2": f"AAAACCCC{n}"}


def test_legacy(spark):
    d = spark.createDataFrame([("7 ACGTT s1",), ("",)], "value string")
    assert satc.from_legacy(d, 3).collect() == [("s1", "ACG", "TT", 7)]


def test_reorder(spark):
    c = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "cluster_id long, anchor string")
    st = spark.createDataFrame([("a", 0.8, 10), ("b", 0.9, 20), ("c", 0.95, 100)], "anchor string, effect_size_bin double, number_nonzero_samples long")
    got = anchors.reorder_clusters(c, st).orderBy("cluster_id", "place").collect()
    assert [(x["cluster_id"], x["anchor"]) for x in got] == [(1, "c"), (2, "b"), (2, "a")]


def test_shift_clusters(spark):
    names = ["ACGTA", "CGTAC", "GTACC", "TTTTT", "GGGGA"]
    d = spark.createDataFrame(list(enumerate(names)), "id long, seq string")
    got = {x["id"]: x["cluster_id"] for x in cluster.shift_clusters(d, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def family():
    r = random.Random(5)
    out = ["", "A", "AC", "ACGTA"]
    for _ in range(12):
        base = "".join(r.choice("ACGT") for _ in range(r.randrange(8, 30)))
        for _ in range(4):
            s = list(base)
            for _ in range(r.randrange(0, 4)):
                i = r.randrange(len(s))
                s[i : i + 1] = r.choice([[], [r.choice("ACGT")], [s[i], r.choice("ACGT")]])
            out.append("".join(s))
    return sorted(set(out))


def test_edit_distance_join(spark, family):
    d = spark.createDataFrame([*enumerate(family), (-1, None)], "id long, seq string")
    want = {(i, j, lev(a, b)) for i, a in enumerate(family) for j, b in enumerate(family) if i < j and lev(a, b) <= 3}
    assert {tuple(x) for x in cluster.lev_pairs(d, 3).collect()} == want


def test_edit_distance_join_hot_pieces(spark, family):
    # all records share their first letters, so that the first piece is hot
    r = random.Random(8)
    ends = ["".join(r.choice("ACGT") for _ in range(24)) for _ in range(14)]
    rows = sorted({"ACGTTGCA" + e for e in ends} | {"ACGTTGCA" + e[:9] + e[10:] + "A" for e in ends})
    d = spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    want = {(i, j, lev(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if lev(a, b) <= 3}
    got = cluster.edit_distance_join(d.toDF("a", "sa"), d.toDF("b", "sb"), 3, hot=20)
    assert {tuple(x) for x in got.collect()} == want and len(want) > len(rows)


@pytest.mark.parametrize("d", [2, 5, 10])
def test_edit_distance_join_of_short_pieces(spark, d):
    """Pieces of few letters make keys in pairs."""
    r, rows = random.Random(d), []
    for _ in range(14):
        base = "".join(r.choice("ACGT") for _ in range(r.choice([d + 1, 14, 27, 54])))
        for _ in range(4):
            s = list(base)
            for _ in range(r.randrange(0, d + 2)):
                i = r.randrange(len(s)) if s else 0
                s[i : i + 1] = r.choice([[], [r.choice("ACGT")], [r.choice("ACGT"), r.choice("ACGT")]])
            rows.append("".join(s))
    rows = sorted(set(rows))
    x = spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    want = {(i, j, lev(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and lev(a, b) <= d}
    assert {tuple(x) for x in cluster.lev_pairs(x, d).collect()} == want


@pytest.mark.parametrize("most", [None, 5])
def test_leaders(spark, family, most):
    d = spark.createDataFrame([(i, -i, s) for i, s in enumerate(family)], "id long, back long, seq string")

    def scan(order):
        lead = []
        for i in order:
            if all(lev(family[i], family[j]) >= 4 for j in lead) and len(lead) < (most or 10**6):
                lead.append(i)
        return sorted(lead)

    for order, ids in (("id", range(len(family))), ("back", reversed(range(len(family))))):
        got = {x["id"]: x["leader"] for x in cluster.leader_clusters(d, 4, order, most).collect()}
        lead = scan(ids)
        assert sorted(set(got.values())) == lead
        near = {i: min((lev(s, family[j]), j) for j in lead) for i, s in enumerate(family)}
        assert got == {i: j for i, (x, j) in near.items() if x < 4}
    assert cluster.leader_clusters(d, 4, None, most).count() > 0


def test_members_and_samples(spark, family):
    c = spark.createDataFrame([(i, i % 5, s) for i, s in enumerate(family)], "ord long, cluster_id long, seq string")
    d = spark.createDataFrame(list(enumerate(family)), "id long, seq string")
    assert cluster.assign_to_clusters(d, c, 3, most=2).count() < cluster.assign_to_clusters(d, c, 3).count() == len(family)
    got = {tuple(x) for x in cluster.sampled_pairs(d, 3).collect()}
    every = {(i, j, lev(a, b)) for i, a in enumerate(family) for j, b in enumerate(family) if lev(a, b) <= 3}
    assert got < every and {tuple(x) for x in cluster.sampled_pairs(d, 3, 1.0).collect()} == every


def test_order_by_effect(spark):
    m = spark.createDataFrame([(2, "a"), (1, "b"), (1, "c"), (1, "d")], "cluster int, anchor string")
    st = spark.createDataFrame([("b", 0.2), ("c", 0.9)], "anchor string, effect_size_bin double")
    assert [(x["place"], x["anchor"]) for x in cluster.ordered_by_effect(m, st).orderBy("place").collect()] == [(0, "c"), (1, "b"), (2, "d"), (3, "a")]


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (None, 3)]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[601] == 600 and got[500] == 500
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranks_and_numbers(spark):
    d = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(100)] + [(None, 1000)], "g string, v long")
    r = distributed_rank(d, ["g"], F.xxhash64("v"), ["v"]).collect()
    assert sorted(x["rank_no"] for x in r if x["g"] == "a") == list(range(1, 67)) and len(r) == 101
    n = with_index(d, ["v"], "n").collect()
    assert sorted((x["n"], x["v"]) for x in n)[:3] == [(0, 0), (1, 1), (2, 2)] and len(n) == 101


def test_splits(spark):
    d = spark.createDataFrame([(i, f"p{i % 20}_x{i}", "ab"[i % 2]) for i in range(200)], "id long, name string, c string")
    one = splits.prefix_split(d, "name").groupBy("prefix").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert one == 1
    n = {(x["c"], x["split"]): x["count"] for x in splits.stratified_split(d, "id", "c").groupBy("c", "split").count().collect()}
    assert n == {(c, s): k for c in "ab" for s, k in (("train", 70), ("val", 15), ("test", 15))}
    assert splits.balanced_split(d, "id", "c").where("split = 'train'").count() == 100
    assert splits.class_filter(d, "c", 100).count() == 0 and splits.class_filter(d, "c", 100, True).count() == 200


def test_principal_components(spark):
    x = np.random.default_rng(3).normal(size=(9, 6))
    d = spark.createDataFrame([(f"k{i}", [float(v) for v in r]) for i, r in enumerate(x)], "kmer string, embedding array<double>")
    got, _ = features.principal_components(d, 2)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    u = np.linalg.svd(z.T, full_matrices=False)[2][:2]
    u = [v * np.sign(v[np.argmax(abs(v))]) for v in u]
    for r in got.collect():
        assert abs(u[r["pc"] - 1][int(r["kmer"][1:])] - r["loading"]) < 1e-6


def test_vectors(spark):
    d = spark.createDataFrame([("s1", "b", 2.0), ("s1", "a", 1.0), ("s2", "c", 3.0)], "sample_name string, feature string, value double")
    got = {x["sample_name"]: x["features"] for x in features.vectors(d).collect()}
    assert got == {"s1": [1.0, 2.0, 0.0], "s2": [0.0, 0.0, 3.0]}
    assert features.vectors(d.where("false")).count() == 0
    names = spark.createDataFrame([("cluster_3_embedding_12",), ("Intercept",), ("cluster_0_PC_1",)], "feature string")
    assert {tuple(x) for x in features.feature_parts(names).collect()} == {("cluster_3_embedding_12", 3, 12), ("Intercept", None, None), ("cluster_0_PC_1", 0, 1)}


def test_fasta(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x one\r\nACGT\nAC\n\n>y\n>z\nTT\n")
    (tmp_path / "in" / "b.gz").write_bytes(gzip.compress(b"@q\nACGT\n+\n@@@@\n@r\nTT\n+\nII\n"))
    fasta.register(spark)
    got = spark.read.format("fasta").load(str(tmp_path / "in")).orderBy("ord").collect()
    assert [(x["record_id"], x["seq"]) for x in got] == [("x", "ACGTAC"), ("y", ""), ("z", "TT"), ("q", "ACGT"), ("r", "TT")]
    (tmp_path / "in" / "c.fa").write_text(">last\nGG")
    (tmp_path / "in" / "a0.fa").write_text(">big\n" + "ACGTACGT\n" * 3000)
    got = fasta.read_fasta(spark, str(tmp_path / "in" / "*.fa")).orderBy("ord").collect()
    assert [(x["record_id"], x["description"], x["seq"]) for x in got] == [("x", "x one", "ACGTAC"), ("y", "y", ""), ("z", "z", "TT"), ("big", "big", "ACGTACGT" * 3000), ("last", "last", "GG")]
    assert [x["ord"] for x in got] == list(range(5))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)  # a record may reach over many splits
    try:
        assert [tuple(x) for x in fasta.read_fasta(spark, str(tmp_path / "in" / "*.fa")).orderBy("ord").collect()] == [tuple(x) for x in got]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "r.fastq").write_text("@q one\nACGT\n+\n@@@@\n@r\nTT\n+\nII\n")
    got = fasta.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("ord").collect()
    assert [(x["record_id"], x["seq"], x["quality"]) for x in got] == [("q", "ACGT", "@@@@"), ("r", "TT", "II")]
    fasta.write_fasta(spark.createDataFrame([("a", "ACGTA")], "record_id string, seq string"), str(tmp_path / "out"), 2)
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_text_readers(spark, tmp_path):
    (tmp_path / "satc.tsv").write_text("s1\tAAA\tCC\t3\textra\ns2\tAAA\tCC\tx\n")
    assert [tuple(x) for x in tables.read_satc(spark, str(tmp_path / "satc.tsv")).collect()] == [("s1", "AAA", "CC", 3), ("s2", "AAA", "CC", None)]
    (tmp_path / "list").write_text(" AAA \n\nCCC\n")
    assert [tuple(x) for x in tables.read_anchor_list(spark, str(tmp_path / "list")).orderBy("ord").select("anchor", "ord").collect()] == [("AAA", 0), ("CCC", 1)]
    (tmp_path / "two").mkdir()  # the smaller file comes first, although the larger one is read first
    (tmp_path / "two" / "a.txt").write_text("AAA\nAAC\n")
    (tmp_path / "two" / "b.txt").write_text("CCC\n" + "GGG\n" * 500)
    got = [x["anchor"] for x in tables.read_anchor_list(spark, str(tmp_path / "two")).orderBy("ord").collect()]
    assert got == ["AAA", "AAC", "CCC"] + ["GGG"] * 500
    (tmp_path / "cl").write_text("1\tA\n2\tB\n1\tC\n2\tA\n\tD\n")
    c = tables.read_clusters(spark, str(tmp_path / "cl"))
    assert {tuple(x) for x in tables.cluster_of_anchor(c).where("cluster_id is not null").collect()} == {("A", 2), ("B", 2), ("C", 1)}
    assert {(x["cluster_id"], x["anchor"], x["place"]) for x in tables.ranked_members(c).collect()} == {(1, "A", 1), (1, "C", 2), (2, "B", 1), (2, "A", 2)}
    (tmp_path / "wide.tsv").write_text("sample\tf1\tf2\ns1\t0.5\t2\n")
    assert {tuple(x) for x in tables.read_matrix(spark, str(tmp_path / "wide.tsv")).collect()} == {("s1", "f1", 0.5), ("s1", "f2", 2.0)}
    (tmp_path / "emb").write_text("k1\t0.5\t1.5\n")
    assert tables.read_embeddings(spark, str(tmp_path / "emb")).first()["embedding"] == [0.5, 1.5]

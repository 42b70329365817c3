"""Hand-derived cases of the sequence functions and window operators."""

import random

from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import kmers


def value(spark, seq, expr):
    return spark.createDataFrame([(seq,)], "seq string").select(expr.alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert value(spark, "AACGRYn", sq.reverse_complement("seq")) == "nRYCGTT"
    twice = sq.reverse_complement(sq.reverse_complement("seq"))
    assert value(spark, "ACGTNKM", twice) == "ACGTNKM"
    assert value(spark, None, sq.reverse_complement("seq")) is None


def test_jumble_order(spark):
    e = sq.jumble("seq", drop_n=True, backwards=True, length=3, at=True, cg=True)
    assert value(spark, "ANCGTn", e) == "TGG"


def test_translation(spark):
    assert value(spark, "TTAGCTTGCATCGATCCCGGGAAATTT", sq.longest_frame("seq")) == (1, "LACIDPGKF")
    for seq, want in (("ATGAAAGCTGCTTGG", "MKAAW"), ("TAATAGTGA", "X"), ("ACGT", "X"), ("", "X")):
        assert value(spark, seq, sq.longest_frame("seq"))["protein"] == want
    # the padded codon CCN is proline however N is read
    for seq, want in (("TAAGCC", "KP"), ("ATGAAA", "MK"), ("TAACTAGTAGCC", "TSSX")):
        assert value(spark, seq, sq.stop_free("seq")) == want
    assert value(spark, "GGNTAR", sq.translate("seq")) == "G*"
    assert value(spark, "", sq.translate("seq")) == ""
    assert value(spark, "AT ATGTT", sq.translate("seq")) == "XM"  # no codon lies across two known ones
    assert value(spark, "ATGAAATGAAGA", sq.translate("seq", 2)) == "MKW*"
    assert value(spark, None, sq.translate("seq")) is None and value(spark, None, sq.stop_free("seq")) is None
    assert value(spark, "ATGGCC" * 50_000, sq.translate("seq")) == "MA" * 50_000


def test_translation_against_loop(spark):
    r = random.Random(1)
    seqs = ["".join(r.choice("ACGTN") for _ in range(r.randrange(0, 40))) for _ in range(60)]
    table = {a + b + c: sq.STANDARD[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    table |= {a + b + "N": table[a + b + "T"] for a in "TCAG" for b in "TCAG" if len({table[a + b + c] for c in "TCAG"}) == 1}
    want = ["".join(table.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3)) for s in seqs]
    got = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string").select("i", sq.translate("seq").alias("p")).orderBy("i")
    assert [x["p"] for x in got.collect()] == want


def test_mutation_only_complements(spark):
    got = value(spark, "ACGTN" * 40, sq.mutate("seq", "seq", 0.3))
    pair = {"A": "AT", "T": "TA", "C": "CG", "G": "GC", "N": "N"}
    assert all(b in pair[a] for a, b in zip("ACGTN" * 40, got, strict=True)) and got != "ACGTN" * 40


def records(spark, *seqs):
    return spark.createDataFrame([(i, f"r{i + 1}", s) for i, s in enumerate(seqs)], "ord long, record_id string, seq string")


def test_windows(spark):
    rows = kmers.windows(records(spark, "ACGTACG", "AC", "", None), 3, 2).collect()
    assert sorted((x["start"], x["kmer"]) for x in rows) == [(0, "ACG"), (2, "GTA"), (4, "ACG")]
    assert sorted(x["kmer"] for x in kmers.windows(records(spark, "ACGTACG"), 3, 3).collect()) == ["ACG", "TAC"]


def test_long_records_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(kmers, "CHUNK", 7)
    text = "ACGTTGCAAGGCTTAACCGTATGCGGA"
    d = records(spark, text, "ACG", None, "")
    for k, step in ((3, 1), (5, 2), (9, 9), (4, 11)):
        want = {(i, text[i : i + k]) for i in range(0, len(text) - k + 1, step)} | ({(0, "ACG")} if k == 3 else set())
        assert {(x["start"], x["kmer"]) for x in kmers.windows(d, k, step).collect()} == want
    a = spark.createDataFrame([(0, "GCA"), (1, "GGC")], "ord long, anchor string")
    got = sorted((x["anchor"], x["target"]) for x in kmers.anchor_hits(d.where("ord = 0"), a, 4).where("not reverse_complement").collect())
    assert got == sorted((text[i : i + 3], text[i + 3 : i + 7]) for i in range(len(text) - 3) if text[i : i + 3] in ("GCA", "GGC", "TGC", "GCC"))


def test_decomposition(spark):
    df = records(spark, "ACGTACG", "GTATT")
    assert {(x["kmer_id"], x["kmer"]) for x in kmers.distinct_kmers(df, 3, 2).collect()} == {("3mer_0", "ACG"), ("3mer_1", "GTA"), ("3mer_2", "ATT")}
    assert {("r1", "3mer_1", 2, 5), ("r2", "3mer_1", 0, 3)} <= {(x["record_id"], x["kmer_id"], x["start"], x["end"]) for x in kmers.kmer_ordering(df, 3, 2).collect()}


def test_anchor_hits(spark):
    a = spark.createDataFrame([(0, "ACC")], "ord long, anchor string")
    got = {(x["anchor"], x["target"], x["reverse_complement"]) for x in kmers.anchor_hits(records(spark, "AACCGTT"), a, 2).collect()}
    assert got == {("ACC", "GT", False), ("GGT", "T", True)}
    assert kmers.anchor_hits(records(spark, "AACC"), a.where("false"), 2).count() == 0


def test_empty_tables(spark):
    none = records(spark, "A").where("false")
    assert kmers.windows(none, 3).count() == 0 and kmers.distinct_kmers(none, 3).count() == 0
    assert none.select(sq.longest_frame("seq")).count() == 0 and none.select(F.length("seq")).count() == 0

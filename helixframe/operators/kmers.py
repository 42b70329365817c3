"""K-mer windows, decompositions and anchor scans over ``(record_id, ord, seq)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators.indexing import with_index
from helixframe.runtime import growing


def window_array(seq: Column, k: int, step: int, last: int = 0) -> Column:
    """Array of whole windows of ``k`` letters at 0, step, ...; null if there is none. ``last``
    letters at the end are kept free. The guard stands twice because sequence() would count down
    or fail where the record is too short. Plain text is cut by bytes: a cut by letters counts from
    the start of the record each time, which is quadratic in long ones."""
    n = F.length(seq) - k - last
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step))
    by_bytes = F.transform(F.array(seq.cast("binary")), lambda b: F.transform(starts, lambda i: F.substring(b, i + 1, F.lit(k)).cast("string")))[0]
    by_letters = F.transform(starts, lambda i: F.substring(seq, i + 1, F.lit(k)))
    return F.when(n >= 0, F.when(F.octet_length(seq) == F.length(seq), by_bytes).otherwise(by_letters))


#: Letters of a piece into which long records are cut before their windows are listed.
CHUNK = 1 << 16


def chunks(df: DataFrame, step: int, beyond: int) -> DataFrame:
    """Records cut into pieces ``seq`` that start at ``off``, a multiple of ``step``, and reach
    ``beyond - step`` letters into the next, so that no window of ``beyond`` letters is lost and
    the windows of a whole chromosome never stand in one array."""
    size = step * -(-CHUNK // step)
    keep = [c for c in df.columns if c != "seq"]
    offs = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    d = df.where("seq is not null").select(*keep, "seq", offs.alias("off"))
    length = F.lit(size + beyond - step)
    by_bytes = F.substring(F.col("seq").cast("binary"), F.col("off") + 1, length).cast("string")
    piece = F.when(F.octet_length("seq") == F.length("seq"), by_bytes).otherwise(F.substring(F.col("seq"), F.col("off") + 1, length))
    return d.select(*keep, "off", piece.alias("seq"))


def windows(df: DataFrame, k: int = 27, step: int = 1, both_strands: bool = False) -> DataFrame:
    """One row for each window: all columns but seq, ``strand``, ``start``, ``end``, ``kmer``.
    Records shorter than k, empty and null ones give no rows."""
    d = df.withColumn("strand", F.lit("+"))
    if both_strands:
        d = d.unionByName(df.withColumn("seq", reverse_complement("seq")).withColumn("strand", F.lit("-")))
    keep = [c for c in d.columns if c != "seq"]
    w = chunks(d, step, k).select(*keep, "off", F.posexplode(window_array(F.col("seq"), k, step)).alias("i", "kmer"))
    start = F.col("off") + F.col("i") * step
    return w.select(*keep, start.alias("start"), (start + k).alias("end"), "kmer")


def motifs(df: DataFrame, n: int = 9) -> DataFrame:
    """``(record_id, motif)``: all substrings of n letters, one letter apart."""
    return windows(df, n, 1).select("record_id", F.col("kmer").alias("motif"))


def distinct_kmers(df: DataFrame, k: int, step: int | None = None) -> DataFrame:
    """``(kmer_id, kmer)``; ids ``{k}mer_{i}`` number k-mers by first appearance in record order."""
    first = windows(df, k, step or k).groupBy("kmer").agg(F.min(F.struct("ord", "start")).alias("f"))
    first = first.select("kmer", F.col("f.ord").alias("o"), F.col("f.start").alias("s"))
    return with_index(first, ["o", "s"], "i").select(F.concat(F.lit(f"{k}mer_"), F.col("i").cast("string")).alias("kmer_id"), "kmer")


def kmer_ordering(df: DataFrame, k: int, step: int | None = None) -> DataFrame:
    """``(record_id, kmer, kmer_id, start, end)`` of every window."""
    return windows(df, k, step or k).join(growing(distinct_kmers(df, k, step)), "kmer").select("record_id", "kmer", "kmer_id", "start", "end")


def anchor_hits(df: DataFrame, anchors: DataFrame, size: int = 5, k: int | None = None) -> DataFrame:
    """``(record_id, anchor, target, reverse_complement)``: wherever an anchor or its reverse
    complement stands on either strand, with up to ``size`` letters after it.

    k is the length of the first anchor by text unless given; a window needs one letter after it.
    A null or repeated anchor changes nothing; the planner broadcasts the list if it is small.
    """
    if k is None:
        row = anchors.where("anchor is not null").orderBy("ord").select(F.length("anchor").alias("k")).first()
        if row is None:
            return df.select("record_id", F.lit("").alias("anchor"), F.lit("").alias("target"), F.lit(False).alias("reverse_complement")).limit(0)
        k = row["k"]
    wanted = anchors.select("anchor").union(anchors.select(reverse_complement("anchor"))).distinct()
    strands = F.explode(F.array(F.struct(F.col("seq").alias("s"), F.lit(False).alias("rc")), F.struct(reverse_complement("seq").alias("s"), F.lit(True).alias("rc"))))
    d = df.select("record_id", strands.alias("x")).select("record_id", "x.rc", F.col("x.s").alias("seq"))
    # each window brings its own target along, so that no record is carried into the join
    d = chunks(d, 1, k + max(size, 1))
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - k - 1, F.lit(0)))
    cut = F.transform(F.array(F.col("seq").cast("binary")), lambda b: F.transform(starts, lambda i: F.substring(b, i + 1, F.lit(k + size)).cast("string")))[0]
    letters = F.transform(starts, lambda i: F.substring(F.col("seq"), i + 1, F.lit(k + size)))
    w = F.when(F.length("seq") > k, F.when(F.octet_length("seq") == F.length("seq"), cut).otherwise(letters))
    w = d.select("record_id", "rc", "off", F.posexplode(w).alias("i", "w"))
    # a window that starts in the overlap belongs to the next piece
    w = w.where(F.col("i") < CHUNK).select("record_id", "rc", F.substring("w", 1, k).alias("anchor"), F.expr(f"substring(w, {k + 1})").alias("target"))
    return w.join(wanted, "anchor", "left_semi").select("record_id", "anchor", "target", F.col("rc").alias("reverse_complement"))

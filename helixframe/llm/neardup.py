"""Near-duplicate records: a parity-sketch join with an exact edit-distance check.

Tokens of a record are its overlapping ``GRAM``-letter substrings. Every token hashes to one bit
and bits are combined by XOR, so the Hamming distance of two sketches never exceeds the symmetric
difference of the token multisets, and one edit changes at most ``2 * GRAM`` tokens.

Three steps, all of them DataFrame joins:

1. *Bands.* A record of size band [lo, ..) is laid out in ``d + 1`` segments of ``lo // (d + 1)``
   letters. By the pigeonhole principle, of two records within ``d`` edits some segment ``i`` of
   the one stands unchanged in the other, shifted by at most ``i``: if every segment before an
   untouched one had taken more edits than its number, the edits would exceed ``d``. The key of a
   segment is the parity sketch of its letters by position; indexed segments and shifted probes
   meet in an equi-join on that key.
2. *Hamming filter* on the whole-record sketches: pairs further apart than ``2 * GRAM * d`` bits
   cannot be within ``d`` edits.
3. *Verification* by edit distances of whole batches of pairs.

A segment that very many records share (a common leading stretch) would make a hot key. Such keys
leave the join; their records are joined again among themselves without that segment, where the
same pigeonhole argument holds for what remains. This repeats until no key is hot, so nothing is
dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.editing import flat_bytes, with_distance
from helixframe.operators.graph import connected_components
from helixframe.runtime import cut, growing

GRAM = 4
#: Records that share an index key above this count are joined again without the shared segment.
HOT = 400
#: Segments need no more letters than this to be selective.
WIDEST = 24

_MIX = np.uint64(0x9E3779B97F4A7C15)


def cleaned(anchor: Column) -> Column:
    """Upper case, everything but A, C, G, T and N taken out; null stays null."""
    return F.regexp_replace(F.upper(anchor), "[^ACGTN]", "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bit pattern of each token (place in the segment, letter); a segment's sketch is their XOR.
_TOKEN = _mix(np.arange(1, WIDEST * 256 + 1, dtype=np.uint64) * _MIX).reshape(WIDEST, 256)


def size_bounds(d: int, top: int) -> list[int]:
    """Lower ends of the size bands: steps of d + 1 at first, then growing by a fifth."""
    out = [0, d + 1]
    while out[-1] <= top + d:
        out.append(max(out[-1] + 2 * (d + 1) - out[-1] % (2 * (d + 1)), int(out[-1] * 1.2)))
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Random 64-bit value of each letter."""
    return _mix((data.astype(np.uint64) + np.uint64(1)) * _MIX)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, s) -> (id, s, lo, hi): 128-bit parity sketch of the GRAM-letter tokens."""
    for batch in batches:
        data, offs = flat_bytes(batch.column("s"))
        n = max(len(data) - GRAM + 1, 0)
        tok = np.zeros(n, np.uint64)
        for j in range(GRAM):
            tok = _mix(tok ^ _letters(data[j : j + n]))
        bit = (tok & np.uint64(127)).astype(np.int64)
        one = np.uint64(1) << (bit % 64).astype(np.uint64)
        halves = []
        for h in (0, 1):
            acc = np.zeros(n + 1, np.uint64)
            np.bitwise_xor.accumulate(np.where(bit // 64 == h, one, np.uint64(0)), out=acc[1:])
            end = np.maximum(np.minimum(offs[1:] - GRAM + 1, n), offs[:-1].clip(max=n))
            halves.append((acc[end] ^ acc[offs[:-1].clip(max=n)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("s"), pa.array(halves[0]), pa.array(halves[1])], ["id", "s", "lo", "hi"])


def _keys(batch: pa.RecordBatch, d: int, probe: bool) -> pa.RecordBatch:
    """One list of (key, start, width) for every record: its segments, or all shifted probes."""
    data, offs = flat_bytes(batch.column("s"))
    group = batch.column("g").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.diff(offs)
    bounds = np.array(size_bounds(d, int(size.max(initial=0)) + d), np.int64)
    at, keys, starts, widths = [], [], [], []
    home = np.searchsorted(bounds, size, side="right") - 1
    first = np.searchsorted(bounds, np.maximum(size - d, 0), side="right") - 1 if probe else home
    last = np.searchsorted(bounds, size + d, side="right") - 1 if probe else home
    for band in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
        rows = np.nonzero((first <= band) & (band <= last))[0]
        if not len(rows):
            continue
        w = int(min(bounds[band] // (d + 1), WIDEST))
        salt = _mix(group[rows] ^ _mix(np.uint64(band + 1) * np.ones(1, np.uint64)))
        if w == 0:
            at.append(rows), keys.append(_mix(salt ^ _MIX)), starts.append(np.zeros(len(rows), np.int32)), widths.append(np.zeros(len(rows), np.int32))
            continue
        for i in range(d + 1):
            for shift in range(-i, i + 1) if probe else (0,):
                s = i * w + shift
                if s < 0:
                    continue
                ok = size[rows] >= s + w
                r = rows[ok]
                key = np.zeros(len(r), np.uint64)
                for j in range(w):
                    key ^= _TOKEN[j][data[offs[r] + s + j]]
                at.append(r)
                keys.append(_mix(key ^ _mix(salt[ok] + np.uint64(i))))
                starts.append(np.full(len(r), s, np.int32))
                widths.append(np.full(len(r), w, np.int32))
    n = batch.num_rows
    if at:
        row = np.concatenate(at)
        order = np.argsort(row, kind="stable")
        row = row[order]
        key, start, width = (np.concatenate(x)[order] for x in (keys, starts, widths))
    else:
        row, key, start, width = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    parts = [pa.array(key.view(np.int64)), pa.array(start), pa.array(width)]
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["key", "start", "width"]))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _CARRIED), lists], [*_CARRIED, "k"])


_CARRIED = ["id", "g", "s", "lo", "hi"]
_KEYED = "id long, g long, s string, lo long, hi long, k array<struct<key: long, start: int, width: int>>"


def _keyed(df: DataFrame, d: int, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _keys(b, d, probe)

    return df.select(*_CARRIED).mapInArrow(run, _KEYED).select(*_CARRIED, F.explode("k").alias("k")).select(*_CARRIED, "k.*")


def close_pairs(distinct: DataFrame, d: int, hot: int = HOT) -> DataFrame:
    """``(a, b, dist)`` with a < b for all records of ``(id, s)`` within ``d`` edits.

    Strings must be distinct and not null; an empty table gives no pairs.
    """
    found: list[DataFrame] = []
    sketched = distinct.select("id", "s").mapInArrow(sketches, "id long, s string, lo long, hi long")
    rows = probes = cut(sketched.withColumn("g", F.lit(0).cast("long")))
    while True:
        index = _keyed(rows, d, False)
        probe = _keyed(probes, d, True)
        busy = cut(index.where("width > 0").groupBy("key").count().where(F.col("count") > hot).select("key"))
        none = busy.isEmpty()
        i, p = index.select("id", "key", "lo", "hi"), probe.select("id", "key", "lo", "hi")
        if not none:
            i, p = i.join(growing(busy), "key", "left_anti"), p.join(growing(busy), "key", "left_anti")
        i = i.select(F.col("id").alias("a"), "key", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        p = p.select(F.col("id").alias("b"), "key", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        apart = F.bit_count(F.col("alo").bitwiseXOR(F.col("blo"))) + F.bit_count(F.col("ahi").bitwiseXOR(F.col("bhi")))
        found.append(cut(i.join(growing(p), "key").where(F.col("a") < F.col("b")).where(apart <= 2 * GRAM * d).select("a", "b").distinct()))
        if none:
            break
        rest = F.expr("concat(substring(s, 1, start), substring(s, start + width + 1))")

        def again(side: DataFrame, busy: DataFrame = busy) -> DataFrame:
            return cut(side.join(growing(busy), "key").select("id", rest.alias("s"), "lo", "hi", F.col("key").alias("g")).distinct())

        rows, probes = again(index), again(probe)
    pairs = reduce(DataFrame.union, found)
    pairs = pairs.distinct() if len(found) > 1 else pairs
    return with_distance(with_texts(pairs, distinct), d)


def with_texts(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(a, b, sa, sb)`` of ``(a, b)``."""
    a, b = (growing(distinct.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))) for x in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b")


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, s, n)``: one row for each different cleaned text, under its smallest id."""
    s = df.select(F.col(id_col).alias("ord"), cleaned(F.col(text_col)).alias("s")).where("s is not null and s <> ''")
    return s.groupBy("s").agg(F.min("ord").alias("id"), F.count("*").alias("n")).select("id", "s", "n")


def members(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(ord, id)``: the representative of every record."""
    s = df.select(F.col(id_col).alias("ord"), cleaned(F.col(text_col)).alias("s"))
    return s.join(growing(distinct.select("s", "id")), "s").select("ord", "id")


def near_duplicate_pairs(df: DataFrame, id_col: str = "ord", text_col: str = "anchor", d: int = 4, block: int = 1024) -> DataFrame:
    """Every pair of different records within ``d`` edits, equal cleaned texts included.

    Records whose cleaned text is null or empty are left out; ids must be unique; other columns
    are ignored whatever their names. Columns ``<id>_a < <id>_b``.
    """
    u = cut(distinct_texts(df, id_col, text_col))
    m = cut(members(df, u, id_col, text_col))
    links = close_pairs(u.select("id", "s"), d).select("a", "b")
    across = links.join(growing(m.toDF("x", "a")), "a").join(growing(m.toDF("y", "b")), "b").select("x", "y")
    # copies of one text meet block by block, so that no text is one task
    many = u.where("n > 1").select("id", F.ceil(F.col("n") / block).cast("int").alias("k"))
    copies = m.join(growing(many), "id").withColumn("blk", F.pmod(F.xxhash64("ord"), F.col("k")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    one = copies.select("id", F.col("ord").alias("x"), F.col("blk").alias("i"), others.alias("j"))
    two = copies.select("id", F.col("ord").alias("y"), F.col("blk").alias("j"), others.alias("i"))
    within = one.join(growing(two), ["id", "i", "j"]).where("x < y").select("x", "y")
    both = across.union(within)
    return both.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def near_duplicate_groups(df: DataFrame, id_col: str = "ord", text_col: str = "anchor", d: int = 4) -> DataFrame:
    """One row for each record: the class it belongs to (smallest id in it), the size of the class
    in records and the number of other records it is linked to. Copies are counted, not expanded.
    """
    u = cut(distinct_texts(df, id_col, text_col))
    links = cut(close_pairs(u.select("id", "s"), d).select("a", "b"))
    comp = connected_components(links, "a", "b")
    n = u.select(F.col("id").alias("b"), "n")
    both = links.union(links.select("b", "a"))
    degree = both.join(growing(n), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "id")
    per = (
        u.join(growing(comp), "id", "left")
        .join(growing(degree), "id", "left")
        .select("id", "n", F.coalesce("component", "id").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    )
    sizes = per.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    per = per.join(growing(sizes), "class_id")
    return members(df, u, id_col, text_col).join(growing(per), "id").select(F.col("ord").alias(id_col), "class_id", "class_size", "links")

"""Power iteration on a weighted graph: whole components meet in one task, which makes every step.

A step never leaves a component; only two numbers of it count for all of them, the sum of the vector
and how far it moved. So components are packed, few rows of many edges each, and three passes over
those give the sums, the moves and the vector: nothing is shuffled from step to step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import connected_components
from helixframe.runtime import cut, drop, growing

#: Directed edges of a packed row, about; a component of more than the second makes its steps as joins.
PART, LARGE = 1 << 20, 1 << 22


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst, weight) of whole components -> one row of the ids and of the edges by their numbers."""
    t = [[b.column(c).to_numpy() for c in ("src", "dst", "weight")] for b in batches if b.num_rows]
    if not t:
        return
    src, dst, weight = (np.concatenate(x) for x in zip(*t, strict=True))
    ids, i = np.unique(src, return_inverse=True)
    cells = (ids, i.astype(np.int32), np.searchsorted(ids, dst).astype(np.int32), weight)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], ["ids", "i", "j", "w"])


def _walk(row: dict, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids of a row, and the vector at the start (the degrees) and after each step, not normalised."""
    ids, w = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["w"])
    i, j = np.frombuffer(row["i"], np.int32), np.frombuffer(row["j"], np.int32)
    degree = np.bincount(i, w, len(ids))
    out = [degree]
    for _ in range(steps):
        out.append(np.bincount(i, w * out[-1][j], len(ids)) / degree)
    return ids, out


def _summed(packed: DataFrame, steps: int, f) -> np.ndarray:
    """Sum over all rows of what ``f`` makes of the vectors of a row, a number for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(steps + 1), pa.int32()), pa.array(f(_walk(row, steps)[1]), pa.float64())], ["t", "x"])

    got = packed.mapInArrow(run, "t int, x double").groupBy("t").agg(F.sum("x")).collect()
    out = np.zeros(steps + 1)
    for t, x in got:
        out[t] = x
    return out


def _joined(sym: DataFrame, steps: int) -> DataFrame:
    """``(id, xs)``: the same by joins, for components too large for one task."""
    degree = cut(sym.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))
    now = cut(degree.select("id", "degree", F.array("degree").alias("xs")))
    for _ in range(steps):
        x = now.select(F.col("id").alias("dst"), F.element_at("xs", -1).alias("x"))
        new = sym.join(growing(x), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        old, now = now, cut(now.join(growing(new), "id").select("id", "degree", F.concat("xs", F.array(F.col("x") / F.col("degree"))).alias("xs")))
        drop(old)
    drop(degree)
    return now.select("id", "xs")


def power_vector(edges: DataFrame, steps: int = 20) -> DataFrame:
    """``(id, v)`` of the ends of ``(src, dst, weight)``: the degrees, multiplied by the weights over
    the degrees and divided by their sum in each step. Ids are long, weights positive.

    As in Spark ML's power iteration clustering, the end is after ``steps``, or when the sum of all
    moves changes by less than 1e-5 over the number of ids (1e-8 at least).
    """
    e = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    comp = cut(connected_components(e, "src", "dst").select(F.col("id").alias("src"), "component"))
    sym = cut(e.union(e.select("dst", "src", "weight")).join(growing(comp), "src"))
    large = cut(sym.groupBy("component").count().where(F.col("count") > LARGE).select("component"))
    total, none = sym.count(), large.isEmpty()
    small = sym if none else sym.join(growing(large), "component", "left_anti")
    parts = max(-(-total // PART), 1)
    packed = cut(small.repartition(parts, "component").select("src", "dst", "weight").mapInArrow(_pack, "ids binary, i binary, j binary, w binary"))
    apart = None if none else _joined(sym.join(growing(large), "component", "left_semi"), steps)
    drop(sym)
    n = comp.count()

    def total_of(f, of_column) -> np.ndarray:
        out = _summed(packed, steps, f)
        if apart is not None:
            out += np.array(apart.agg(*[F.sum(of_column(t)).alias(f"t{t}") for t in range(steps + 1)]).first(), float)
        return out

    norm = total_of(lambda xs: [x.sum() for x in xs], lambda t: F.col("xs")[t])
    moved = total_of(
        lambda xs: [0.0, *(np.abs(b / q - a / p).sum() for a, b, p, q in zip(xs, xs[1:], norm, norm[1:], strict=False))],
        lambda t: F.abs(F.col("xs")[t] / float(norm[t]) - F.col("xs")[t - 1] / float(norm[t - 1])) if t else F.lit(0.0),
    )
    least, end = max(1e-5 / max(n, 1), 1e-8), steps
    for t in range(2, steps + 1):
        if abs(moved[t] - moved[t - 1]) <= least:
            end = t
            break
    sum_of = float(norm[end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, xs = _walk(row, end)
                yield from pa.table({"id": ids, "v": xs[-1] / sum_of}).to_batches(1 << 16)

    out = packed.mapInArrow(run, "id long, v double")
    return out if apart is None else out.union(apart.select("id", (F.col("xs")[end] / sum_of).alias("v")))

"""Cross-validation of multinomial lassos: all folds and penalties descend in the same passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.runtime import cut, drop

#: Cells of a block of rows, and of all models that descend together (32 MB are sent to each task).
BLOCK, TOGETHER = 2_000_000, 4_000_000
#: Sums of more tasks than this are added up in tasks before they come to the driver.
FAN_IN = 64


def _blocks(d: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Standardised rows of ``(x, y, fold)``, with a column of ones, as matrices of many rows."""
    width = len(mean)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // (width + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = (part.column("x").flatten().to_numpy().reshape(part.num_rows, width) - mean) * scale
                x = np.hstack([x, np.ones((len(x), 1))])
                y, fold = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("y", "fold"))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, fold)], ["x", "y", "fold"])

    return d.select("x", "y", "fold").mapInArrow(pack, "x binary, y binary, fold binary")


def _total(blocks: DataFrame, f, parts: int) -> np.ndarray:
    """Sum of the arrays ``f(x, y, fold)`` of all blocks; each task adds up its own first."""

    def add(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for a in arrays:
            total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        yield from add(f(np.frombuffer(r["x"]).reshape(len(r["y"]) // 4, -1), np.frombuffer(r["y"], np.int32), np.frombuffer(r["fold"], np.int32)).ravel() for r in rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(np.frombuffer(x.as_py()) for b in batches for x in b.column("g"))

    sums = blocks.mapInArrow(own, "g binary")
    if parts > FAN_IN:
        sums = sums.repartition(int(parts**0.5)).mapInArrow(again, "g binary")
    return sum(np.frombuffer(r["g"]) for r in sums.collect())


def right_of_path(d: DataFrame, mean: np.ndarray, std: np.ndarray, n_classes: int, path: list[float], sizes: dict[int, int], steps: int = 60, tolerance: float = 1e-3) -> list[int]:
    """How many rows of ``(x array, y, fold)`` the model fitted without their fold gets right, for
    each penalty of the descending ``path``.

    ``sizes`` are the rows of each fold. Accelerated proximal gradients on features standardised
    over all folds; one pass over the data serves every fold and as many penalties as
    :data:`TOGETHER` allows, the next ones start where these ended. The number of jobs depends
    neither on the folds nor on the rows.
    """
    width, folds, every = len(mean) + 1, sorted(sizes), sum(sizes.values())
    table = cut(_blocks(d, mean, np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)))
    parts = d.rdd.getNumPartitions()
    blocks = table.coalesce(parts).persist()

    v = np.random.default_rng(1).normal(size=width)
    for _ in range(10):
        v /= np.linalg.norm(v)
        v = _total(blocks, lambda x, y, fold, v=v: x.T @ (x @ v), parts)
    steepest = 1.1 * float(np.linalg.norm(v)) / 2  # a bound of the curvature of the summed loss

    per = max(1, TOGETHER // (width * n_classes * len(folds)))
    hits: list[int] = []
    w = np.zeros((width, len(folds), 1, n_classes))
    for lo in range(0, len(path), per):
        some = np.array(path[lo : lo + per])
        shape = (width, len(folds), len(some), n_classes)
        w = np.repeat(w[:, :, -1:], len(some), axis=2)
        rest = np.array([every - sizes[f] for f in folds], float)[:, None, None]
        shrink = np.broadcast_to(some[None, :, None] * rest / steepest, shape[1:])
        at, ahead = w, np.ones(shape[1:3])

        def slope(x, y, fold, at=at):
            z = (x @ at.reshape(width, -1)).reshape(len(x), *at.shape[1:])
            q = np.exp(z - z.max(-1, keepdims=True))
            q /= q.sum(-1, keepdims=True)
            q[np.arange(len(x)), :, :, y] -= 1
            q *= (fold[:, None] != np.array(folds)[None, :])[:, :, None, None]
            return x.T @ q.reshape(len(x), -1)

        for _ in range(steps):
            g = _total(blocks, lambda x, y, fold, at=at, slope=slope: slope(x, y, fold, at), parts).reshape(shape)
            new = at - g / steepest
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - shrink, 0)
            back = ((at - new) * (new - w)).sum((0, 3)) > 0  # too far ahead: start anew from here
            then = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * ahead**2)) / 2)
            push = np.where(back, 0.0, (ahead - 1) / then)
            moved = float(np.abs(new - w).max())
            at, w, ahead = new + push[None, :, :, None] * (new - w), new, then
            if moved <= tolerance * max(1.0, float(np.abs(w).max())):
                break

        def right(x, y, fold, w=w):
            guess = (x @ w.reshape(width, -1)).reshape(len(x), *w.shape[1:]).argmax(-1)
            own = fold[:, None] == np.array(folds)[None, :]
            return ((guess == y[:, None, None]) & own[:, :, None]).sum((0, 1)).astype(float)

        hits += [int(h) for h in _total(blocks, right, parts)]
    blocks.unpersist()
    drop(table)
    return hits

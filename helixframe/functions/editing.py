"""Edit distances of many pairs at once, for Arrow batches inside a task.

One bit of a 64-bit word stands for each letter of the shorter string (bit-parallel dynamic
programming after Myers and Hyyrö); the words of all pairs advance together, one letter of the
longer string at a time. Longer strings take several words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a word, and pairs that advance together.
WORD, STEP = 64, 1 << 12


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column and the offsets between them."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _grid(col: pa.Array, width: int, code: np.ndarray) -> np.ndarray:
    """One row of ``width`` codes for each string; 255 behind its end."""
    data, _ = flat_bytes(pc.ascii_rpad(col, width, padding="\0"))
    return code[data].reshape(len(col), width)


def _advance(short: np.ndarray, m: np.ndarray, long: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    rows, words = np.arange(len(m)), short.shape[1] // WORD
    bits = [np.packbits(short == c, axis=1, bitorder="little").view(np.uint64) for c in range(kinds)]
    here = np.stack([*bits, np.zeros((len(m), words), np.uint64)])
    one, high, none = np.uint64(1), np.uint64(WORD - 1), np.uint64(0)
    up, down = np.full((words, len(m)), ~none), np.zeros((words, len(m)), np.uint64)
    top, last = ((np.maximum(m, 1) - 1) % WORD).astype(np.uint64), (np.maximum(m, 1) - 1) // WORD
    score, out = m.astype(np.int32), np.where(n == 0, m, 0).astype(np.int32)
    for j in range(int(n.max(initial=0))):
        letter = np.minimum(long[:, j], kinds)
        more, less = one, none  # carried into the lowest word: the first row counts up
        for w in range(words):
            eq = here[letter, rows, w]
            x = eq | down[w]
            eq = eq | less
            h = (((eq & up[w]) + up[w]) ^ up[w]) | eq
            plus, minus = down[w] | ~(h | up[w]), up[w] & h
            change = ((plus >> top) & one).astype(np.int32) - ((minus >> top) & one).astype(np.int32)
            score += change if words == 1 else np.where(last == w, change, 0)
            carry = (plus >> high, minus >> high) if w + 1 < words else (none, none)
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w], down[w] = minus | ~(x | plus), plus & x
            more, less = carry
        done = n == j + 1
        out[done] = score[done]
    return np.where(m == 0, n, out).astype(np.int32)


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Edit distances, byte by byte, of two columns of plain text without nulls or zero bytes."""
    swap = pc.greater(pc.binary_length(a), pc.binary_length(b))
    a, b = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
    m, n = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    letters = np.nonzero(sum(np.bincount(flat_bytes(x)[0], minlength=256) for x in (a, b)))[0]
    code = np.full(256, 255, np.uint8)
    code[letters] = np.arange(len(letters))
    out, words = np.zeros(len(m), np.int32), (np.maximum(m, 1) + WORD - 1) // WORD
    for k in np.unique(words):
        mine = np.nonzero(words == k)[0]
        for lo in range(0, len(mine), max(STEP // int(k), 1)):
            at = mine[lo : lo + max(STEP // int(k), 1)]
            rows = pa.array(at)
            short, long = _grid(a.take(rows), WORD * int(k), code), _grid(b.take(rows), max(int(n[at].max()), 1), code)
            out[at] = _advance(short, m[at], long, n[at], len(letters))
    return out


def with_distance(pairs: DataFrame, most: int) -> DataFrame:
    """``(a, b, dist)`` of ``(a, b, sa, sb)`` at most ``most`` edits apart. Strings are not null;
    lengths further apart than ``most`` are left out before anything is compared."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            d = distances(x.column("sa"), x.column("sb"))
            keep = np.nonzero(d <= most)[0]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([x.column("a").take(at), x.column("b").take(at), pa.array(d[keep])], ["a", "b", "dist"])

    near = pairs.select("a", "b", "sa", "sb").where(F.abs(F.length("sa") - F.length("sb")) <= most)
    # bytes are letters only in plain text
    plain = (F.least(F.octet_length("sa"), F.octet_length("sb")) <= WORD) & (F.octet_length("sa") == F.length("sa")) & (F.octet_length("sb") == F.length("sb"))
    fast = near.where(plain).mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, dist int")
    slow = near.where(~plain).select("a", "b", F.levenshtein("sa", "sb", most).alias("dist")).where("dist >= 0")
    return fast.union(slow)

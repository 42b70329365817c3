"""Pairs of sequences within some edits, by blocks of records that meet in one task.

Records are dealt into blocks and packed; every two blocks meet in a task of their own, which finds
candidates by keys of two pieces, verifies them and gives nothing but the pairs. So neither keys nor
candidates are ever written or sent: what is shuffled is the packed table times the number of
blocks on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.editing import WORD, _advance, flat_bytes
from helixframe.runtime import cut

#: Records of a block whose keys are indexed, and of one whose records are looked up.
BLOCK, LOOKED_UP = 1 << 18, 1 << 18
#: Tasks that a small join is spread over, with so many records at least.
SPREAD, LEAST = 24, 1 << 12
#: A key that more indexed records share is refined.
HOT = 400
#: Letters of a piece that keys read at most; cells of a table of letters or candidates.
WIDEST, CELLS = 24, 1 << 20
#: Letters of texts that are kept as a table.
SHORTER = 96

_M1, _M2, _M3 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and the offsets between them."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, _ = flat_bytes(col)
    if len(flat) > size.sum():
        flat = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(size)])


def coded(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both with the letters that occur numbered from 1, and how many there are."""
    seen = np.unique(np.concatenate([np.nonzero(np.bincount(x))[0] for x in (one, two)]))
    code = np.zeros(int(seen.max(initial=0)) + 1, np.uint8 if len(seen) < 255 else np.int32)
    code[seen] = np.arange(1, len(seen) + 1)
    return code[one], code[two], len(seen)


class Texts:
    """Strings as codes; code 0 stands behind their ends."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        self.flat, self.offs, self.size = flat, offs, np.diff(offs)
        self.tables: dict[tuple, np.ndarray] = {}

    def table(self, backwards: bool) -> np.ndarray:
        """The grid of all texts, as far as :data:`SHORTER` letters."""
        if ("t", backwards) not in self.tables:
            width = min(int(self.size.max(initial=0)), SHORTER)
            out = np.zeros((len(self.size), width), self.flat.dtype)
            for lo in range(0, len(out), 1 << 15):
                out[lo : lo + (1 << 15)] = self.grid(np.arange(lo, min(lo + (1 << 15), len(out))), width, backwards)
            self.tables["t", backwards] = out
        return self.tables["t", backwards]

    def bits(self, kinds: int, backwards: bool) -> np.ndarray:
        """Where each letter stands among the first 64 of each text; a column for each code."""
        if ("b", backwards) not in self.tables:
            g = self.table(backwards)[:, :WORD]
            out = np.zeros((len(g), kinds + 1), np.uint64)
            flat, row = out.reshape(-1), np.arange(len(g)) * (kinds + 1)
            for k in range(g.shape[1]):
                flat[row + g[:, k]] |= np.uint64(1) << np.uint64(k)
            out[:, 0] = 0
            self.tables["b", backwards] = out
        return self.tables["b", backwards]

    def grams(self, width: int, backwards: bool, kind: np.ndarray) -> np.ndarray:
        """How often two letters follow each other in the first ``width`` (at most SHORTER) of each
        text, by 16 kinds (``kind`` has 0 to 3 for each code): a bit for the first four times of each.
        An edit changes four bits at most, even if as many letters are read of the changed text."""
        if ("g", width, backwards) not in self.tables:
            g = self.table(backwards)[:, :width]
            levels = [np.zeros(len(g), np.uint64) for _ in range(4)]
            for k in range(g.shape[1] - 1):
                inside = g[:, k + 1] > 0
                more = inside.astype(np.uint64) << (kind[g[:, k]] * np.uint64(4) + kind[g[:, k + 1]])
                for i, level in enumerate(levels):
                    levels[i], more = level | more, level & more
            self.tables["g", width, backwards] = sum(level << np.uint64(16 * i) for i, level in enumerate(levels))
        return self.tables["g", width, backwards]

    def grid(self, rows: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
        size, at = self.size[rows], np.arange(width)
        place = (self.offs[rows + 1][:, None] - 1 - at) if backwards else (self.offs[rows][:, None] + at)
        inside = at < size[:, None]
        if not len(self.flat):
            return np.zeros((len(rows), width), np.int32)
        return np.where(inside, self.flat[np.where(inside, place, 0)], 0).astype(np.int32)

    def without(self, rows: np.ndarray, cuts: np.ndarray, w: int) -> Texts:
        """The texts of ``rows`` without the ``w`` letters at each place of ``cuts`` (a row each)."""
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        keep = np.ones(len(row), bool)
        for c in cuts.T:
            keep &= (at < c[row]) | (at >= c[row] + w)
        left = np.bincount(row[keep], minlength=len(rows))
        return Texts(self.flat[self.offs[rows][row[keep]] + at[keep]], np.concatenate([[0], np.cumsum(left)]))

    def distinct(self) -> tuple[Texts, np.ndarray]:
        """Different texts, and the number of its text for each row."""
        seen: dict[bytes, int] = {}
        own = np.array([seen.setdefault(self.flat[a:b].tobytes(), len(seen)) for a, b in zip(self.offs[:-1], self.offs[1:], strict=True)], np.int64)
        first = np.unique(own, return_index=True)[1] if len(own) else own
        return self.without(first, np.zeros((len(first), 0), np.int64), 0), own


def _scan(bits: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, m: np.ndarray, n: np.ndarray | None, steps: int) -> np.ndarray:
    """Edit distances of the first m <= 64 letters of the texts i, given as bits, to the first n of
    the texts j, or without n the least of those to any first letters, up to ``steps`` of them."""
    one, out = np.uint64(1), np.empty(len(i), np.int32)
    flat, wide, step = bits.ravel(), bits.shape[1], 4096
    for lo in range(0, len(i), step):
        base, size = i[lo : lo + step] * wide, m[lo : lo + step]
        text = np.ascontiguousarray(table[j[lo : lo + step], :steps].T)
        top = (np.maximum(size, 1) - 1).astype(np.uint64)
        up, down = np.full(len(base), ~np.uint64(0)), np.zeros(len(base), np.uint64)
        score = size.astype(np.int64)
        ends = None if n is None else n[lo : lo + step]
        got = score.copy()
        for k in range(len(text)):
            eq = flat[base + text[k]]
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus, minus = down | ~(h | up), up & h
            score += ((plus >> top) & one).view(np.int64)
            score -= ((minus >> top) & one).view(np.int64)
            plus = (plus << one) | one
            up, down = (minus << one) | ~(x | plus), plus & x
            if ends is None:
                np.minimum(got, score, out=got)
            else:
                np.copyto(got, score, where=ends == k + 1)
        out[lo : lo + step] = got if ends is None else np.where(size == 0, ends, got)
    return out


def distance_of(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, kinds: int) -> np.ndarray:
    """Edit distances of the texts i of a and j of b."""
    out = np.zeros(len(i), np.int32)
    quick = (a.size[i] <= WORD) & (b.size[j] <= SHORTER)
    if quick.any():
        x, y = i[quick], j[quick]
        out[quick] = _scan(a.bits(kinds, False), b.table(False), x, y, a.size[x], b.size[y], int(b.size[y].max()))
    if not quick.all():
        out[~quick] = _long(a, b, i[~quick], j[~quick], kinds)
    return out


def _long(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, kinds: int) -> np.ndarray:
    out = np.zeros(len(i), np.int32)
    swap = a.size[i] > b.size[j]
    m, n = np.where(swap, b.size[j], a.size[i]), np.where(swap, a.size[i], b.size[j])
    words = (np.maximum(m, 1) + 63) // 64
    for k in np.unique(words):
        mine = np.nonzero(words == k)[0]
        step = max(4096 // int(k), 1)
        for lo in range(0, len(mine), step):
            at = mine[lo : lo + step]
            s, width, wide = swap[at][:, None], 64 * int(k), max(int(n[at].max()), 1)
            w = max(width, wide)
            x, y = a.grid(i[at], w), b.grid(j[at], w)
            short, long = np.where(s, y, x)[:, :width], np.where(s, x, y)[:, :wide]
            # code 0 lies behind the end: no letter of its own
            out[at] = _advance(np.where(short > 0, short - 1, -1), m[at], np.where(long > 0, long - 1, kinds), n[at], kinds)
    return out


def halves(d: int) -> list[int]:
    """Edits of the two halves: of d edits, one half has no more than its number."""
    return [x for x in (d // 2, d - 1 - d // 2) if x >= 0]


def piece(size: int, d: int) -> int:
    """Letters of a piece of a text of so many letters; 0 if there are too few."""
    return size // sum(x + 2 for x in halves(d))


def _slots(d: int) -> list[tuple[int, int, int]]:
    return [(h, i, j) for h, x in enumerate(halves(d)) for i in range(x + 2) for j in range(i + 1, x + 2)]


def _rolled(grid: np.ndarray, w: int) -> np.ndarray:
    """Hash of the ``w`` letters (at most ``WIDEST``) from each place on, a row for each place."""
    w = min(w, WIDEST)
    n = max(grid.shape[1] - w + 1, 0)
    turned = np.ascontiguousarray(grid.T).astype(np.uint64) + np.uint64(1)
    h = np.zeros((n, len(grid)), np.uint64)
    for k in range(w):
        h = h * _M1 + turned[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one * _M3 + two) * _M2


def _portions(size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in portions of texts of about one length."""
    order, lo = np.argsort(size, kind="stable"), 0
    while lo < len(order):
        step = max(1, CELLS // max(int(size[order[lo]]), 32))
        step = max(1, min(step, CELLS // max(int(size[order[min(lo + step, len(order)) - 1]]), 32)))
        yield order[lo : lo + step]
        lo += step


class _Index:
    """Keys of the pieces of texts with pieces of ``w`` letters: for each slot its records by key."""

    def __init__(self, texts: Texts, rows: np.ndarray, w: int, d: int, hot: int):
        self.bits = int(max(len(rows), 2) - 1).bit_length() + 1
        keys = {s: np.zeros(len(rows), np.uint64) for s in _slots(d)}
        for p in _portions(texts.size[rows]):
            width = int(texts.size[rows[p]].max())
            for h in range(len(halves(d))):
                rolled = _rolled(texts.grid(rows[p], width, h == 1), w)
                for s in keys:
                    if s[0] == h:
                        keys[s][p] = _pair(rolled[s[1] * w], rolled[s[2] * w])
        self.slots, self.busy = {}, {}
        for s, key in keys.items():
            by = np.argsort(key)
            own, first, count = np.unique(key[by], return_index=True, return_counts=True)
            many = count > max(hot, 16 * len(key) / len(own))
            if many.any():
                self.busy[s] = {int(k): rows[by[f : f + c]] for k, f, c in zip(own[many], first[many], count[many], strict=True)}
                by = by[~np.isin(key[by], own[many])]
            key = key[by]
            place = (key >> np.uint64(64 - self.bits)).astype(np.int64)
            start = np.searchsorted(place, np.arange((1 << self.bits) + 1)).astype(np.int32)
            self.slots[s] = key, rows[by].astype(np.int32), start

    def look(self, s: tuple[int, int, int], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the given keys and the records that have them."""
        own, rows, start = self.slots[s]
        place = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        first = start[place]
        count = start[place + 1] - first
        hit = np.nonzero(count)[0]
        count = count[hit]
        at = np.repeat(hit, count)
        where = np.repeat(first[hit] - np.cumsum(count) + count, count) + np.arange(len(at))
        same = own[where] == key[at]
        return at[same], rows[where[same]]


def block_pairs(a: Texts, b: Texts, d: int, kinds: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, dist)`` of all texts i of a and j of b within ``d`` edits, each once.

    Of an alignment of at most d edits, either what lies over the first pieces of a has d // 2
    edits at most or the rest has d - 1 - d // 2. The first lies at the start of both texts, the
    rest at their ends, where everything is read backwards. A half of x edits holds x + 2 pieces, of
    which two stay unchanged: counting pieces less edits, take the last piece that brings the count
    to 1 and the last that brings it to 2. Before the first, i, lie exactly i edits, between it and
    the second, j, exactly j - 1 - i, which bounds both moves; the key is both pieces.

    A key that more than ``hot`` texts of a share (and sixteen times as many as usual) is taken out:
    its texts meet without the two pieces, whose rests are within d edits too, in the same way, so
    nothing is dropped. Texts too short for pieces meet all texts of about their length.
    """
    codes: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = np.int64(max(len(b.size), 1))
    waiting = 0
    kind = np.empty(kinds + 1, np.uint64)  # the four letters that are most frequent have one each
    kind[np.argsort(-np.bincount(a.flat, minlength=kinds + 1), kind="stable")] = np.arange(kinds + 1) % 4

    def settle() -> None:
        nonlocal waiting
        if codes:
            c = np.unique(np.concatenate(codes))
            codes.clear()
            waiting = 0
            i, j = c // total, c % total
            near = np.abs(a.size[i] - b.size[j]) <= d
            i, j = i[near], j[near]
            dist = distance_of(a, b, i, j, kinds)
            ok = dist <= d
            found.append((i[ok], j[ok], dist[ok]))

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal waiting
        codes.append(i.astype(np.int64) * total + j)
        waiting += len(i)
        if waiting > CELLS:
            settle()

    def half(met: list[tuple[np.ndarray, np.ndarray]], h: int, w: int, edits: int) -> None:
        """Of candidates of one half those remain whose pieces there are within its edits."""
        if met:
            i, j = (np.concatenate(x) for x in zip(*met, strict=True))
            met.clear()
            near = np.abs(a.size[i] - b.size[j]) <= d
            i, j = i[near], j[near]
            most = w * (edits + 2)
            if most <= WORD and most + edits <= SHORTER:
                near = np.bitwise_count(a.grams(most, h == 1, kind)[i] ^ b.grams(most, h == 1, kind)[j]) <= 4 * edits
                i, j = i[near], j[near]
                near = _scan(a.bits(kinds, h == 1), b.table(h == 1), i, j, np.full(len(i), most), None, most + edits) <= edits
                i, j = i[near], j[near]
            meet(i, j)

    own_w = np.array([piece(int(n), d) for n in range(int(a.size.max(initial=0)) + 1)], np.int64)[a.size] if len(a.size) else np.zeros(0, np.int64)
    index = {int(w): _Index(a, np.nonzero(own_w == w)[0], int(w), d, hot) for w in np.unique(own_w) if w}
    short = np.nonzero(own_w == 0)[0]
    busy: dict[tuple, list[tuple[np.ndarray, int, int]]] = {}
    for p in _portions(b.size):
        low, high = int(b.size[p].min(initial=0)) - d, int(b.size[p].max(initial=0)) + d
        for h, edits in enumerate(halves(d)):
            grid = None
            for w, ix in index.items():
                if not any(piece(n, d) == w for n in range(max(low, 0), high + 1)):
                    continue
                grid = b.grid(p, high - d, h == 1) if grid is None else grid
                rolled = _rolled(grid, w)
                met: list[tuple[np.ndarray, np.ndarray]] = []
                for i in range(edits + 2):
                    for x in range(-i, i + 1):
                        at = i * w + x
                        if not 0 <= at < len(rolled):
                            continue
                        for j in range(i + 1, edits + 2):
                            for y in range(-(j - 1 - i), j - i):
                                to = j * w + x + y
                                if not at + w <= to < len(rolled):
                                    continue
                                key, s = _pair(rolled[at], rolled[to]), (h, i, j)
                                hit, rows = ix.look(s, key)
                                if len(hit):
                                    met.append((rows, p[hit]))
                                if sum(len(x) for x, _ in met) > CELLS:
                                    half(met, h, w, edits)
                                if s in ix.busy:
                                    shared = np.array(list(ix.busy[s]), np.uint64)
                                    for k in np.unique(key[np.isin(key, shared)]):
                                        busy.setdefault((w, s, int(k)), []).append((p[key == k], at, to))
                half(met, h, w, edits)
        if len(short):
            fits = short[(a.size[short] >= low) & (a.size[short] <= high)]
            for row in fits:
                meet(np.full(len(p), row), p)
        settle()

    for (w, s, k), hits in busy.items():
        # places from the end are turned to places from the start; a piece starts at its lowest letter
        turn = lambda size, at: (size - at - w) if s[0] == 1 else np.full(len(size), at)  # noqa: B023, E731
        ra = index[w].busy[s][k]
        rb, cuts = np.concatenate([r for r, _, _ in hits]), np.concatenate([np.stack([turn(b.size[r], x), turn(b.size[r], y)], 1) for r, x, y in hits])
        inside = (cuts >= 0).all(1) & (cuts + w <= b.size[rb][:, None]).all(1)
        rb, cuts = rb[inside], cuts[inside]
        one, of_a = a.without(ra, np.stack([turn(a.size[ra], s[1] * w), turn(a.size[ra], s[2] * w)], 1), w).distinct()
        two, of_b = b.without(rb, cuts, w).distinct()
        ia, ib, _ = block_pairs(one, two, d, kinds, hot)
        for lo in range(0, len(ia), 4096):
            x, y = expand(ia[lo : lo + 4096], ib[lo : lo + 4096], of_a, of_b)
            meet(ra[x], rb[y])
    settle()
    i, j, dist = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    one = np.unique(i * total + j, return_index=True)[1]
    return i[one], j[one], dist[one].astype(np.int32)


def expand(i: np.ndarray, j: np.ndarray, of_i: np.ndarray, of_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows with the texts i against all with the texts j."""
    by_i, by_j = np.argsort(of_i, kind="stable"), np.argsort(of_j, kind="stable")
    fi, fj = np.searchsorted(of_i[by_i], i), np.searchsorted(of_j[by_j], j)
    ci, cj = np.searchsorted(of_i[by_i], i, "right") - fi, np.searchsorted(of_j[by_j], j, "right") - fj
    each = ci * cj
    at = np.repeat(np.arange(len(i)), each)
    k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    return by_i[fi[at] + k // cj[at]], by_j[fj[at] + k % cj[at]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, s, blk) -> (blk, rows): the records of each block, compressed."""
    waiting: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        waiting.clear()
        blk = table.column("blk").to_numpy()
        for k in np.unique(blk):
            sink = pa.BufferOutputStream()
            part = table.select(["id", "s"]).take(pa.array(np.nonzero(blk == k)[0])).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blk", "rows"])

    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= 1 << 18:
            yield from out()
    if waiting:
        yield from out()


def _packed(side: DataFrame, blocks: int) -> DataFrame:
    return side.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).mapInArrow(_pack, "blk int, rows binary")


def _parts(n: int, block: int, spread: int) -> int:
    return max(1, -(-n // block), min(spread, n // LEAST))


def joined(left: DataFrame, right: DataFrame | None, d: int, hot: int = HOT) -> DataFrame:
    """``(a, b, dist)`` of ``left(id, s)`` and ``right(id, s)`` within ``d`` edits; without
    ``right`` the pairs of left with itself, a < b. Null texts match nothing."""
    left = cut(left.where("s is not null"))
    n = left.count()
    if right is not None:
        right = cut(right.where("s is not null"))
        looked_up = right.count()
        if looked_up < n:
            return _met(right, left, looked_up, n, d, hot).select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")
        return _met(left, right, n, looked_up, d, hot)
    # of two blocks each pair is found once, in a block twice
    met = _met(left, None, n, n, d, hot).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").distinct()


def _met(left: DataFrame, right: DataFrame | None, n: int, looked_up: int, d: int, hot: int) -> DataFrame:
    kind = left.schema["id"].dataType.simpleString()
    if right is None:
        # b blocks make b (b + 1) / 2 tasks
        b = _parts(n, BLOCK, 6)
        other = kind
        p = cut(_packed(left, b))
        up = F.explode(F.sequence(F.lit(0), F.col("blk")))
        down = F.explode(F.sequence(F.col("blk"), F.lit(b - 1)))
        one = p.select(F.col("blk").alias("i"), down.alias("j"), F.lit(0).alias("side"), "rows")
        two = p.select(up.alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "rows")
        task = (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int")
        tasks = b * (b + 1) // 2
    else:
        other = right.schema["id"].dataType.simpleString()
        nl = _parts(n, BLOCK, 1)
        nr = _parts(looked_up, LOOKED_UP, -(-SPREAD // nl))
        to = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        one = _packed(left, nl).select(F.col("blk").alias("i"), to(nr).alias("j"), F.lit(0).alias("side"), "rows")
        two = _packed(right, nr).select(to(nl).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "rows")
        task = F.col("i") * nr + F.col("j")
        tasks = nl * nr

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.Table]] = {0: [], 1: []}
        for batch in batches:
            for side, rows in zip(batch.column("side").to_pylist(), batch.column("rows"), strict=True):
                parts[side].append(pa.ipc.open_stream(rows.as_buffer()).read_all())
        if not parts[0] or not parts[1]:
            return
        t = [pa.concat_tables(parts[k]).combine_chunks() for k in (0, 1)]
        parts.clear()
        (fa, oa), (fb, ob) = (letters(x.column("s")) for x in t)
        fa, fb, kinds = coded(fa, fb)
        i, j, dist = block_pairs(Texts(fa, oa), Texts(fb, ob), d, kinds, hot)
        ia, ib = t[0].column("id").combine_chunks(), t[1].column("id").combine_chunks()
        out = pa.table({"a": ia.take(pa.array(i)), "b": ib.take(pa.array(j)), "dist": pa.array(dist, pa.int32())})
        yield from out.to_batches(1 << 16)

    return one.union(two).repartitionById(tasks, task).select("side", "rows").mapInArrow(run, f"a {kind}, b {other}, dist int")

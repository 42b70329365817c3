"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

Each text is cut into words by the tokenizer's pattern, and words once more between two bytes that
stand side by side in no token at all, where nothing can merge. In every task the different words
go in batches, as token-position rows, to a recursive DuckDB query that joins neighbouring tokens
with the merge table and contracts each piece's leftmost pair of minimum rank until nothing
merges. The ids of the words are then laid out in text order. No shuffle, no row leaves its task.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published word pattern of this tokenizer family.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker keeps with their ids between batches; beyond it the memory starts anew. It
#: bounds memory only, no word is left out.
KEPT_WORDS = 300_000
#: Bytes of words encoded by one recursive query, and letters of text handled at a time.
QUERY_BYTES, STEP_LETTERS = 1 << 19, 1 << 20
#: Pieces of more bytes contract all places of their best pair in one step instead of the leftmost,
#: with equal results; they too go in batches.
LONG = 64

#: A row is one token of a word; ``r`` orders the pairs of a word by rank, then place.
CONTRACT = """
WITH RECURSIVE step(w, p, tok, done) AS (
    SELECT w, p, tok, false FROM base
  UNION ALL
    SELECT w, p, CASE WHEN r = best THEN new ELSE tok END, best IS NULL
    FROM (
        SELECT w, p, tok, r, min(r) OVER word AS best, arg_min(id, r) OVER word AS new,
               lag(r) OVER (PARTITION BY w ORDER BY p) AS before
        FROM (
            SELECT s.w, s.p, s.tok, m.rank * 1048576 + s.p AS r, m.id
            FROM (SELECT w, p, tok, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM step WHERE NOT done) s
            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
        )
        WINDOW word AS (PARTITION BY w)
    )
    WHERE best IS NULL OR before IS DISTINCT FROM best
)
SELECT w, p, tok FROM step WHERE done ORDER BY w, p
"""

#: The same for long words. A run of overlapping places of the best pair merges every second one,
#: as taking the leftmost again and again would: a merged token makes only pairs of higher rank.
CONTRACT_LONG = """
WITH RECURSIVE step(w, p, tok, done) AS (
    SELECT w, p, tok, false FROM base
  UNION ALL
    SELECT w, p, CASE WHEN hit AND nth % 2 = 1 THEN id ELSE tok END, best IS NULL
    FROM (
        SELECT *, lag(hit AND nth % 2 = 1) OVER (PARTITION BY w ORDER BY p) AS eaten
        FROM (
            SELECT *, row_number() OVER (PARTITION BY w, hit, run ORDER BY p) AS nth
            FROM (
                SELECT *, row_number() OVER (PARTITION BY w ORDER BY p) - row_number() OVER (PARTITION BY w, hit ORDER BY p) AS run
                FROM (
                    SELECT *, coalesce(rank = best, false) AS hit
                    FROM (
                        SELECT s.w, s.p, s.tok, m.rank, m.id, min(m.rank) OVER (PARTITION BY w) AS best
                        FROM (SELECT w, p, tok, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM step WHERE NOT done) s
                        LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
                    )
                )
            )
        )
    )
    WHERE eaten IS NOT TRUE
)
SELECT w, p, tok FROM step WHERE done ORDER BY w, p
"""

#: Pieces of each text in order; the pieces spell bytes by their printable letters.
DECODE = "SELECT d, string_agg(piece, '' ORDER BY p) AS spelt FROM ids JOIN vocab USING (tok) GROUP BY d"


def byte_letters() -> list[str]:
    """Printable letter that stands for each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the others for code points from 256 up, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def load(folder: str, name: str) -> dict:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = pa.table({
        "a": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
        "b": pa.array([vocab[b] for _, b in pairs], pa.int32()),
        "rank": pa.array(range(len(pairs)), pa.int64()),
        "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
    })
    letters = byte_letters()
    at = {c: i for i, c in enumerate(letters)}
    touch = np.zeros((256, 256), bool)  # bytes side by side in some token
    for token in vocab:
        code = [at[c] for c in token if c in at]
        touch[code[:-1], code[1:]] = True
    return {"merges": merges, "byte": np.array([vocab[c] for c in letters], np.int32), "vocab": vocab, "letters": letters, "touch": touch}


class Encoder:
    """One per worker process: the merge table in DuckDB and the words met so far."""

    _of: dict[tuple[str, str], Encoder] = {}

    def __init__(self, folder: str, name: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(WORDS).findall
        self.model = load(folder, name)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        self.con.register("m", self.model["merges"])
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.ids: dict[str, np.ndarray] = {}

    @classmethod
    def get(cls, folder: str, name: str) -> Encoder:
        if (folder, name) not in cls._of:
            cls._of[folder, name] = cls(folder, name)
        return cls._of[folder, name]

    def contract(self, words: list[str], raw: list[bytes], query: str) -> None:
        size = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        first = np.ones(len(data), bool)
        first[1:] = ~self.model["touch"][data[:-1], data[1:]] | (word[1:] != word[:-1])
        start = np.nonzero(first)[0]
        piece = np.cumsum(first) - 1
        place = (np.arange(len(data)) - start[piece]).astype(np.int32)
        self.con.register("base", pa.table({"w": piece.astype(np.int32), "p": place, "tok": self.model["byte"][data]}))
        got = self.con.execute(query).fetchnumpy()
        flat = np.asarray(got["tok"], np.int32)
        ends = np.searchsorted(word[start][got["w"]], np.arange(len(raw) + 1))
        self.ids.update((x, flat[a:b]) for x, a, b in zip(words, ends[:-1], ends[1:], strict=True))

    def longest(self, raw: bytes) -> int:
        """Bytes of the longest piece of a word."""
        data = np.frombuffer(raw, np.uint8)
        at = np.nonzero(~self.model["touch"][data[:-1], data[1:]])[0]
        return int(np.diff(np.concatenate([[-1], at, [len(data) - 1]])).max())

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > KEPT_WORDS:
            self.ids.clear()
            new = words
        parts: dict[str, tuple[list[str], list[bytes]]] = {CONTRACT: ([], []), CONTRACT_LONG: ([], [])}
        sizes = dict.fromkeys(parts, 0)
        for w in new:
            b = w.encode()
            query = CONTRACT_LONG if len(b) > LONG and self.longest(b) > LONG else CONTRACT
            parts[query][0].append(w)
            parts[query][1].append(b)
            sizes[query] += len(b)
            if sizes[query] > QUERY_BYTES:
                self.contract(*parts[query], query)
                parts[query], sizes[query] = ([], []), 0
        for query, (some, raw) in parts.items():
            if some:
                self.contract(some, raw, query)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.find(t) if t else [] for t in texts]
        count = np.array([len(c) for c in cut], np.int64)
        coded = pa.array([w for c in cut for w in c], pa.large_string()).dictionary_encode()
        unique = coded.dictionary.to_pylist()
        self.learn(unique)
        lists = [self.ids[w] for w in unique]
        size = np.array([len(x) for x in lists], np.int64)
        pool = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[code]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first[code], n)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pool[at]))


def _steps(size: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STEP_LETTERS letters."""
    start = total = 0
    for i, n in enumerate(size):
        total += n or 0
        if total >= STEP_LETTERS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(size):
        yield start, len(size)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, ids)``: the token ids of each text, without special tokens.

    Null and empty texts give an empty list, blank texts are encoded as they stand, and the
    strings of special tokens inside a text are ordinary text. Repeated ids or texts are encoded
    row by row; an empty table gives no rows; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(folder, name)
        for batch in batches:
            for a, b in _steps(pc.utf8_length(batch.column("text")).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), enc.encode(part.column("text").to_pylist())], ["id", "ids"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, text)``: the text spelt by each list of ids. Empty and null lists give ``""``;
    bytes that are no UTF-8 (possible only for lists that no text encodes to) become U+FFFD."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(folder, name)
        if "vocab" not in enc.model.get("tables", ()):
            items = sorted(enc.model["vocab"].items(), key=lambda x: x[1])
            enc.con.register("v", pa.table({"tok": pa.array([i for _, i in items], pa.int32()), "piece": [k for k, _ in items]}))
            enc.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
            enc.model["tables"] = ["vocab"]
        byte = {c: i for i, c in enumerate(enc.model["letters"])}
        for batch in batches:
            sizes = [4 * (n or 0) for n in pc.list_value_length(batch.column("ids")).to_pylist()]
            for a, b in _steps(sizes):
                part = batch.slice(a, b - a)
                n = np.array([x or 0 for x in pc.list_value_length(part.column("ids")).to_pylist()], np.int64)
                d = np.repeat(np.arange(len(n)), n)
                p = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                tok = pc.list_flatten(part.column("ids"))
                enc.con.register("ids", pa.table({"d": d, "p": p, "tok": tok}))
                out = [""] * len(n)
                for i, spelt in enc.con.execute(DECODE).fetchall():
                    out[i] = bytes(byte[c] for c in spelt).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.string())], ["id", "text"])

    d = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)

"""Sequence functions, all of them Column to Column and free of Python workers.

A null sequence gives null, an empty one the empty string, unless a function says otherwise.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC nucleotide letters (S, W and N stand for themselves).
BASES = "ACGTRYKMBVDHacgtrykmbvdh"
COMPLEMENTS = "TGCAYRMKVBHDtgcayrmkvbhd"

# The standard genetic code, codons in the order T, C, A, G of each place, and the
# codons in which other published tables differ from it.
ORDER = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: {}, 11: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
}
TABLE_NAMES = {
    "Standard": 1, "Vertebrate Mitochondrial": 2, "Yeast Mitochondrial": 3, "Mold Mitochondrial": 4, "Invertebrate Mitochondrial": 5, "Ciliate Nuclear": 6,
    "Echinoderm Mitochondrial": 9, "Euplotid Nuclear": 10, "Bacterial": 11, "Alternative Yeast Nuclear": 12, "Ascidian Mitochondrial": 13,
    "Alternative Flatworm Mitochondrial": 14, "Chlorophycean Mitochondrial": 16, "Trematode Mitochondrial": 21,
}
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(col(seq)), BASES, COMPLEMENTS)


def remove_n(seq: Column | str) -> Column:
    return F.translate(col(seq), "Nn", "")


def truncate(seq: Column | str, length: int | None) -> Column:
    """First ``length`` letters; None leaves the sequence as it is."""
    return col(seq) if length is None else F.substring(col(seq), 1, length)


def a_to_t(seq: Column | str) -> Column:
    return F.translate(col(seq), "Aa", "Tt")


def c_to_g(seq: Column | str) -> Column:
    return F.translate(col(seq), "Cc", "Gg")


def clean(seq: Column | str) -> Column:
    """Upper case, letters other than A, C, G, T and N taken out."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGTN]", "")


def mutate(seq: Column | str, record: Column | str, fraction: float, seed: int = 0) -> Column:
    """Complements about ``fraction`` of the upper-case bases. The draw is a hash of record,
    place and seed, so that a task that runs again gives the same result."""
    seq, record = col(seq), col(record)
    draw = lambda i: F.pmod(F.xxhash64(record, i, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return F.array_join(
        F.transform(F.split(seq, "(?!^)"), lambda b, i: F.when(draw(i), F.translate(b, "ACGT", "TGCA")).otherwise(b)), ""
    )


def jumble(seq: Column | str, *, drop_n: bool = False, backwards: bool = False, length: int | None = None, at: bool = False, cg: bool = False) -> Column:
    """The operations in their fixed order: remove N, reverse, truncate, A to T, C to G."""
    seq = col(seq)
    seq = remove_n(seq) if drop_n else seq
    seq = F.reverse(seq) if backwards else seq
    seq = truncate(seq, length)
    seq = a_to_t(seq) if at else seq
    return c_to_g(seq) if cg else seq


def codon_string(table: int | str = 1) -> str:
    """Amino acids of the 64 codons of a table, named by number or name."""
    changes = DIFFERENCES[TABLE_NAMES[table] if isinstance(table, str) else table]
    return "".join(changes.get("".join(c), aa) for c, aa in zip(product(ORDER, repeat=3), STANDARD, strict=True))


def ambiguous_codons(table: int | str = 1) -> dict[str, str]:
    """Codons with ambiguity letters of which every reading gives the same amino acid."""
    aa = dict(zip(("".join(c) for c in product(ORDER, repeat=3)), codon_string(table), strict=True))
    out = {}
    for c in product(IUPAC, repeat=3):
        read = {aa["".join(x)] for x in product(*(IUPAC[b] for b in c))}
        if len(read) == 1 and any(b not in ORDER for b in c):
            out["".join(c)] = read.pop()
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def translate(seq: Column | str, table: int | str = 1) -> Column:
    """Amino acids of the whole codons; a trailing part is dropped, unresolved codons are X.

    Codons are cut in one pass and looked up by their place in the list of all known codons, four
    letters apart; place 0, not found, reads the X in front of the amino acids. Linear in the
    length of the record; an empty sequence gives the empty string, null gives null.
    """
    plain = dict(zip(("".join(c) for c in product(ORDER, repeat=3)), codon_string(table), strict=True))
    known = {**plain, **ambiguous_codons(table)}
    codons, letters = F.lit(" ".join(known)), F.lit(("X" + "".join(known.values())).encode())
    cut = F.regexp_extract_all(F.translate(F.upper(col(seq)), " ", "?"), F.lit("(?s).{3}"), F.lit(0))
    place = lambda c: F.shiftright(F.instr(codons, c) + 3, 2) + 1
    return F.array_join(F.transform(cut, lambda c: F.substring(letters, place(c), F.lit(1)).cast("string")), "")


def frame(seq: Column | str, shift: int) -> Column:
    """The sequence from letter ``shift`` on, padded with as many N at the end."""
    return F.concat(F.substring(col(seq), shift + 1, 1 << 30), F.lit("N" * shift))


def peptide(protein: Column) -> Column:
    """Up to the first stop, X taken off both ends; shorter than 5 letters becomes X."""
    trimmed = F.regexp_replace(F.substring_index(protein, "*", 1), "^X+|X+$", "")
    return let(trimmed, lambda p: F.when(F.length(p) < 5, "X").otherwise(p))


def six_frames(seq: Column | str, table: int | str = 1) -> Column:
    """Array of (frame, protein): frames 1 to 3, then 4 to 6 of the reverse complement."""
    both = lambda s, rc: F.array(*[frame(x, i) for x in (s, rc) for i in range(3)])
    shifted = let(col(seq), lambda s: let(reverse_complement(s), lambda rc: both(s, rc)))
    return F.transform(shifted, lambda s, k: F.struct((k + 1).alias("frame"), peptide(translate(s, table)).alias("protein")))


def longest_frame(seq: Column | str, table: int | str = 1) -> Column:
    """(frame, protein) of the longest translated frame; the earliest of equal length."""
    ranked = F.transform(six_frames(seq, table), lambda x: F.struct((-F.length(x["protein"])).alias("n"), x["frame"].alias("frame"), x["protein"].alias("protein")))
    return let(F.array_min(ranked), lambda x: F.struct(x["frame"].alias("frame"), x["protein"].alias("protein")))


def stop_free(seq: Column | str, table: int | str = 1, retry: bool = True) -> Column:
    """Frame 1; if it holds a stop, frame 2; if that too holds one, frame 3."""
    one, two, three = (translate(frame(seq, i), table) for i in range(3))
    if not retry:
        return one
    unless = lambda protein, other: let(protein, lambda p: F.when(F.contains(p, F.lit("*")), other).otherwise(p))
    return unless(one, unless(two, three))

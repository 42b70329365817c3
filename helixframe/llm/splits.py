"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import connected_components
from helixframe.operators.ranking import distributed_rank
from helixframe.runtime import cut, growing

#: Fixed spellings of the three splits, compared after trimming and lower-casing.
TRAIN_NAMES = ["train", "training", "trn", "tr", "trainset"]
VAL_NAMES = ["val", "valid", "validation", "vld", "vl", "dev", "devel", "development"]
TEST_NAMES = ["test", "testing", "tst", "te", "tests"]


def donor_of(name: Column) -> Column:
    """Letters and number that open a sample name: letters in upper case, number without leading
    zeros. Null if the name is null or does not open so."""
    part = lambda i: F.regexp_extract(F.trim(name), r"^\s*([A-Za-z]+)[^A-Za-z0-9]?([0-9]+)", i)
    number = F.regexp_replace(part(2), "^0+(?=.)", "")
    return F.when(part(2) != "", F.concat(F.upper(part(1)), number))


def split_named(split: Column) -> Column:
    """train, val or test where the text names or abbreviates one of them, else null."""
    s = F.lower(F.regexp_replace(split, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""))
    s = F.regexp_replace(s, r"[\s_\-]*(set|split)$", "")
    return (
        F.when(s.isin(TRAIN_NAMES), "train").when(s.isin(VAL_NAMES), "val").when(s.isin(TEST_NAMES), "test")
    )


def components_of(df: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """``(row_id, component)``: rows that share any of the keys, directly or through other rows.

    Every key value becomes a vertex (its smallest row), every row an edge to it; a value that a
    third of all rows share is thus a star, not all pairs. Rows without any key stand alone.
    """
    rows = df.select(F.col(row_id).alias("r"), *[k.alias(f"k{i}") for i, k in enumerate(keys.values())])
    edges = None
    for i in range(len(keys)):
        own = rows.select("r", F.col(f"k{i}").alias("k")).dropna()
        hub = own.groupBy("k").agg(F.min("r").alias("h"))
        e = own.join(growing(hub), "k").select("r", "h")
        edges = e if edges is None else edges.union(e)
    comp = connected_components(edges, "r", "h")
    return rows.select("r").join(growing(comp), F.col("r") == F.col("id"), "left").select(F.col("r").alias(row_id), F.coalesce("component", "r").alias("component"))


def nearest_bit(bits: int, at: int) -> int:
    """Number of the set bit nearest to ``at``, the lower of two; bit 0 is set."""
    below = (bits & ((1 << (at + 1)) - 1)).bit_length() - 1
    above = bits >> (at + 1)
    if not above:
        return below
    up = at + 1 + (above & -above).bit_length() - 1
    return below if at - below <= up - at else up


def choose_sizes(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many components of each size to take so that the total is as near ``target`` as can be.

    ``sizes`` holds (size, multiplicity). Totals are the bits of one integer, which each size
    times 1, 2, 4 ... copies shifts and joins; it ends when the target itself is reached or no
    size is left. The total is traced back from bitsets kept at every eighth step, between which
    they are made again. Exact for any number of rows; each bitset takes target / 8 bytes.
    """
    have = sorted(((s, m) for s, m in sizes if s > 0 and m > 0), reverse=True)
    # the nearest total lies at most the target below it, or less than one component above
    top = min(2 * target, target + max([s for s, _ in have] or [0]))
    limit, reach = (1 << (top + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    kept = []
    for s, m in have:
        m, c = min(m, top // s), 1
        while m > 0 and not reach >> target & 1:
            c = min(c, m)
            if len(steps) % 8 == 0:
                kept.append(reach)
            steps.append((s, c))
            reach |= (reach << (s * c)) & limit
            m, c = m - c, c * 2
    at, take = nearest_bit(reach, target), {}
    for k in range(len(kept) - 1, -1, -1):
        part = steps[8 * k : 8 * k + 8]
        bits = [kept[k]]
        for s, c in part:
            bits.append(bits[-1] | (bits[-1] << (s * c)) & limit)
        for (s, c), before in zip(reversed(part), reversed(bits[:-1]), strict=True):
            if not before >> at & 1:
                take[s] = take.get(s, 0) + c
                at -= s * c
    return take


def assign_splits(df: DataFrame, targets: DataFrame, row_id: str = "ord", keys: dict[str, Column] | None = None, seed: int = 11) -> DataFrame:
    """``(row_id, component, split)`` for every row; rows of one component agree.

    ``targets`` has one row for each split (``split``, ``share``). Splits are filled from the
    smallest share up, the last one takes the rest. Only the table of component sizes, at most
    sqrt(2 * rows) entries, comes to the driver; which components of a size go where is decided
    by their rank in hashed order. Rows without a key are components of their own. An empty
    table gives no rows.
    """
    keys = keys or {"donor": donor_of(F.col("sample_name"))}
    comp = cut(components_of(df, row_id, keys))
    size = cut(comp.groupBy("component").agg(F.count("*").alias("size")))
    have = {int(r["size"]): int(r["n"]) for r in size.groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows = sum(s * n for s, n in have.items())
    shares = sorted(((float(r["share"]), r["split"]) for r in targets.select("split", "share").collect()))
    plan: list[tuple[int, int, str]] = []
    start = dict.fromkeys(have, 0)
    for share, name in shares[:-1]:
        took = choose_sizes(sorted(have.items()), int(share * rows + 0.5))
        for s, k in took.items():
            plan.append((s, start[s], start[s] + k, name))
            start[s] += k
            have[s] -= k
    plan += [(s, a, 1 << 62, shares[-1][1]) for s, a in start.items()]
    spark = df.sparkSession
    ranges = spark.createDataFrame(plan or [(0, 0, 0, "")], "size long, above long, upto long, split string")
    ranked = distributed_rank(size, ["size"], F.xxhash64("component", F.lit(seed)), ["component"], "rank_no")
    chosen = ranked.join(ranges, "size").where("rank_no > above and rank_no <= upto").select("component", "split")
    return comp.join(growing(chosen), "component").select(row_id, "component", "split")


def conflicts(df: DataFrame, targets: DataFrame, row_id: str = "ord") -> DataFrame:
    """``(donor, split, n_splits)`` of donors whose rows already name two or three different
    splits, with the split that :func:`assign_splits` gives them instead.

    Names are gathered over the components of that assignment. Rows without a donor are left out.
    """
    given = assign_splits(df, targets, row_id)
    d = df.select(row_id, donor_of(F.col("sample_name")).alias("donor"), split_named(F.col("split")).alias("named")).where("donor is not null")
    per = d.join(growing(given), row_id).groupBy("component").agg(F.min("donor").alias("donor"), F.min("split").alias("split"), F.count_distinct("named").alias("n_splits"))
    return per.where("n_splits >= 2").select("donor", "split", "n_splits")

"""Evaluation passages in a training corpus, by a positional inverted index.

The index holds one posting (term, document, position) for every corpus token whose term occurs
in the evaluation items; it is written once, sharded by document like the corpus itself, so that
building it shuffles nothing. Phrases are found by intersecting posting lists whose positions are
shifted by the term's place in the item: first the list of the rarest term of a run, then that of
the second rarest, and only for what is left the other places of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import checked, cut, growing, with_totals

#: A word is an unbroken run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, term)``; null texts and texts without words give no rows."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "term")).withColumn("term", F.lower("term"))


def eval_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, off, term, tid)`` of the held-out items, a set of fixed size."""
    t = tokens(items, item_col, text_col).toDF("item", "off", "term")
    return cut(t.withColumn("tid", F.dense_rank().over(Window.orderBy("term"))))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, pos, tid)``: the postings of all corpus tokens that are terms of an item."""
    vocabulary = terms.select("term", "tid").distinct()
    t = tokens(docs, id_col, text_col)
    return cut(t.join(vocabulary, "term").select(F.col("id").alias("doc"), "pos", "tid"))


def rare_runs(terms: DataFrame, index: DataFrame, run: int) -> DataFrame:
    """``(item, first, o1, t1, o2, t2)``: each run of ``run`` places with its two rarest terms
    (the same one twice if it has only one place)."""
    df = index.groupBy("tid").agg(F.count("*").alias("n"))
    t = terms.join(df, "tid", "left").select("item", "off", "tid", F.coalesce("n", F.lit(0)).alias("n"))
    top = t.groupBy("item").agg((F.max("off") + 1).alias("len"))
    t = t.join(top, "item").withColumn("first", F.explode(F.sequence(F.greatest(F.col("off") - run + 1, F.lit(0)), F.col("off"))))
    t = t.where(F.col("first") + run <= F.col("len"))
    lists = t.groupBy("item", "first").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "off", "tid"))), 1, 2).alias("r"))
    return lists.where("r[0].n > 0").select("item", "first", *[F.coalesce(F.get("r", F.lit(i)), F.col("r")[0])[c].alias(f"{p}{i + 1}") for i in (0, 1) for p, c in (("o", "off"), ("t", "tid"))])


def leaked_runs(docs: DataFrame, items: DataFrame, run: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc, item, longest)``: documents and items with ``run`` or more consecutive words in
    common, and the longest such run.

    Null and empty texts match nothing; items shorter than ``run`` words can't match. Documents
    may repeat: every doc id stands for itself. Other columns are ignored.
    """
    terms = eval_terms(items, item_col, item_text)
    index = build_index(docs, terms, doc_col, text_col)
    runs = cut(rare_runs(terms, index, run))
    first = runs.select("item", "o1", "t1").distinct()
    hit = index.join(first, F.col("tid") == F.col("t1")).select("doc", "item", "o1", (F.col("pos") - F.col("o1")).alias("diag"))
    # the second rarest term of a run, at its shifted place
    pairs = runs.select("item", "o1", "o2", "t2").distinct()
    want = hit.join(pairs, ["item", "o1"]).select("doc", "item", "diag", "o1", "o2", (F.col("diag") + F.col("o2")).alias("pos"), F.col("t2").alias("tid")).where("pos >= 0")
    second = index.join(runs.select(F.col("t2").alias("tid")).distinct(), "tid", "left_semi")
    met = want.join(growing(second), ["doc", "pos", "tid"], "left_semi").join(runs.select("item", "first", "o1", "o2"), ["item", "o1", "o2"])
    cand = cut(met.where(F.col("diag") + F.col("first") >= 0).select("doc", "item", "diag", "first"))
    places = cand.select("doc", "item", "diag", F.explode(F.sequence(F.col("first"), F.col("first") + run - 1)).alias("off")).distinct()
    want = places.join(terms.select("item", "off", "tid"), ["item", "off"]).select("doc", "item", "diag", "off", (F.col("diag") + F.col("off")).alias("pos"), "tid")
    near = index.join(checked(cand.select("doc").distinct()), "doc", "left_semi")
    got = want.join(growing(near), ["doc", "pos", "tid"], "left_semi")
    w = Window.partitionBy("doc", "item", "diag").orderBy("off")
    got = got.withColumn("island", F.col("off") - F.row_number().over(w))
    islands = got.groupBy("doc", "item", "diag", "island").agg(F.count("*").alias("n")).where(F.col("n") >= run)
    return islands.groupBy("doc", "item").agg(F.max("n").alias("longest"))


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """``(doc_id, item_id)`` of :func:`leaked_runs`."""
    return leaked_runs(docs, items, run).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def proximity_matches(docs: DataFrame, items: DataFrame, words: int = 20) -> DataFrame:
    """``(doc_id, item_id, share)``: documents with a stretch of ``2 * words`` words that holds, in
    any order, terms of an item weighing as much as ``words`` average words of it (or 0.8 of all
    its terms, if those are few); ``share`` is the greatest such weight in terms of that bound.

    A term weighs minus the logarithm of its share of the indexed tokens. Stretches start every
    ``words`` words, so that a reordered or broken passage of 1.5 * ``words`` ordinary words is
    found wherever it stands. Terms are taken from the rarest on until those left weigh less than
    half the bound; only stretches in which the taken ones weigh the other half can reach it, and
    in those all terms of the item are counted. Null and empty texts match nothing.
    """
    terms = eval_terms(items, "item_id", "item_text")
    index = build_index(docs, terms, "doc_id", "text")
    seen = index.groupBy("tid").agg(F.count("*").alias("n"))
    every = seen.agg(F.sum("n").alias("every"))
    weight = F.log((F.col("every") + 1) / F.coalesce("n", F.lit(1)))
    t = with_totals(terms.join(seen, "tid", "left"), every).select("item", "tid", weight.alias("weight"))
    once = t.distinct()
    bound = t.groupBy("item").agg((F.avg("weight") * words).alias("b")).join(once.groupBy("item").agg((F.sum("weight") * 0.8).alias("most")), "item")
    once = once.join(bound.select("item", F.least("b", "most").alias("bound")), "item")
    lighter = F.sum("weight").over(Window.partitionBy("item").orderBy("weight", "tid"))
    once = cut(once.withColumn("rare", lighter >= F.col("bound") / 2))
    cell = F.floor(F.col("pos") / words)
    place = F.explode(F.array(cell, cell - 1)).alias("cell")
    rare = index.join(once.where("rare"), "tid").select("doc", "item", "tid", "weight", "bound", place)
    rare = rare.distinct().groupBy("doc", "item", "cell").agg(F.sum("weight").alias("got"), F.first("bound").alias("bound"))
    maybe = cut(rare.where(F.col("got") >= F.col("bound") / 2 - 1e-9).select("doc", "item", "cell"))
    near = index.join(checked(maybe.select("doc").distinct()), "doc", "left_semi").select("doc", "tid", place).distinct()
    all_terms = maybe.join(once.select("item", "tid", "weight", "bound"), "item")
    met = all_terms.join(growing(near), ["doc", "cell", "tid"]).groupBy("doc", "item", "cell").agg((F.sum("weight") / F.first("bound")).alias("share"))
    met = met.where(F.col("share") >= 1 - 1e-9)
    return met.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("share").alias("share"))

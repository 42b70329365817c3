"""Sparse multinomial models on feature arrays, with cross-validation, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from helixframe.operators import splits
from helixframe.operators.crossval import right_of_path
from helixframe.operators.features import sparse_rows, vectors
from helixframe.operators.ranking import distributed_rank
from helixframe.operators.splits import uniform
from helixframe.runtime import cut, growing, spread

#: Classes that come to the driver at most; a label of more is no label for such a model.
MAX_CLASSES = 200
#: Rows of a task of a fit.
ROWS = 2000
#: Cells of the guesses that one stretch of rows makes in a small fit; columns of a fit by Newton steps at most.
CACHED, FEW = 1 << 15, 16
#: Guesses so far from 0 are moved before they are raised, which doubles could not hold.
FAR = 300
#: Labels that are fitted at the same time.
AT_ONCE = 4


def classes_of(df: DataFrame, label: str, most: int = MAX_CLASSES) -> list[str]:
    """The classes in order, few by definition: more than ``most`` are an error."""
    found = [r[0] for r in df.select(F.col(label).cast("string").alias("c")).where("c is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return sorted(found)


def labelled(df: DataFrame, features: str, label: str) -> tuple[DataFrame, list[str]]:
    """Vectors ``x`` and numeric labels ``y``; rows without a label are left out."""
    classes = classes_of(df, label)
    at = F.array_position(F.array(*map(F.lit, classes or [""])), F.col(label).cast("string")) - 1
    return df.where(F.col(label).isNotNull()).withColumn("x", array_to_vector(features)).withColumn("y", at.cast("double")), classes


def _lasso(penalty: float, iterations: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", elasticNetParam=1.0, regParam=penalty, standardization=True, maxIter=iterations)


def penalty_path(d: DataFrame, n: int = 10, ratio: float = 0.01) -> tuple[list[float], Row]:
    """Descending penalties from the data, and ``mean``, ``std`` and ``count`` of the features: from the least at which all coefficients are 0, which
    is the largest class share times distance of the class mean from the mean in deviations,
    down to ``ratio`` of it, evenly in logarithms. One pass gathers a mean for each class."""
    every = d.select(Summarizer.metrics("mean", "std", "count").summary(F.col("x")).alias("s")).select("s.mean", "s.std", "s.count").first()
    mean, std, total = every["mean"].toArray(), every["std"].toArray(), every["count"]
    per = d.groupBy("y").agg(Summarizer.mean(F.col("x")).alias("m"), F.count("*").alias("n")).collect()
    scale = np.where(std > 0, std, np.inf)
    top = max([float(np.max(r["n"] / total * np.abs(r["m"].toArray() - mean) / scale)) for r in per if total] or [0.0])
    return [top * ratio ** (i / max(n - 1, 1)) for i in range(n)] if top > 0 else [1.0], every


def fit_lasso(df: DataFrame, key: str, features: str, label: str, folds: int = 3, penalties: int = 10, iterations: int = 50):
    """Multinomial lasso at the penalty of best cross-validated accuracy (the larger of equals).

    Folds come from a hash of ``key``, the penalties from :func:`penalty_path`; all folds and
    penalties are fitted in the same passes. Returns the model, the classes and the chosen
    penalty; None if there are fewer than two classes.
    """
    d, classes = labelled(df, features, label)
    if len(classes) < 2:
        return None
    d = cut(d.withColumn("fold", F.floor(uniform(F.col(key), 1) * folds).cast("int")).select("x", F.col(features).cast("array<double>").alias("row"), "y", "fold"))
    # every step of a fit is a job: few rows go to few tasks, and stay in memory for all steps
    d = d.coalesce(d.count() // ROWS + 1).persist()
    path, every = penalty_path(d, penalties)
    sizes = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}
    best = path[0]
    if len(path) > 1 and len(sizes) > 1:
        hits = right_of_path(d.select(F.col("row").alias("x"), "y", "fold"), every["mean"].toArray(), every["std"].toArray(), len(classes), path, sizes)
        best = path[int(np.argmax(hits))]
    chosen = _lasso(best, iterations).fit(d)
    d.unpersist()
    return chosen, classes, best


def coefficients(spark, model, classes: list[str], names: DataFrame | list[str]) -> DataFrame:
    """``(feature, class, coefficient)``: the intercept, and every feature with a coefficient other
    than 0 in some class; the model itself lives on the driver, names may be a table
    ``(feature, i)`` that does not."""
    import pandas as pd

    m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    kept = np.nonzero(np.any(m != 0, axis=0))[0]
    cells = pd.DataFrame({"i": np.repeat(kept, len(classes)).astype("int32"), "class": np.tile(np.array(classes, object), len(kept)), "coefficient": m[:, kept].T.ravel()})
    if isinstance(names, list):
        names = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, i int")
    own = spark.createDataFrame(cells, "i int, class string, coefficient double").join(growing(names.select("feature", "i")), "i").select("feature", "class", "coefficient")
    return own.union(spark.createDataFrame([("Intercept", c, float(x)) for c, x in zip(classes, b, strict=True)], "feature string, class string, coefficient double"))


def nonzero(coefs: DataFrame) -> DataFrame:
    """Features, other than the intercept, with a coefficient that is not 0 in some class."""
    some = coefs.where("feature <> 'Intercept' and coefficient <> 0").select("feature").distinct()
    return coefs.join(some, "feature", "left_semi")


def confusion(predictions: DataFrame, truth: str = "y", guess: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("true_class"), F.col(guess).alias("predicted_class")).agg(F.count("*").alias("n"))


def scores(matrix: DataFrame) -> DataFrame:
    """``(class, sensitivity, specificity, accuracy)`` of a confusion matrix in long form."""
    total = matrix.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)).alias("right")).withColumn("one", F.lit(1))
    t = matrix.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("p"), F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)).alias("tp"))
    g = matrix.groupBy(F.col("predicted_class").alias("class")).agg(F.sum("n").alias("g"))
    d = t.join(g, "class", "left").withColumn("one", F.lit(1)).join(total, "one")
    fp = F.coalesce("g", F.lit(0)) - F.col("tp")
    rest = F.nullif(F.col("all") - F.col("p"), F.lit(0))
    return d.select("class", (F.col("tp") / F.col("p")).alias("sensitivity"), (1 - fp / rest).alias("specificity"), (F.col("right") / F.col("all")).alias("accuracy"))


@dataclass
class Fits:
    """What the loop over labels gives, in long form over all labels."""

    coefficients: DataFrame  # label, feature, class, coefficient
    confusion: DataFrame  # label, true_class, predicted_class, n
    scores: DataFrame  # label, class, sensitivity, specificity, accuracy
    labels: DataFrame  # label, status, n_rows, classes, penalty
    failed: dict[str, str]  # the error of each label whose fit failed

    def whole(self) -> Fits:
        """These fits, if none has failed: what is left of the others must not look like all."""
        if self.failed:
            raise RuntimeError("fits failed: " + "; ".join(f"{k}: {v}" for k, v in sorted(self.failed.items())))
        return self


Selector = Callable[[DataFrame, DataFrame], DataFrame]


def label_samples(long: DataFrame, meta: DataFrame, *, minimum: int = 30, rows: int = 90, max_classes: int | None = None, train: float = 0.5, even: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(label, sample_name, class, split)`` for all labels at once, and ``(label, status, n_rows,
    classes)`` of every label with a class of more than ``minimum`` samples.

    Of ``meta(ord, sample_name, metadata, class)`` count the samples that ``long`` has too, each by
    its last row; empty classes are none. Every class of more than ``minimum`` samples gives
    floor(train * size of the label's smallest) of them to train, the others test, or with
    ``even`` only as many as even out the classes. A label of fewer than ``rows`` samples, fewer
    than two or more than ``max_classes`` classes is not ``ready``.
    """
    now = meta.dropna(subset=["sample_name", "metadata"]).groupBy("sample_name", F.col("metadata").alias("label"))
    now = now.agg(F.max_by(F.coalesce("class", F.lit("")), "ord").alias("class")).where("class <> ''")
    now = cut(splits.mutual(now, long)[0])
    size = now.groupBy("label", "class").agg(F.count("*").alias("n")).where(F.col("n") > minimum)
    per = size.groupBy("label").agg(F.sum("n").alias("n_rows"), F.count("*").alias("classes"), F.min("n").alias("least"))
    status = F.when(F.col("n_rows") < rows, "too few rows").when(F.col("classes") < 2, "too few classes")
    status = status.when(F.col("classes") > (max_classes or MAX_CLASSES), "too many classes").otherwise("ready")
    per = cut(per.withColumn("status", status))
    d = now.join(growing(size.select("label", "class")), ["label", "class"], "left_semi")
    d = distributed_rank(d, ["label", "class"], splits.drawn(F.col("sample_name"), seed), [splits.draw(F.col("sample_name"), seed), "sample_name"], "k")
    d = d.join(growing(per.where("status = 'ready'").select("label", "least")), "label")
    d = d.where(F.col("k") <= F.col("least")) if even else d
    split = F.when(F.col("k") <= F.floor(F.col("least") * train + 1e-9), "train").otherwise("test")
    return d.select("label", "sample_name", "class", split.alias("split")), per.select("label", "status", "n_rows", "classes")


def fit_labels(long: DataFrame, meta: DataFrame, *, select: Selector | None = None, samples: dict | None = None, **fit) -> Fits:
    """One multinomial lasso for each ready label of :func:`label_samples` on the features
    ``long(sample_name, feature, value)``: the fit on train and its confusion on test.

    A label whose fit fails twice is left out; ``labels`` and ``failed`` say so, and
    :meth:`Fits.whole` raises. ``select`` may choose features for a label from its samples
    ``(sample_name, class)`` first, the grouped lasso for one.
    """
    spark = long.sparkSession
    every, ready = label_samples(long, meta, **(samples or {}))
    every = cut(every)
    wide, table = (None, None) if select else _matrix(long)
    found = ready.orderBy("label").collect()
    failed: dict[str, str] = {}

    def one(name: str):
        d = every.where(F.col("label") == name).drop("label")
        x, names = wide, table
        if select:
            chosen = long.join(growing(select(long, d.select("sample_name", "class"))), "feature", "left_semi")
            x, names = _matrix(chosen)
        x = cut(x.join(growing(d), "sample_name"))
        got = None
        for last in (False, True):
            try:
                got = fit_lasso(x.where("split = 'train'"), "sample_name", "features", "class", **fit)
                break
            except Exception as e:  # noqa: BLE001 - a fit that fails is tried once more, then named
                if last:
                    failed[name] = f"{type(e).__name__}: {str(e)[:500]}"
        if got is None:
            return None
        model, classes, penalty = got
        at = F.array(*map(F.lit, classes))
        test = labelled_as(x.where("split = 'test'"), classes)
        guess = model.transform(test).select(F.col("class").alias("true_class"), F.element_at(at, (F.col("prediction") + 1).cast("int")).alias("predicted_class"))
        matrix = confusion(guess, "true_class", "predicted_class").select(F.lit(name).alias("label"), "*")
        return coefficients(spark, model, classes, names).select(F.lit(name).alias("label"), "*"), matrix, float(penalty)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = dict(zip([r["label"] for r in found if r["status"] == "ready"], pool.map(one, [r["label"] for r in found if r["status"] == "ready"]), strict=True))
    coefs, matrices = [g[0] for g in got.values() if g], [g[1] for g in got.values() if g]
    status = []
    for name, state, n, k in found:
        fitted = got.get(name)
        status.append((name, ("fitted" if fitted else "no fit") if state == "ready" else state, n, k, fitted[2] if fitted else None))
    none = lambda schema: spark.createDataFrame([], schema)
    matrix = cut(reduce(DataFrame.union, matrices)) if matrices else none("label string, true_class string, predicted_class string, n long")
    per = [scores(matrix.where(F.col("label") == s[0]).drop("label")).select(F.lit(s[0]).alias("label"), "*") for s in status if s[1] == "fitted"]
    return Fits(
        reduce(DataFrame.union, coefs) if coefs else none("label string, feature string, class string, coefficient double"),
        matrix,
        reduce(DataFrame.union, per) if per else none("label string, class string, sensitivity double, specificity double, accuracy double"),
        spark.createDataFrame(status, "label string, status string, n_rows long, classes long, penalty double"),
        failed,
    )


def _matrix(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    long = cut(long.select("sample_name", "feature", "value"))
    return cut(vectors(long)), sparse_rows(long)[1]


def labelled_as(df: DataFrame, classes: list[str]) -> DataFrame:
    """Vectors and the numbers of known classes; rows of other classes are left out."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("class").cast("string")) - 1
    return df.withColumn("x", array_to_vector("features")).withColumn("y", at.cast("double")).where("y >= 0")


def _slopes(x: np.ndarray, y: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean multinomial loss of the model ``a`` on rows x, its slopes, and for each class a bound of the
    curvature there: the rows weighted by their share of the class. In stretches that stay in the cache."""
    loss, slope, (i, j) = 0.0, np.zeros_like(a), np.triu_indices(len(a))
    half = np.zeros((a.shape[1], len(i)))
    step = max(1, CACHED // a.shape[1])
    for lo in range(0, len(x), step):
        some = x[lo : lo + step]
        q, own = some @ a, y[lo : lo + step]
        if q.min() < -FAR or q.max() > FAR:
            q -= q.max(1, keepdims=True)
        loss -= q[np.arange(len(some)), own].sum()
        np.exp(q, out=q)
        total = q.sum(1, keepdims=True)
        loss += np.log(total).sum()
        part = some / total
        half += q.T @ (part[:, i] * some[:, j])  # products of two columns once for all classes
        slope += part.T @ q
        for k, column in enumerate(some.T):
            slope[k] -= np.bincount(own, column, a.shape[1])
    bound = np.zeros((a.shape[1], len(a), len(a)))
    bound[:, i, j] = bound[:, j, i] = half
    return loss / len(x), slope / len(x), bound / len(x)


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, a: np.ndarray, steps: int, tolerance: float = 1e-4) -> np.ndarray:
    """The lasso from the model ``a`` on, for few columns, of which the last is of ones and has no penalty: each
    step solves the classes' bounds by coordinates and is halved while the loss with the penalty grows. It ends
    when no number moves by more than ``tolerance`` of the largest (or of 1)."""
    cost = lambda loss, a: loss + penalty * np.abs(a[:-1]).sum()
    loss, slope, bound = _slopes(x, y, a)
    for _ in range(steps):
        curve = np.maximum(np.einsum("kii->ik", bound), 1e-9)
        new, rest = a.copy(), slope.copy()
        for _ in range(100):
            most = 0.0
            for i in range(len(a)):
                z = new[i] - rest[i] / curve[i]
                z = z if i == len(a) - 1 else np.sign(z) * np.maximum(np.abs(z) - penalty / curve[i], 0)
                by = z - new[i]
                rest += bound[:, :, i].T * by
                new[i] = z
                most = max(most, float(np.abs(by).max()))
            if most <= tolerance / 10:
                break
        before = cost(loss, a)
        now = _slopes(x, y, new)
        for _ in range(30):
            if cost(now[0], new) <= before + 1e-12:
                break
            new = (a + new) / 2
            now = _slopes(x, y, new)
        moved, a, (loss, slope, bound) = float(np.abs(new - a).max()), new, now
        if moved <= tolerance * max(1.0, float(np.abs(a).max())):
            break
    return a


def by_position(long: DataFrame) -> DataFrame:
    """``(sample_name, position, v)``: the values of a sample at a position by dim."""
    return long.groupBy("sample_name", "position").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("v"))


def grouped_lasso(long: DataFrame, labels: DataFrame, penalties: int = 10, folds: int = 3, steps: int = 80) -> DataFrame:
    """``(position, dim)`` kept by a first-stage lasso fitted at each position on its own, at the
    penalty of best cross-validated accuracy there.

    ``long`` is (sample_name, position, dim, value), or has been through :func:`by_position`;
    ``labels`` is (sample_name, label). One small
    fit (Newton steps for few dims, else proximal gradients) a penalty and fold, warm from the penalty before; the positions are
    spread over the tasks. A group is the samples of one position, the unit the model is defined
    on. Positions of one class keep nothing; a missing dim counts as 0.
    """
    import pandas as pd

    per = long if "v" in long.columns else by_position(long)
    d = per.join(growing(labels.dropna()), "sample_name").select("position", F.col("label").cast("string").alias("label"), F.floor(uniform(F.col("sample_name"), 1) * folds).cast("int").alias("fold"), "v")

    def path_of(x: np.ndarray, y: np.ndarray) -> list[float]:
        top = float(np.abs(x.T @ (y - y.mean(0))).max() / len(x)) if len(x) else 0.0
        return [top * 0.02 ** (i / max(penalties - 1, 1)) for i in range(penalties)]

    def descend(x, y, penalty, w, b):
        if x.shape[1] <= FEW:
            a, some = np.vstack([w, b]), y.any(0)  # a class without rows in this fold is never guessed
            a[:, some] = _newton(np.hstack([x, np.ones((len(x), 1))]), y[:, some].argmax(1), penalty, a[:, some], steps)
            a[:-1, ~some], a[-1, ~some] = 0, -1e3
            return a[:-1], a[-1]
        rate = len(x) / (np.linalg.norm(x, 2) ** 2 / 2 + 1e-9)
        for _ in range(steps):
            z = x @ w + b
            q = np.exp(z - z.max(1, keepdims=True))
            q = (q / q.sum(1, keepdims=True) - y) / len(x)
            w = w - rate * (x.T @ q)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
            b = b - q.sum(0)
        return w, b

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [dict(v) for v in pdf["v"]]
        dims = sorted({k for v in values for k in v})
        none = pd.DataFrame({"position": np.zeros(0, np.int64), "dim": np.zeros(0, np.int64)})
        y = pd.get_dummies(pdf["label"]).to_numpy(float)
        if y.shape[1] < 2 or not dims:
            return none
        x = np.array([[v.get(k, 0.0) for k in dims] for v in values])
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
        path, fold = path_of(x, y), pdf["fold"].to_numpy()
        right = np.zeros(len(path))
        start = lambda: (np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1]))
        for f in np.unique(fold) if len(np.unique(fold)) > 1 else ():
            w, b = start()
            for i, p in enumerate(path):
                w, b = descend(x[fold != f], y[fold != f], p, w, b)
                right[i] += ((x[fold == f] @ w + b).argmax(1) == y[fold == f].argmax(1)).sum()
        w, b = start()
        for p in path[: int(right.argmax()) + 1]:
            w, b = descend(x, y, p, w, b)
        kept = np.nonzero(np.abs(w).sum(1))[0]
        return pd.DataFrame({"position": np.full(len(kept), pdf["position"].iloc[0], np.int64), "dim": np.array(dims, np.int64)[kept]})

    # the rows of a position are few bytes and much work: their tasks are never merged
    return d.repartition(spread(d.sparkSession), "position").groupBy("position").applyInPandas(fit, "position long, dim long")


def grouped_two_stage(ordered: DataFrame, meta: DataFrame, **options) -> Fits:
    """The grouped lasso: for each label the features kept at any position by the first stage on
    all its samples, and on their union the second fit with its split, as in :func:`fit_labels`.
    ``ordered`` is (sample_name, position, dim, value)."""
    ordered = cut(ordered)
    grouped = cut(by_position(ordered))
    name = F.concat(F.lit("cluster_"), F.col("position"), F.lit("_embedding_"), F.col("dim"))

    def select(_: DataFrame, samples: DataFrame) -> DataFrame:
        return cut(grouped_lasso(grouped, samples.withColumnRenamed("class", "label")).select(name.alias("feature")))

    return fit_labels(ordered.select("sample_name", name.alias("feature"), "value"), meta, select=select, **options)

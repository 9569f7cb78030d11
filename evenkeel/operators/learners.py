"""Classifiers of Spark's library, scores and fairness-aware weights."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import nearest


def classifier(kind: str, width: int, seed: int = 0):
    """An unfitted classifier by name."""
    kw = {"featuresCol": "features", "labelCol": "label"}
    makers = {
        "lr": lambda: LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, **kw),
        "l1": lambda: LogisticRegression(weightCol="weight", regParam=1e-2, elasticNetParam=1.0, maxIter=30, **kw),
        "tree": lambda: DecisionTreeClassifier(weightCol="weight", maxDepth=5, seed=seed, **kw),
        "rf": lambda: RandomForestClassifier(weightCol="weight", numTrees=10, maxDepth=5, seed=seed, **kw),
        "gbt": lambda: GBTClassifier(weightCol="weight", maxIter=5, maxDepth=3, seed=seed, **kw),
        "nb": lambda: NaiveBayes(modelType="gaussian", weightCol="weight", **kw),
        "svm": lambda: LinearSVC(weightCol="weight", maxIter=20, regParam=1e-2, **kw),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[width, 4, 2], maxIter=20, seed=seed, **kw),
    }
    if kind not in makers:
        raise ValueError(f"no classifier {kind}")
    return makers[kind]()


def with_features(df: DataFrame, fit: DataFrame, cols: list[str], y: str, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit, all) with standardised ``features`` (fitted on ``fit``), ``label`` and ``weight``."""
    def add(x: DataFrame) -> DataFrame:
        w = F.lit(1.0) if weight is None else weight
        return x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}).withColumns({"label": F.col(y).cast("double"), "weight": w})

    assembler = VectorAssembler(inputCols=cols, outputCol="raw_features")
    a, b = assembler.transform(add(fit)), assembler.transform(add(df))
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(a)
    return scaler.transform(a), scaler.transform(b)


def positive_probability(scored: DataFrame, out: str = "p_event") -> DataFrame:
    """Adds the class-1 probability; a value that is not finite or outside [0, 1] is an error."""
    p = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    bad = F.isnan(p) | (p < 0) | (p > 1)
    return scored.withColumn(out, F.when(bad, F.raise_error(F.lit("not a probability")).cast("double")).otherwise(p))


def fit_score(df: DataFrame, fit: DataFrame, cols: list[str], y: str, kind: str, weight: Column | None = None) -> DataFrame:
    """``df`` with ``p_event`` of a classifier fitted on ``fit``."""
    a, b = with_features(df, fit, cols, y, weight)
    model = classifier(kind, len(cols)).fit(a)
    return positive_probability(model.transform(b)).select(*df.columns, "p_event")


def knn_score(df: DataFrame, fit: DataFrame, key: str, cols: list[str], y: str, k: int = 5, keep: list[str] | None = None) -> DataFrame:
    """(key, p_event, neighbours, keep): the share of class 1 among the k nearest rows of ``fit``, exactly, for every row.

    Features are standardised; a row of the same key is not its own neighbour; of equally near ones the smaller
    key wins.  ``fit`` of k rows or fewer gives what there is, null without any.  A null key is a row like any
    other.  See ``neighbours.nearest``.
    """
    a, b = with_features(df, fit, cols, y)
    x = vector_to_array("features").alias("x")
    about = F.struct(F.col(key).alias("key"), *[F.col(c).alias(c) for c in keep or []]).alias("about")
    rows = b.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), x, about)
    near = nearest(rows, a.select(F.col(key).alias("key"), F.col("label"), x), len(cols), k, True, ["about"])
    return near.select(
        F.col("about.key").alias(key),
        F.aggregate("near", F.lit(0.0), lambda s, v: s + v["label"], lambda s: s / F.nullif(F.size("near"), F.lit(0))).alias("p_event"),
        F.size("near").cast("long").alias("neighbours"),
        *[F.col("about")[c].alias(c) for c in keep or []],
    )


def class_moments(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """(y, a, b) n, means and covariance of each pair of features: what discriminant analysis needs."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    x = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("xa"), F.col(b).cast("double").alias("xb")) for a, b in pairs])
    return df.select(F.col(y).alias("y"), F.inline(x)).groupBy("y", "a", "b").agg(F.count("*").alias("n"), F.avg("xa").alias("mean_a"), F.avg("xb").alias("mean_b"), F.covar_pop("xa", "xb").alias("cov"))


def discriminant_score(df: DataFrame, fit: DataFrame, cols: list[str], y: str, quadratic: bool = False, reg: float = 0.0) -> DataFrame:
    """``df`` with ``p_event``: the posterior of class 1 under normal classes fitted on ``fit`` in one scan.

    Linear: one covariance, pooled over the classes; quadratic: one each.  A covariance is shrunk to
    (1 - reg) S + reg I.  Nulls of features count as 0, in the fit too.  What reaches the driver is the
    moment table, a row for each pair of features and class.
    """
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    at, k = {c: i for i, c in enumerate(cols)}, len(cols)
    n, mean, cov = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for r in class_moments(fit.withColumns(zero), cols, y).collect():
        c, i, j = int(r.y), at[r.a], at[r.b]
        n[c], mean[c, i], mean[c, j], cov[c, i, j] = r.n, r.mean_a, r.mean_b, r.cov
        cov[c, j, i] = r.cov
    if not n.all():
        raise ValueError("the fit has one class")
    if quadratic:
        cov *= (n / np.maximum(n - 1, 1))[:, None, None]
    else:
        cov[:] = (cov * (n / n.sum())[:, None, None]).sum(0)
    inverse = [np.linalg.pinv((1 - reg) * s + reg * np.eye(k)) for s in cov]
    logdet = [np.linalg.slogdet((1 - reg) * s + reg * np.eye(k))[1] for s in cov]

    def score(c: int):
        d = [zero[f] - F.lit(float(m)) for f, m in zip(cols, mean[c], strict=True)]
        terms = [F.lit(float(inverse[c][i, j])) * d[i] * d[j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)]
        return -reduce(lambda x, z: x + z, terms, F.lit(float(logdet[c]))) / 2 + F.lit(float(np.log(n[c] / n.sum())))

    return df.withColumn("p_event", 1 / (1 + F.exp(score(0) - score(1))))


def adaboost_score(df: DataFrame, fit: DataFrame, key: str, cols: list[str], y: str, rounds: int = 3) -> DataFrame:
    """``df`` with ``p_event`` of boosted weighted trees; what reaches the driver is one error a round."""
    import math

    a, b = with_features(df, fit, cols, y)
    votes = F.lit(0.0)
    for i in range(rounds):
        model = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=2, seed=i, predictionCol=f"_pred{i}", probabilityCol=f"_pp{i}", rawPredictionCol=f"_rp{i}").fit(a)
        a, b = model.transform(a), model.transform(b)
        err = a.agg((F.sum(F.when(F.col(f"_pred{i}") != F.col("label"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("e")).first().e
        err = min(max(err, 1e-6), 1 - 1e-6)
        alpha = math.log((1 - err) / err)
        a = a.withColumn("weight", F.col("weight") * F.when(F.col(f"_pred{i}") != F.col("label"), math.exp(alpha)).otherwise(1.0))
        votes = votes + alpha * (2 * F.col(f"_pred{i}") - 1)
    return b.select(*df.columns, (1 / (1 + F.exp(-votes))).alias("p_event"))


def score_linear(columns: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """Stored logistic model: {column: (coefficient, shift, scale)} and an intercept."""
    terms = [F.lit(b) * (F.col(c) - m) / s for c, (b, m, s) in columns.items()]
    return 1 / (1 + F.exp(-reduce(lambda x, z: x + z, terms, F.lit(intercept))))


def reweighing(df: DataFrame, attr: str, y: str, w: str) -> DataFrame:
    """(attr, y, factor): P(A) P(Y) / P(A, Y) of the weights; a cell without support is an error where it is used."""
    cell = df.groupBy(attr, y).agg(F.sum(w).alias("s"))
    every = Window.partitionBy(F.lit(0))  # as many rows as cells
    pa, py, total = F.sum("s").over(Window.partitionBy(attr)), F.sum("s").over(Window.partitionBy(y)), F.sum("s").over(every)
    return cell.select(attr, y, (pa * py / (total * F.col("s"))).alias("factor"))

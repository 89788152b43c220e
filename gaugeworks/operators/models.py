"""Linear models from one aggregation pass, and MLlib tree and logistic models."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .attach import attach


def gram(df: DataFrame, keys, xs, y: str) -> DataFrame:
    """Moments of a least-squares problem: n, x sums, upper Gram triangle, X'y and y sum.

    One partial + final aggregation; a key contributes one small row however
    many observations it has.
    """
    xs = list(xs)
    d = df.dropna(subset=xs + [y])
    tri = [F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(len(xs)) for j in range(i, len(xs))]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in xs]).alias("sx"), F.array(*tri).alias("sxx"),
        F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs]).alias("sxy"), F.sum(y).alias("sy"))


def _solve(n, sx, sxx, sxy, sy, lam, penalise_intercept):
    k = len(sx)
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = sxx
    g = g + np.triu(g, 1).T
    sx, sxy = np.asarray(sx, float), np.asarray(sxy, float)
    if penalise_intercept:
        a = np.empty((k + 1, k + 1))
        a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = n, sx, sx, g
        rhs = np.concatenate([[sy], sxy])
        return np.linalg.solve(a + lam * np.eye(k + 1), rhs)
    xc = g - np.outer(sx, sx) / n
    beta = np.linalg.solve(xc + lam * np.eye(k), sxy - sx * sy / n)
    return np.concatenate([[(sy - sx @ beta) / n], beta])


def ridge(df: DataFrame, keys, xs, y: str, lam: float, *, penalise_intercept: bool) -> DataFrame:
    """Coefficients ``beta`` = [intercept, x1, ...] per key, solved on the aggregated moments."""
    g = gram(df, keys, xs, y)
    schema = T.StructType([g.schema[k] for k in keys] + [T.StructField("n", T.LongType()),
                                                         T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = pdf[[*keys, "n"]].copy()
                out["beta"] = [_solve(r.n, r.sx, r.sxx, r.sxy, r.sy, lam, penalise_intercept)
                               for r in pdf.itertuples(index=False)]
                yield out

    return g.mapInPandas(run, schema)


def ols_gram(df, keys, xs, y, lam: float = 1e-6) -> DataFrame:
    """Normal equations with the ridge term on every coefficient, intercept included."""
    return ridge(df, keys, xs, y, lam, penalise_intercept=True)


def linear_predict(df: DataFrame, coefs: DataFrame, keys, xs, out: str = "y_pred") -> DataFrame:
    """Dot product with the key's coefficients (NULL where a feature is NULL)."""
    c = coefs.select(*keys, "beta")
    j = attach(df, c, keys)
    val: Column = F.element_at("beta", 1)
    for i, x in enumerate(xs, start=2):
        val = val + F.element_at("beta", i) * F.col(x)
    return j.withColumn(out, val).drop("beta")


# ------------------------------------------------------------------ MLlib

def assemble(df: DataFrame, xs, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(xs), outputCol=out, handleInvalid="skip").transform(df)


def importances(model, xs) -> list[tuple[str, float]]:
    return list(zip(xs, [float(v) for v in model.featureImportances.toArray()]))


def rf_regress(train: DataFrame, xs, y: str, trees: int = 300, depth: int = 12, seed: int = 0):
    from pyspark.ml.regression import RandomForestRegressor
    return RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed,
                                 predictionCol="y_pred").fit(assemble(train, xs))


def gbt_regress(train: DataFrame, xs, y: str, trees: int = 300, depth: int = 3, step: float = 0.05,
                subsample: float = 0.9, seed: int = 0):
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(featuresCol="features", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=step,
                        subsamplingRate=subsample, seed=seed, predictionCol="y_pred").fit(assemble(train, xs))


def rf_classify(train: DataFrame, xs, label: str, trees: int = 200, depth: int = 12, seed: int = 0):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                                  predictionCol="pred").fit(assemble(train, xs))


def glm_logistic(train: DataFrame, xs, label: str, c: float = 1.0):
    """Logistic regression on standardised features; the penalty matches strength ``c`` on n rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    d = assemble(train, xs, "_raw")
    n = d.count()
    return Pipeline(stages=[
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                           standardization=False, maxIter=200)]).fit(d)


class CalibratedGBT:
    """K boosted classifiers, each calibrated by isotonic regression on its held-out fold; the
    probability is the mean over the K."""

    def __init__(self, parts, xs):
        self.parts, self.xs = parts, list(xs)

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        cols = df.columns
        d = assemble(df, self.xs)
        probs = []
        for i, (gbt, iso) in enumerate(self.parts):
            d = gbt.transform(d).withColumn("_score", vector_to_array("probability")[1])
            d = iso.transform(d).withColumnRenamed("_iso", f"_p{i}").drop(
                "rawPrediction", "probability", "prediction", "_score")
            probs.append(F.col(f"_p{i}"))
        return d.select(*cols, (sum(probs[1:], probs[0]) / float(len(probs))).alias(out))

    def importances(self, spark) -> DataFrame:
        mean = np.mean([g.featureImportances.toArray() for g, _ in self.parts], axis=0)
        return spark.createDataFrame([(x, float(v)) for x, v in zip(self.xs, mean)], "feature string, importance double")


def gbt_calibrated(train: DataFrame, xs, label: str, id_col: str, folds: int = 3, trees: int = 300, depth: int = 3,
                   step: float = 0.05, seed: int = 0) -> CalibratedGBT:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    from pyspark.util import inheritable_thread_target
    from ..functions.scalars import md5_int
    fold = md5_int(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))) % folds
    d = assemble(train, xs).select("features", fold.alias("_fold"), F.col(label).cast("double").alias(label))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)   # read 2 * folds times; lost blocks are recomputed

    def fit(k: int):
        gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step,
                            seed=seed).fit(d.filter(F.col("_fold") != k))
        held = gbt.transform(d.filter(F.col("_fold") == k)).withColumn("_score", vector_to_array("probability")[1])
        # equal scores collapse to one weighted point before the isotonic fit
        pts = held.groupBy("_score").agg(F.avg(label).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
        iso = IsotonicRegression(featuresCol="_score", labelCol="_y", weightCol="_w", predictionCol="_iso").fit(pts)
        return gbt, iso

    with ThreadPool(folds) as pool:   # a tree is some small jobs in a row, so the folds run side by side
        parts = pool.map(inheritable_thread_target(d.sparkSession)(fit), range(folds))
    d.unpersist()
    return CalibratedGBT(parts, xs)

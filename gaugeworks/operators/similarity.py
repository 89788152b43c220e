"""Heads on embeddings: exact k-nearest-neighbour vote and a linear probe."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from . import blocks
from .attach import attach

#: Block pairs shuffle every vector once per block of the other side, so blocks are large and the kernel takes PART queries at a time.
BLOCK_ROWS, PART = 8_192, 256


def standardize_arrays(train: DataFrame, df: DataFrame, col: str, eps: float = 1e-8) -> DataFrame:
    """Column-wise standardisation of arrays by train mean and population deviation.

    The moments come from one pass and form a single row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.transform(col, lambda x: x.cast("double")))
    m = train.select(v.alias("_v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s"))
    n = F.col("_s.count").cast("double")
    pop = F.transform(vector_to_array("_s.variance"), lambda x: F.sqrt(x * (n - 1) / n))   # the summary is ddof = 1
    m = m.select(vector_to_array("_s.mean").alias("_mu"), pop.alias("_sd"))
    j = attach(df, m, [])
    centred = F.zip_with(F.transform(col, lambda v: v.cast("double")), "_mu", lambda v, mu: v - mu)
    return j.withColumn(col, F.zip_with(centred, "_sd", lambda v, s: v / (s + eps))).drop("_mu", "_sd")


def knn(train: DataFrame, test: DataFrame, id_col: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest train rows of every test row: (query, neighbour, d, rank).

    Vector blocks meet by an equi join on block numbers; every block pair is one
    matrix product that keeps k rows per query.
    """
    a = blocks.pack(test.withColumn("rid", F.col(id_col)), [], ["rid", vec], "rid", block_rows, "a_")
    b = blocks.pack(train.withColumn("rid", F.col(id_col)), [], ["rid", vec], "rid", block_rows, "b_")
    # keep the vectors of a block flat for Arrow
    a = a.withColumn(f"a_{vec}", F.flatten(f"a_{vec}"))
    b = b.withColumn(f"b_{vec}", F.flatten(f"b_{vec}"))

    def kernel(row):
        aid, bid = np.asarray(row.a_rid), np.asarray(row.b_rid)
        A = np.asarray(getattr(row, "a_" + vec), float).reshape(len(aid), -1)
        B = np.asarray(getattr(row, "b_" + vec), float).reshape(len(bid), -1)
        order = np.argsort(bid, kind="stable")
        B, bid = B[order], bid[order]
        sq, q, n, near = (B * B).sum(1), [], [], []
        for i in range(0, len(A), PART):
            part = A[i:i + PART]
            d2 = np.maximum((part * part).sum(1)[:, None] + sq[None, :] - 2.0 * part @ B.T, 0.0)
            d2[np.isnan(d2)] = np.inf
            d = np.round(np.sqrt(d2), 8)   # the same order in every block and in the final cut
            at, to = np.nonzero(d <= np.partition(d, min(k, len(B)) - 1, axis=1)[:, min(k, len(B)) - 1][:, None])
            order = np.lexsort((to, d[at, to], at))   # ties: smaller id first
            at, to = at[order], to[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
            at, to = at[keep], to[keep]
            q.append(aid[i + at])
            n.append(bid[to])
            near.append(d[at, to])
        return {"query": np.concatenate(q), "neighbour": np.concatenate(n), "d": np.concatenate(near)}

    cand = blocks.reduce_pairs(blocks.cross_pairs(a, b, []), [], kernel, "query long, neighbour long, d double")
    w = W.partitionBy("query").orderBy("d", "neighbour")   # at most k rows per train block
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, vec: str, label: str, k: int = 5) -> DataFrame:
    """Majority vote of the k nearest; ties go to the smallest label."""
    n = knn(train, test, id_col, vec, k).join(
        train.select(F.col(id_col).alias("neighbour"), F.col(label).alias("_l")), "neighbour")
    votes = n.groupBy("query", "_l").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("c")).alias("c"), "_l")).alias("b")).select(
        F.col("query").alias(id_col), F.col("b._l").alias("pred"))


def linear_probe(train: DataFrame, test: DataFrame, vec: str, label: str, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Multinomial logistic regression on train-standardised embeddings; adds ``pred``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    tv = train.withColumn("_raw", array_to_vector(vec))
    n = tv.count()
    m = Pipeline(stages=[
        StandardScaler(inputCol="_raw", outputCol="_z", withMean=True),
        LogisticRegression(featuresCol="_z", labelCol=label, family="multinomial", regParam=1.0 / (c * max(n, 1)),
                           maxIter=max_iter, standardization=False, predictionCol="pred")]).fit(tv)
    return m.transform(test.withColumn("_raw", array_to_vector(vec))).drop("_raw", "_z", "rawPrediction", "probability")


def encode(df: DataFrame, encoder, in_cols, dim_out: str = "embedding", id_cols=()) -> DataFrame:
    """Run a user's encoder ``(pandas batch) -> (n, d) array`` over Arrow batches."""
    from pyspark.sql import types as T
    import pandas as pd
    schema = T.StructType([df.schema[c] for c in id_cols] + [T.StructField(dim_out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = pdf[list(id_cols)].copy()
                out[dim_out] = list(np.asarray(encoder(pdf[list(in_cols)]), dtype=np.float32))
                yield out

    return df.select(*id_cols, *[c for c in in_cols if c not in id_cols]).mapInPandas(run, schema)

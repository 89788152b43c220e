"""Exact top-k search by MaxScore over shards of whole-number vectors.

The terms of a query are its dimensions.  In a shard, what a term can add lies
between a least and a most; counted from the least, a term has a score bound.
The terms with the smallest bounds, as long as they cannot lift a vector to the
current threshold on their own, are non-essential.  Essential postings are
traversed for all vectors; non-essential ones are probed, largest bound first,
only for vectors that can still compete.  Shards are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import store, table

K, SCALE, EVERY = 10, 1024, 100
#: Vectors in a shard, queries in a block: one task compares one block with one shard.
SHARD, QUERY_BLOCK = 20_000, 4_000
#: Non-essential terms that are probed between two looks at who still competes.
PROBE = 8


def quantised(vectors: DataFrame, vec_id: str, vec: str, scale: int = SCALE) -> DataFrame:
    """``id, x`` with x = floor(scale * component); rows without an id or with a null or non-finite component go."""
    v = F.col(f"`{vec}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull()).where(~F.coalesce(bad, F.lit(True))).select(F.col(f"`{vec_id}`").alias("id"), x.alias("x"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for r, x in zip(out, rows):
        r[:len(x)] = x
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search_shard(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of a shard for one query; the query's own row takes no part."""
    most, least = rows.max(0), rows.min(0)
    high, low = np.maximum(query * most, query * least), np.minimum(query * most, query * least)
    order = np.argsort(low - high, kind="stable")  # largest bound first
    bound = (high - low)[order]
    rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0.0]])  # what the terms from here on can add
    # a first threshold: k vectors that lead the term with the largest bound, scored in full
    lead = np.argpartition(-rows[:, order[0]] * np.sign(query[order[0]] or 1.0), min(k, len(rows) - 1))[:k + 1]
    lead = lead[ids[lead] != own]
    floor = low.sum()
    first = np.sort(rows[lead] @ query)[::-1]
    threshold = first[k - 1] - floor if len(first) >= k else -np.inf
    split = max(1, int(np.searchsorted(-rest, -threshold, side="right")) if np.isfinite(threshold) else len(order))
    split = min(split, len(order))
    essential = order[:split]
    part = rows[:, essential] @ query[essential] - low[essential].sum()
    alive = np.flatnonzero((part + rest[split] >= threshold) & (ids != own))
    part = part[alive]
    at = split
    while at < len(order) and len(alive):
        terms = order[at:at + PROBE]
        part = part + rows[np.ix_(alive, terms)] @ query[terms] - low[terms].sum()
        at += len(terms)
        if len(part) >= k:
            threshold = max(threshold, np.partition(part, len(part) - k)[len(part) - k])
        stay = part + rest[at] >= threshold
        alive, part = alive[stay], part[stay]
    scores = part + floor
    top = _best(ids[alive], scores, k)
    return ids[alive][top], scores[top]


def _search(k: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        got = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(shard):
            width = max(max(map(len, queries.x)), max(map(len, shard.x)))
            ids, rows = shard.id.to_numpy(), _matrix(shard.x, width)
            asked = _matrix(queries.x, width)
            limit = float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1)
            if limit >= 2.0 ** 52:  # beyond exact floating point
                raise OverflowError("components are too large for exact inner products")
            for q, x in zip(queries.id.to_numpy(), asked):
                best, scores = search_shard(ids, rows, x, q, k) if width else (np.sort(ids[ids != q])[:k], np.zeros(min(k, int((ids != q).sum()))))
                got["query_id"].append(np.full(len(best), q))
                got["vec_id"].append(best)
                got["score"].append(scores.astype(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in got.items()})
    return run


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each row whose id is divisible by ``every``.

    Vectors are dealt to shards by a hash of their id, queries to blocks; each
    block meets each shard once, so both sides of a task are bounded.  Vectors of
    different lengths are filled up with zeros; ties go to the smaller id.
    """
    rows = store(quantised(vectors, vec_id, vec, scale), "maxscore")
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    salt = F.struct("id", "x")
    side = lambda df, mine, own, others: df.select("id", "x", F.pmod(F.xxhash64(salt), F.lit(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("o"))
    left = side(asked, "block", blocks, shards).withColumnRenamed("o", "shard")
    right = side(rows, "shard", shards, blocks).withColumnRenamed("o", "block")
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024.0::DOUBLE * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

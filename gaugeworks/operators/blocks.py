"""All-pairs reductions without emitting pairs.

Rows are packed into blocks of about ``block_rows``; every pair of blocks is one
row, joined on the block numbers, so a hot key spreads over as many tasks as it
has block pairs.  A NumPy kernel reduces each pair of blocks to a few numbers,
and a normal aggregation adds those up.  The quadratic arithmetic that the
definition asks for stays; the quadratic shuffle and output do not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .attach import attach, null_safe

BLOCK_ROWS = 2_048


def _field(name: str):
    return lambda r: r[name]


def pack(df: DataFrame, keys, cols, id_col: str, block_rows: int = BLOCK_ROWS, prefix: str = "") -> DataFrame:
    """One row per (key, block): ``<prefix>blk``, ``<prefix>nblk`` and one array per column."""
    keys = list(keys)
    blk, nblk = f"{prefix}blk", f"{prefix}nblk"
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("long").alias(nblk))
    salted = attach(df, n, keys).withColumn(blk, F.pmod(F.xxhash64(id_col), F.col(nblk)))
    packed = salted.groupBy(*keys, nblk, blk).agg(F.collect_list(F.struct(*cols)).alias("_rows"))
    return packed.select(*keys, nblk, blk, *[F.transform("_rows", _field(c)).alias(f"{prefix}{c}") for c in cols])


def tasks(df: DataFrame) -> int:
    """Number of tasks for block pairs: their bytes say nothing about their work, so Spark may not merge them."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _meet(left: DataFrame, right: DataFrame, keys, numbers) -> DataFrame:
    """Join on keys and block numbers, spread over :func:`tasks`."""
    n = tasks(left)
    if keys:
        return null_safe(left, right, keys + numbers).repartition(n, *keys, *numbers)
    return left.repartition(n, *numbers).join(right.repartition(n, *numbers), numbers)


def self_pairs(packed: DataFrame, keys) -> DataFrame:
    """Every unordered pair of blocks of a key once (a block also with itself).

    A block meets itself without a join; only keys of several blocks are joined.
    """
    keys = list(keys)
    cols = [c for c in packed.columns if c not in keys + ["blk", "nblk"]]
    both = [F.col(c).alias(f"{p}_{c}") for p in ("a", "b") for c in cols]
    own = packed.select(*keys, "nblk", F.col("blk").alias("i"), F.col("blk").alias("j"), *both).repartition(tasks(packed), *keys, "i")
    other = packed.filter("nblk > 1").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nblk") - 1)))
    left = other.filter(F.col("blk") < F.col("_o")).select(
        *keys, "nblk", F.col("blk").alias("i"), F.col("_o").alias("j"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = other.filter(F.col("blk") > F.col("_o")).select(
        *keys, F.col("_o").alias("i"), F.col("blk").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return own.unionByName(_meet(left, right, keys, ["i", "j"]))


def cross_pairs(left: DataFrame, right: DataFrame, keys, lp: str = "a_", rp: str = "b_") -> DataFrame:
    """Every (left block, right block) of a key, matched by an equi join on both block numbers."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    ln = left.groupBy(*keys).agg(F.max(f"{lp}nblk").alias("_ln"))
    rn = right.groupBy(*keys).agg(F.max(f"{rp}nblk").alias("_rn"))
    l = attach(left, rn, keys).withColumn(f"{rp}blk", F.explode(F.sequence(zero, F.col("_rn") - 1))).drop("_rn", f"{lp}nblk")
    r = attach(right, ln, keys).withColumn(f"{lp}blk", F.explode(F.sequence(zero, F.col("_ln") - 1))).drop("_ln", f"{rp}nblk")
    return _meet(l, r, keys, [f"{lp}blk", f"{rp}blk"])


def reduce_pairs(pairs: DataFrame, keep, kernel, schema) -> DataFrame:
    """Run ``kernel(row) -> dict of arrays | None`` on each block pair (one Arrow row each).

    ``keep`` columns are repeated on the kernel's output rows; ``schema`` lists
    the kernel's columns as a DDL string.
    """
    keep = list(keep)
    out_schema = T.StructType([pairs.schema[k] for k in keep] + list(T._parse_datatype_string(schema).fields))
    names = [f.name for f in out_schema.fields]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                got = kernel(row)
                if got is None:
                    continue
                size = len(next(iter(got.values())))
                if size:
                    yield pd.DataFrame({**{k: [getattr(row, k)] * size for k in keep}, **got})[names]

    return pairs.mapInPandas(run, out_schema)

"""Regular series: calendar spine, positional windows over bounded chunks, linear recurrences.

A series row has a ``pos`` column, the whole number of steps since the start of
its key.  On a dense series "k rows back" is ``pos - k``, so a window over at
most ``before`` rows back and ``after`` rows ahead can run chunk by chunk: each
chunk of ``chunk_rows`` positions receives copies of the neighbouring rows it
needs.  No task sees more than one chunk of a key, however long the key is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 65_536


def densify(df: DataFrame, keys, ts: str, step: str, fill: dict | None = None) -> DataFrame:
    """Put each key on the table's full calendar (``step`` = day or hour); adds ``pos`` and ``n_steps``.

    ``df`` holds at most one row per key and step, which makes the join below
    reuse the partitioning of the aggregation that produced it.  Missing rows
    take ``fill`` or NULL.
    """
    keys = list(keys)
    unit = {"day": "interval 1 day", "hour": "interval 1 hour"}[step]
    per_key = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    # the span is one row; as a join side it shares the aggregation above, which a subquery would run again
    span = per_key.agg(F.min("_a").alias("_lo"), F.max("_b").alias("_hi")).withColumn("_one", F.lit(1))
    calendar = per_key.withColumn("_one", F.lit(1)).join(F.broadcast(span), "_one").withColumn(
        "_cal", F.expr(f"sequence(_lo, _hi, {unit})"))
    spine = calendar.select(*keys, F.size("_cal").alias("n_steps"), F.posexplode("_cal").alias("pos", ts))
    out = spine.join(df, keys + [ts], "left")
    return out.fillna(fill) if fill else out


class Frame:
    """A chunked view of a series; see :func:`chunked`."""

    def __init__(self, df: DataFrame, keys, pos: str):
        self.df, self.keys, self.pos = df, list(keys), pos
        self.window = W.partitionBy(*self.keys, "_chunk").orderBy(pos)

    def rows(self, lo: int, hi: int):
        return self.window.rowsBetween(lo, hi)

    def select(self, **columns: Column) -> DataFrame:
        """Evaluate window columns, then keep each row's own chunk only."""
        out = self.df.select("*", *[c.alias(n) for n, c in columns.items()])
        return out.filter("_own").drop("_chunk", "_own")


def chunked(df: DataFrame, keys, pos: str, before: int = 0, after: int = 0,
            chunk_rows: int = CHUNK_ROWS) -> Frame:
    """Cut each key into chunks of positions with ``before``/``after`` rows of overlap."""
    size = max(chunk_rows, before + after, 1)
    p = F.col(pos).cast("long")
    own = F.floor(p / size)
    first = F.greatest(F.lit(0).cast("long"), F.floor((p - after) / size))
    last = F.floor((p + before) / size)
    out = df.select("*", F.explode(F.sequence(first, last)).alias("_chunk"))
    return Frame(out.withColumn("_own", F.col("_chunk") == own), keys, pos)


def lag_columns(df: DataFrame, keys, pos: str, specs: dict[str, tuple[str, int]],
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``specs`` = {out: (column, k)}; k > 0 looks back, k < 0 ahead, k = 0 copies."""
    ks = [k for _, k in specs.values()] + [0]
    f = chunked(df, keys, pos, max(max(ks), 0), max(-min(ks), 0), chunk_rows)
    return f.select(**{o: F.lag(c, k).over(f.window) if k else F.col(c) for o, (c, k) in specs.items()})


SCAN_BLOCK = 256


def linear_scan(df: DataFrame, keys, pos: str, value: str, decay: Column, slowest: float,
                fastest: float | None = None, out: str = "state", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """State of ``s(t) = decay * s(t-1) + value(t)`` with ``s(-1) = 0``.

    Three native steps: a scaled running sum inside blocks of 256 positions,
    a sum over the block ends that still matter (``decay`` to a power under
    1e-18 does not), and the carry added back.  ``decay`` is constant per key and
    lies between ``fastest`` (at least 0.08, so that no power underflows) and
    ``slowest`` (below 1).
    """
    if not 0.08 <= (slowest if fastest is None else fastest) <= slowest < 1.0:
        raise ValueError("decay must lie in [0.08, 1)")
    keys = list(keys)
    p = F.col(pos).cast("long")
    d = df.withColumn("_d", decay).withColumn("_blk", F.floor(p / SCAN_BLOCK)).withColumn("_off", p % SCAN_BLOCK)
    w = W.partitionBy(*keys, "_blk").orderBy("_off").rowsBetween(W.unboundedPreceding, 0)
    # weights relative to the block end keep every power at most 1
    scaled = F.sum(F.col(value) * F.pow("_d", SCAN_BLOCK - 1 - F.col("_off"))).over(w)
    d = d.withColumn("_loc", scaled / F.pow("_d", SCAN_BLOCK - 1 - F.col("_off")))
    ends = d.groupBy(*keys, "_blk").agg(
        F.sum(F.col(value) * F.pow("_d", SCAN_BLOCK - 1 - F.col("_off"))).alias("_end"), F.first("_d").alias("_d"))
    reach = max(1, math.ceil(41.5 / (-math.log(slowest) * SCAN_BLOCK)))
    f = chunked(ends, keys, "_blk", before=reach, chunk_rows=chunk_rows)
    block_decay = F.pow("_d", F.lit(float(SCAN_BLOCK)))
    carry = f.select(_carry=F.aggregate(
        F.collect_list("_end").over(f.rows(-reach, -1)),
        F.lit(0.0), lambda acc, x: acc * block_decay + x)).select(*keys, "_blk", "_carry")
    return (d.join(carry, keys + ["_blk"])
            .withColumn(out, F.col("_loc") + F.col("_carry") * F.pow("_d", F.col("_off") + 1))
            .drop("_d", "_blk", "_off", "_loc", "_carry"))

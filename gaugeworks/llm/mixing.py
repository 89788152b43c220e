"""Mixing sources to target weights: repetition rates and hash-seeded copies, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import small_enough, store, table, word_count

#: Weights that sources take in turn, by their order.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and how often a source may repeat.
SHARE, MOST = 1.5, 2
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone (48 bits of an MD5 digest)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    Targets are proportional to the weights up to ``most`` times the source's
    size; the level that uses up ``share`` of all sizes is found exactly by one
    ordered pass over the sources.  A source of size 0 has target and rate 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    total = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after)
    out = (total.withColumn("_nth", F.row_number().over(by_name)).withColumn("_w", w)
           .withColumn("_fill", F.lit(float(most)) * F.col("source_size") / F.col("_w"))
           .withColumn("_level", level)
           .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level"))).over(everything)["_level"])
           .withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) copies, and one more where the draw falls below the fraction."""
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def attach(rows: DataFrame, targets: DataFrame, source: Column) -> DataFrame:
    """Join the few source rows to the many; only a checked number of them is broadcast."""
    right = targets.select(F.struct("source", "source_size", "target", "rate").alias("_t"))
    right = F.broadcast(right) if small_enough(right, BROADCAST_SOURCES) else right
    return rows.join(right, source.eqNullSafe(F.col("_t.source")), "left")


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
              weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row.

    Null text has size 0; null sources form a source of their own; repeated rows
    draw alike.  Texts are read once; what follows works on ids and sizes.
    """
    sized = store(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix")
    joined = attach(sized, store(source_targets(sized, "source", "size", weights, share, most), "mix-targets"), F.col("source"))
    n = copies(F.col("_t.rate"), uniform(seed, F.col("doc_id"))).cast("long")
    return joined.select("doc_id", "size", F.col("_t.source_size").cast("long").alias("source_size"), F.col("_t.target").alias("target"),
                         (n * F.col("size")).alias("taken"), n.alias("copies"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
             weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay as they are."""
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = store(source_targets(sized, "source", "size", weights, share, most), "mix-targets")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = attach(rows, targets, F.col("_row")[source])
    n = copies(F.col("_t.rate"), uniform(seed, F.col("_row")[doc_id])).cast("int")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(1), n)).alias("_copy")).select("_row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)) AS w FROM per_source),
filled AS (SELECT *, 2.0::DOUBLE * source_size / w AS fill FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
chosen AS (SELECT level FROM levels WHERE level <= fill ORDER BY fill, level LIMIT 1),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM chosen), 0.0::DOUBLE) * w) AS target FROM filled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(concat_ws(':', '42', s.doc_id::VARCHAR)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE
      < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rated t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM drawn
"""

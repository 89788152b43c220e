"""Query registry and the input frames that the registered queries share.

Every input is a view of the supplied tables: daily order totals stand in for
station series, hourly events for air quality, shipped quantities and prices for
rainfall and runoff, embedding coordinates for stations and image bands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import series, splits
from ..operators.series import densify


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounding: dict[str, int]


QUERIES: dict[str, Query] = {}


def _parse(rnd: str) -> dict[str, int]:
    """``"6: a b; 2: c"`` -> {a: 6, b: 6, c: 2}."""
    out = {}
    for part in filter(None, (p.strip() for p in rnd.split(";"))):
        digits, names = part.split(":")
        out.update({n: int(digits) for n in names.split()})
    return out


def query(name: str, sql: str | None = None, rnd: str = ""):
    """Register a query; both engines round the columns in ``rnd`` the same way."""
    rounding = _parse(rnd)

    def wrap(fn):
        def run(spark, d):
            df = fn(spark, d)
            return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in rounding.items()}) if rounding else df

        text = sql
        if sql and rounding:
            reps = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in rounding.items())
            text = f"SELECT * REPLACE ({reps}) FROM (\n{sql}\n)"
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, text, rounding)
        return fn

    return wrap


CTE: dict[str, str] = {}


def with_(names: str, body: str) -> str:
    """SQL with the named shared CTEs (in order) in front of ``body``."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ------------------------------------------------------------------ daily series

KEY = ["series_id"]


def order_days(spark, d) -> DataFrame:
    return read(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"))


def daily(spark, d) -> DataFrame:
    """series_id, date, value, pos, n_steps; days without orders are 0."""
    return densify(order_days(spark, d), KEY, "date", "day", {"value": 0.0})


def roled(spark, d) -> DataFrame:
    return splits.time_split(daily(spark, d), KEY, "pos", n="n_steps")


CTE["daily"] = """days AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
    round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM days),
daily AS (SELECT k.series_id, CAST(c.d AS DATE) AS date, coalesce(v.value, 0.0) AS value,
    datediff('day', s.lo, CAST(c.d AS DATE)) AS pos, datediff('day', s.lo, s.hi) + 1 AS n_steps
  FROM (SELECT DISTINCT series_id FROM days) k CROSS JOIN span s
  CROSS JOIN (SELECT unnest(generate_series((SELECT lo FROM span), (SELECT hi FROM span), INTERVAL 1 DAY)) AS d) c
  LEFT JOIN days v ON v.series_id = k.series_id AND v.date = CAST(c.d AS DATE))"""
CTE["roled"] = """roled AS (SELECT *, CASE WHEN pos < floor(n_steps * 0.7::DOUBLE) THEN 'train'
    WHEN pos < floor(n_steps * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM daily)"""


# ------------------------------------------------------------------ hourly stations

STATION = ["station"]


def station_hours(spark, d) -> DataFrame:
    return read(spark, d, "events").groupBy(
        F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("pm25"), F.count(F.lit(1)).cast("double").alias("wind"),
        F.max("value").alias("temp"), F.count_distinct("user_id").cast("double").alias("boundary_layer"))


def hourly(spark, d) -> DataFrame:
    """station, ts, pm25, wind, temp, boundary_layer, pos, n_steps; missing hours stay NULL."""
    return densify(station_hours(spark, d), STATION, "ts", "hour")


def hourly_roled(spark, d) -> DataFrame:
    return splits.time_split(hourly(spark, d), STATION, "pos", n="n_steps")


CTE["hourly"] = """hrs AS (SELECT event_type AS station, date_trunc('hour', ts) AS ts, round(sum(value), 2) / count(*) AS pm25,
    CAST(count(*) AS DOUBLE) AS wind, max(value) AS temp, CAST(count(DISTINCT user_id) AS DOUBLE) AS boundary_layer
  FROM events GROUP BY 1, 2),
hspan AS (SELECT min(ts) AS lo, max(ts) AS hi FROM hrs),
hourly AS (SELECT k.station, c.t AS ts, v.pm25, v.wind, v.temp, v.boundary_layer,
    datediff('hour', s.lo, c.t) AS pos, datediff('hour', s.lo, s.hi) + 1 AS n_steps
  FROM (SELECT DISTINCT station FROM hrs) k CROSS JOIN hspan s
  CROSS JOIN (SELECT unnest(generate_series((SELECT lo FROM hspan), (SELECT hi FROM hspan), INTERVAL 1 HOUR)) AS t) c
  LEFT JOIN hrs v ON v.station = k.station AND v.ts = c.t)"""
CTE["hroled"] = """hroled AS (SELECT *, CASE WHEN pos < floor(n_steps * 0.7::DOUBLE) THEN 'train'
    WHEN pos < floor(n_steps * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM hourly)"""


# ------------------------------------------------------------------ catchments

GAUGE = ["gauge_id"]


def catchment(spark, d) -> DataFrame:
    days = read(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("gauge_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("precip"), F.round(F.sum("l_extendedprice") / 1000.0, 5).alias("streamflow"),
        (F.round(F.sum("l_discount"), 2) * 300.0 / F.count(F.lit(1))).alias("temperature"))
    dense = densify(days, GAUGE, "date", "day", {"precip": 0.0, "streamflow": 0.0, "temperature": 0.0})
    return dense.withColumn("pet", scalars.pet(F.col("temperature"), F.dayofyear("date")))


def catchment_roled(spark, d) -> DataFrame:
    return splits.time_split(catchment(spark, d), GAUGE, "pos", n="n_steps")


CTE["catchment"] = """cdays AS (SELECT l_returnflag AS gauge_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS precip,
    round(sum(l_extendedprice) / 1000.0, 5) AS streamflow, round(sum(l_discount), 2) * 300.0 / count(*) AS temperature
  FROM lineitem GROUP BY 1, 2),
cspan AS (SELECT min(date) AS lo, max(date) AS hi FROM cdays),
cdense AS (SELECT k.gauge_id, CAST(c.d AS DATE) AS date, coalesce(v.precip, 0.0) AS precip,
    coalesce(v.streamflow, 0.0) AS streamflow, coalesce(v.temperature, 0.0) AS temperature,
    datediff('day', s.lo, CAST(c.d AS DATE)) AS pos, datediff('day', s.lo, s.hi) + 1 AS n_steps
  FROM (SELECT DISTINCT gauge_id FROM cdays) k CROSS JOIN cspan s
  CROSS JOIN (SELECT unnest(generate_series((SELECT lo FROM cspan), (SELECT hi FROM cspan), INTERVAL 1 DAY)) AS d) c
  LEFT JOIN cdays v ON v.gauge_id = k.gauge_id AND v.date = CAST(c.d AS DATE)),
catchment AS (SELECT *, greatest(0.6 * (1 + 0.5 * cos(2 * pi() * (dayofyear(date) - 196) / 365.25))
    + 0.12 * greatest(temperature, 0.0), 0.0) AS pet FROM cdense)"""
CTE["croled"] = """croled AS (SELECT *, CASE WHEN pos < floor(n_steps * 0.7::DOUBLE) THEN 'train'
    WHEN pos < floor(n_steps * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM catchment)"""


# ------------------------------------------------------------------ observations

def observations(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("network"), F.col("user_id").alias("station"), "value")


CTE["obs"] = "obs AS (SELECT event_type AS network, user_id AS station, value FROM events)"


# ------------------------------------------------------------------ stations and grid

def _coords(spark, d, odd: int) -> DataFrame:
    e = lambda i: F.round(F.element_at("embedding", i).cast("double") * 100.0, 4)
    return read(spark, d, "embeddings").filter(F.col("vec_id") % 2 == odd).select(
        F.col("vec_id").alias("cell_id" if odd else "id"), e(1).alias("x"), e(2).alias("y"), e(3).alias("cov"),
        e(4).alias("truth" if odd else "value"))


def stations(spark, d) -> DataFrame:
    return _coords(spark, d, 0)


def cells(spark, d) -> DataFrame:
    return _coords(spark, d, 1)


CTE["coords"] = """coords AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 100.0, 4) AS x,
    round(CAST(embedding[2] AS DOUBLE) * 100.0, 4) AS y, round(CAST(embedding[3] AS DOUBLE) * 100.0, 4) AS cov,
    round(CAST(embedding[4] AS DOUBLE) * 100.0, 4) AS v FROM embeddings)"""
CTE["stations"] = "stations AS (SELECT vec_id AS id, x, y, cov, v AS value FROM coords WHERE vec_id % 2 = 0)"
CTE["cells"] = "cells AS (SELECT vec_id AS cell_id, x, y, cov, v AS truth FROM coords WHERE vec_id % 2 = 1)"


# ------------------------------------------------------------------ image patches

BAND_SLICES = {"blue": 1, "green": 13, "red": 25, "nir": 37, "swir": 49}


def patches(spark, d) -> DataFrame:
    band = lambda s: F.transform(F.slice("embedding", s, 12), lambda v: (v.cast("double") + 1.0) / 2.0)
    return read(spark, d, "embeddings").select(
        F.col("vec_id").alias("patch_id"), "label", *[band(s).alias(b) for b, s in BAND_SLICES.items()])


def patch_pairs(spark, d):
    """(t0, t1): neighbouring vectors share a patch_id; ``label`` differs where the cover changed."""
    p = patches(spark, d)
    half = F.floor(F.col("patch_id") / 2)
    return (p.filter(F.col("patch_id") % 2 == 0).withColumn("patch_id", half),
            p.filter(F.col("patch_id") % 2 == 1).withColumn("patch_id", half))


CTE["patches"] = "patches AS (SELECT vec_id AS patch_id, label, " + ", ".join(
    f"list_transform(embedding[{s}:{s + 11}], lambda v: (CAST(v AS DOUBLE) + 1.0) / 2.0) AS {b}" for b, s in BAND_SLICES.items()) \
    + " FROM embeddings)"
CTE["ndvi"] = """ndvi AS (SELECT patch_id, label, list_avg(list_transform(list_zip(nir, red),
    lambda z: (z[1] - z[2]) / (z[1] + z[2] + 1e-6))) AS ndvi FROM patches)"""
CTE["drops"] = """drops AS (SELECT a.patch_id // 2 AS patch_id, a.ndvi AS ndvi0, b.ndvi AS ndvi1, a.ndvi - b.ndvi AS "drop",
    CAST(a.label <> b.label AS INTEGER) AS changed FROM ndvi a JOIN ndvi b ON b.patch_id = a.patch_id + 1
    WHERE a.patch_id % 2 = 0)"""


# ------------------------------------------------------------------ predictions and scores

def predictions(spark, d) -> DataFrame:
    """Two simple price models for every line item: (key, method, y_true, y_pred)."""
    li = read(spark, d, "lineitem")
    m = F.explode(F.array(F.struct(F.lit("linear").alias("method"), (F.col("l_quantity") * 1.5).alias("y_pred")),
                          F.struct(F.lit("discounted").alias("method"),
                                   (F.col("l_quantity") * 1.5 * (1 - F.col("l_discount"))).alias("y_pred"))))
    return li.select(F.col("l_returnflag").alias("key"), "l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") / 1000.0).alias("y_true"), m.alias("m")).select(
        "key", "l_orderkey", "l_linenumber", "y_true", "m.method", "m.y_pred")


CTE["preds"] = """preds AS (SELECT l_returnflag AS key, l_orderkey, l_linenumber, l_extendedprice / 1000.0 AS y_true,
    unnest(['linear', 'discounted']) AS method,
    unnest([l_quantity * 1.5, l_quantity * 1.5 * (1 - l_discount)]) AS y_pred FROM lineitem)"""


def probability(spark, d) -> DataFrame:
    """label y and a score from document length."""
    lab = read(spark, d, "labels").filter(F.col("quality").isNotNull())
    doc = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(doc, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"),
                                          F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("p"),
                                          F.log1p("n_chars").alias("surface"))


CTE["prob"] = """prob AS (SELECT l.doc_id, d.lang, l.quality AS y, least(1.0, d.n_chars / 8000.0) AS p, ln(1 + d.n_chars) AS surface
    FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"""


# one normal-distribution formula for both engines (Abramowitz & Stegun 7.1.26)
SQL_MACROS_P = ("2.0 * (1.0 - 0.5 * (1.0 + (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} "
                "- 0.284496736) * {t} + 0.254829592) * {t} * exp(-({a}) * ({a})))))")


def sql_two_sided_p(z: str) -> str:
    a = f"(abs({z}) / sqrt(2.0))"
    return SQL_MACROS_P.format(t=f"(1.0 / (1.0 + 0.3275911 * {a}))", a=a)

"""Scans, scalar features, window features, splits and baseline forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..contracts import assert_contract
from ..functions import scalars
from ..operators import features, forecast, metrics, score, splits, trend
from ..operators.series import lag_columns
from ..sources import io
from .base import (GAUGE, KEY, STATION, catchment, cells, daily, hourly, hourly_roled, query, read, roled, with_)

# ================================================================== scans


@query("s1_contract_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS date,
    o_totalprice AS value FROM orders""")
def _(spark, d):
    df = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("series_id"),
                                         F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))
    return assert_contract(df, "daily_series")


@query("s2_json_map_scan", """SELECT event_type AS event, j.key AS field, CAST(json_extract(props, '$.' || j.key) AS BIGINT) AS amount, event_id
    FROM (SELECT *, unnest(json_keys(props)) AS key FROM events) j""")
def _(spark, d):
    m = io.json_map(F.col("props"), "bigint")
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.explode(m).alias("field", "amount"))


@query("s7_result_pages", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("s8_provenance")
def _(spark, d):
    return io.provenance(spark, f"{d}/nation.parquet", "supplied tables", {"tables": "all"}).drop("modificationTime", "path")


# ================================================================== scalar features


@query("p1_calendar_features", """SELECT event_id, hour(ts) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, dayofyear(ts) AS doy,
    CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend FROM events""")
def _(spark, d):
    return features.calendar(read(spark, d, "events"), "ts").select("event_id", "hour", "dow", "doy", "is_weekend")


@query("p2_cyclical_encoding", """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
    sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM events""",
       "6: hour_sin hour_cos dow_sin dow_cos")
def _(spark, d):
    c = {**scalars.cyclical(F.hour("ts"), 24, "hour"), **scalars.cyclical(F.weekday("ts"), 7, "dow")}
    return read(spark, d, "events").select("event_id", *[v.alias(k) for k, v in c.items()])


@query("p3_day_of_year_cycle", with_("daily", """SELECT series_id, pos, sin(2 * pi() * dayofyear(date) / 365.25) AS doy_sin,
    cos(2 * pi() * dayofyear(date) / 365.25) AS doy_cos, sin(2 * pi() * (pos % 365 + 1) / 365.25) AS fallback_sin FROM daily"""),
       "6: doy_sin doy_cos fallback_sin")
def _(spark, d):
    real, plain = scalars.doy_cycle(F.col("date")), scalars.doy_cycle(pos=F.col("pos"))
    return daily(spark, d).select("series_id", "pos", *[v.alias(k) for k, v in real.items()], plain["doy_sin"].alias("fallback_sin"))


@query("p3b_zero_based_year_cycle", with_("daily", """SELECT series_id, pos, sin(2 * pi() * (pos % 365) / 365.0) AS doy_sin,
    cos(2 * pi() * (pos % 365) / 365.0) AS doy_cos FROM daily"""), "6: doy_sin doy_cos")
def _(spark, d):
    c = scalars.doy_cycle(pos=F.col("pos"), period=365, zero_based=True)
    return daily(spark, d).select("series_id", "pos", *[v.alias(k) for k, v in c.items()])


@query("p4_standardize", with_("daily roled", """SELECT r.series_id, r.pos, (r.value - s.mu) / (s.sd + 1e-8) AS value_z FROM roled r
    JOIN (SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM roled WHERE role = 'train' GROUP BY 1) s USING (series_id)"""),
       "6: value_z")
def _(spark, d):
    return features.standardize(roled(spark, d), KEY, ["value"], F.col("role") == "train").select("series_id", "pos", "value_z")


@query("p5_spatial_design", with_("coords cells", """SELECT cell_id, x / 40.0 AS fx, y / 40.0 AS fy, cov AS fcov, (x / 40.0) * (y / 40.0) AS fxy,
    cov * cov AS fcov2, (x / 40.0) * cov AS fxcov, (y / 40.0) * cov AS fycov FROM cells"""))
def _(spark, d):
    c = scalars.spatial_design(F.col("x"), F.col("y"), F.col("cov"), 40.0)
    return cells(spark, d).select("cell_id", *[v.alias(k) for k, v in c.items()])


@query("p6_glm_design", with_("coords", "SELECT vec_id, x AS t, y AS p, cov AS e, x * x AS t2, y * y AS p2 FROM coords"), "6: t p e t2 p2")
def _(spark, d):
    e = lambda i: F.round(F.element_at("embedding", i).cast("double") * 100.0, 4)
    return read(spark, d, "embeddings").select("vec_id", *[v.alias(k) for k, v in scalars.glm_design(e(1), e(2), e(3)).items()])


@query("p7_covariate_stack", with_("coords cells", "SELECT cell_id, [x, y, cov] AS features FROM cells"))
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    from ..operators.models import assemble
    return assemble(cells(spark, d), ["x", "y", "cov"]).select("cell_id", vector_to_array("features").alias("features"))


@query("p8_exceedance_label", "SELECT event_id, CAST(value > 60.0 AS INTEGER) AS exceeds FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", scalars.exceeds(F.col("value"), F.lit(60.0)).alias("exceeds"))


@query("p9_nonnegative_clip", "SELECT c_custkey, greatest(c_acctbal, 0.0) AS balance FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", scalars.clip_min(F.col("c_acctbal")).alias("balance"))


@query("p10_complete_cases", with_("hourly", "SELECT station, ts, pm25, wind FROM hourly WHERE pm25 IS NOT NULL AND wind IS NOT NULL"))
def _(spark, d):
    return features.complete_cases(hourly(spark, d), ["pm25", "wind"]).select("station", "ts", "pm25", "wind")


@query("p11_finite_filter", """SELECT l_orderkey, l_linenumber, ratio FROM (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE WHEN l_tax = 0 THEN 'NaN'::DOUBLE ELSE l_tax / l_discount END AS ratio FROM lineitem)
    WHERE isfinite(ratio)""", "6: ratio")
def _(spark, d):
    r = (F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan")))
         .otherwise(F.col("l_tax") / F.col("l_discount")))
    return features.finite(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("ratio")), ["ratio"])


@query("p14_regime_bins", with_("daily", """SELECT series_id, pos, CAST(least(greatest(floor((round(sin(2 * pi() * pos / 1825.0), 9) + 1) / 2 * 3), 0), 2) AS INTEGER)
    AS regime FROM daily"""))
def _(spark, d):
    phase = F.round(F.sin(F.lit(2.0) * F.pi() * F.col("pos") / 1825.0), 9)
    return daily(spark, d).select("series_id", "pos", scalars.regime_bins(phase, 3).alias("regime"))


@query("p15_pet", with_("catchment", "SELECT gauge_id, date, pet FROM catchment"), "6: pet")
def _(spark, d):
    return catchment(spark, d).select("gauge_id", "date", "pet")


# ================================================================== ordered windows


@query("w1_lag_block", with_("daily roled", """SELECT series_id, pos, role, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
    lag(value, 3) OVER w AS value_lag3 FROM roled WINDOW w AS (PARTITION BY series_id ORDER BY pos)"""), "2: value value_lag1 value_lag2 value_lag3")
def _(spark, d):
    return features.lags(roled(spark, d), KEY, "pos", "value", 3).select(
        "series_id", "pos", "role", "value", "value_lag1", "value_lag2", "value_lag3")


@query("w1_lag_block_reset", with_("daily roled", """SELECT series_id, role, count(*) AS n_rows, count(l7) AS n_complete FROM (
    SELECT series_id, role, lag(value, 7) OVER (PARTITION BY series_id, role ORDER BY pos) AS l7 FROM roled) GROUP BY 1, 2"""))
def _(spark, d):
    f = features.lags(roled(spark, d), KEY, "pos", "value", 7, reset_by="role")
    return f.groupBy("series_id", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value_lag7").alias("n_complete"))


@query("w2_ar_design", with_("daily", """SELECT * FROM (SELECT series_id, pos, value, lag(value, 1) OVER w AS value_lag1, lag(value, 6) OVER w AS value_lag6
    FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY pos)) WHERE value_lag6 IS NOT NULL"""), "2: value value_lag1 value_lag6")
def _(spark, d):
    f = features.lags(daily(spark, d), KEY, "pos", "value", 6)
    return features.complete_cases(f, [f"value_lag{i}" for i in range(1, 7)]).select("series_id", "pos", "value", "value_lag1", "value_lag6")


_NOW_LAGS = ", ".join(f"lag(pm25, {k}) OVER w AS pm25_lag{k}" for k in range(1, 7))
_NOW_ROLL = ", ".join(
    f"CASE WHEN count(pm25) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN "
    f"avg(pm25) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS pm25_roll{k}" for k in (3, 6, 12))
_NOW_COV = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in ("wind", "temp", "boundary_layer") for k in (0, 1, 2))


@query("w3_nowcast_frame", with_("hourly", f"""SELECT station, pos, pm25, {_NOW_LAGS}, {_NOW_ROLL}, {_NOW_COV},
    sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin,
    cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM hourly WINDOW w AS (PARTITION BY station ORDER BY pos)"""),
       "9: pm25_roll3 pm25_roll6 pm25_roll12 hour_sin hour_cos dow_sin dow_cos")
def _(spark, d):
    f, names = features.nowcast_frame(hourly(spark, d), STATION, "pos", "ts", "pm25", ["wind", "temp", "boundary_layer"])
    return f.select("station", "pos", "pm25", *names)


def _rolling_sql(agg, lo, hi, out):
    fr = f"(PARTITION BY series_id ORDER BY pos ROWS BETWEEN {lo} PRECEDING AND {hi})"
    n = lo + 1 if hi == "CURRENT ROW" else lo
    return with_("daily", f"SELECT series_id, pos, CASE WHEN count(value) OVER {fr} = {n} THEN {agg}(value) OVER {fr} END AS {out} FROM daily")


@query("w4_rolling_mean", _rolling_sql("avg", 7, "1 PRECEDING", "mean7"), "3: mean7")
def _(spark, d):
    return features.rolling(daily(spark, d), KEY, "pos", "value", 7, "avg", "mean7", include_current=False).select("series_id", "pos", "mean7")


@query("w5_rolling_sum", _rolling_sql("sum", 4, "CURRENT ROW", "sum5"), "2: sum5")
def _(spark, d):
    return features.rolling(daily(spark, d), KEY, "pos", "value", 5, "sum", "sum5", include_current=True).select("series_id", "pos", "sum5")


def _persist_sql(h):
    return f"""SELECT series_id, date, pos, 'persistence' AS method, {h} AS horizon, value AS y_true, p AS y_pred FROM (
    SELECT *, lag(value, {h}) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM roled) WHERE role = 'test'"""


def _seasonal_sql(h):
    return f"""SELECT series_id, date, pos, 'seasonal_naive' AS method, {h} AS horizon, value AS y_true, p AS y_pred FROM (
    SELECT *, coalesce(lag(value, 365) OVER w, lag(value, {h}) OVER w, first_value(value) OVER w) AS p FROM roled
    WINDOW w AS (PARTITION BY series_id ORDER BY pos)) WHERE role = 'test'"""


@query("w6_persistence_forecast", with_("daily roled", _persist_sql(7)), "2: y_true y_pred")
def _(spark, d):
    return forecast.persistence(roled(spark, d), KEY, "date", "pos", "value", 7)


@query("w7_persistence_clipped", with_("hourly hroled", """SELECT station, ts, pos, 'persistence' AS method, 1 AS horizon, pm25 AS y_true,
    CASE WHEN p IS NOT NULL THEN greatest(p, 0.0) END AS y_pred FROM (SELECT *, lag(pm25, 1) OVER (PARTITION BY station ORDER BY pos) AS p FROM hroled)
    WHERE role = 'test'"""))
def _(spark, d):
    return forecast.persistence(hourly_roled(spark, d), STATION, "ts", "pos", "pm25", 1, clip=0.0)


@query("w8_seasonal_naive", with_("daily roled", _seasonal_sql(7)), "2: y_true y_pred")
def _(spark, d):
    return forecast.seasonal_naive(roled(spark, d), KEY, "date", "pos", "value", 7)


@query("w9_time_split", with_("daily roled", "SELECT series_id, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM roled GROUP BY 1, 2"))
def _(spark, d):
    return roled(spark, d).groupBy("series_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query("w10_calibration_split", with_("daily", """SELECT series_id, pos, CASE WHEN pos < floor(n_steps * 0.6::DOUBLE) THEN 'train'
    WHEN pos < floor(n_steps * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS role FROM daily"""))
def _(spark, d):
    return splits.time_split(daily(spark, d), KEY, "pos", 0.6, 0.2, n="n_steps").select("series_id", "pos", "role")


def _walk_sql(n_blocks, n_initial, frac, gap):
    return with_("daily", f"""SELECT series_id, pos, fold_id, role, 'walk-forward-block-' || (fold_id + {n_initial}) AS regime_label FROM (
    SELECT *, CASE WHEN pos < tv - nv THEN 'train' WHEN pos < tv THEN 'val' WHEN pos < t0 THEN 'purged' WHEN pos < t1 THEN 'test' END AS role FROM (
      SELECT *, greatest(1, CAST(round_even(tv * {frac}::DOUBLE, 0) AS BIGINT)) AS nv FROM (
        SELECT *, t0 - {gap} AS tv FROM (
          SELECT series_id, pos, fold_id, CAST(round_even(n_steps / {n_blocks}.0::DOUBLE * (fold_id + {n_initial}), 0) AS BIGINT) AS t0,
            CAST(round_even(n_steps / {n_blocks}.0::DOUBLE * (fold_id + {n_initial} + 1), 0) AS BIGINT) AS t1
          FROM daily, (SELECT CAST(unnest(range({n_blocks - n_initial})) AS INTEGER) AS fold_id) f)))) WHERE role IS NOT NULL""")


@query("w11_walk_forward_folds", _walk_sql(7, 3, 0.15, 1))
def _(spark, d):
    return splits.walk_forward(daily(spark, d), KEY, "pos", 7, 3, n="n_steps").select("series_id", "pos", "fold_id", "role", "regime_label")


@query("w12_super_fold", with_("daily", """SELECT series_id, pos, regime, 0 AS fold_id, CASE WHEN i >= nr - t THEN 'test' WHEN i >= nr - t - v THEN 'val'
    WHEN i >= nr - t - v - 5 THEN 'purged' ELSE 'train' END AS role FROM (
  SELECT *, CASE WHEN t0 + t0 >= nr THEN greatest(1, nr // 3) ELSE t0 END AS t, CASE WHEN t0 + t0 >= nr THEN greatest(1, nr // 3) ELSE t0 END AS v FROM (
    SELECT *, greatest(1, CAST(round_even(nr * 0.15::DOUBLE, 0) AS BIGINT)) AS t0 FROM (
      SELECT series_id, pos, regime, row_number() OVER (PARTITION BY series_id, regime ORDER BY pos) - 1 AS i,
        count(*) OVER (PARTITION BY series_id, regime) AS nr FROM (SELECT series_id, pos, month(date) % 3 AS regime FROM daily))))"""))
def _(spark, d):
    x = daily(spark, d).withColumn("regime", (F.month("date") % 3).cast("long"))
    # a regime is part of one calendar, so its length is bounded by the record
    return splits.super_fold(x, KEY, "regime", "pos", buffer=5, hot_rows=None).select("series_id", "pos", "regime", "fold_id", "role")


@query("w17_supervised_windows", with_("daily", """SELECT series_id, pos + 7 AS target_pos, y, list_sum(x) AS x_sum, x[1] AS x_first, x[30] AS x_last FROM (
    SELECT series_id, pos, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS x,
      lead(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS y FROM daily) WHERE len(x) = 30 AND y IS NOT NULL"""), "2: y x_sum x_first x_last")
def _(spark, d):
    w = features.windows(daily(spark, d), KEY, "pos", ["value"], "value", 30, 7)
    v = F.transform("x", lambda s: s["value"])
    return w.select("series_id", "target_pos", "y", F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    F.element_at(v, 1).alias("x_first"), F.element_at(v, -1).alias("x_last"))


@query("w18_lookback_windows", with_("catchment", """SELECT gauge_id, pos AS target_pos, y, p[1] AS p_first, t[45] AS t_last FROM (
    SELECT gauge_id, pos, streamflow AS y, list(precip) OVER w AS p, list(temperature) OVER w AS t FROM catchment
    WINDOW w AS (PARTITION BY gauge_id ORDER BY pos ROWS BETWEEN 44 PRECEDING AND CURRENT ROW)) WHERE len(p) = 45"""), "5: y p_first t_last")
def _(spark, d):
    w = features.windows(catchment(spark, d), GAUGE, "pos", ["precip", "temperature", "pet"], "streamflow", 45, 0)
    return w.select("gauge_id", "target_pos", "y", F.element_at("x", 1)["precip"].alias("p_first"), F.element_at("x", -1)["temperature"].alias("t_last"))


@query("w19_lag1_autocorrelation", with_("daily", """SELECT series_id, corr(value, p) AS r1 FROM (
    SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM daily) WHERE p IS NOT NULL GROUP BY 1"""), "6: r1")
def _(spark, d):
    return trend.lag1_autocorr(daily(spark, d), KEY, "pos", "value")


@query("w24_context_lookback", with_("daily", """SELECT series_id, pos + 14 AS target_pos, y, x[1] AS x_first, x[64] AS x_last FROM (
    SELECT series_id, pos, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS x,
      lead(value, 14) OVER (PARTITION BY series_id ORDER BY pos) AS y FROM daily) WHERE len(x) = 64 AND y IS NOT NULL AND (pos + 14) % 2 = 0"""),
       "2: y x_first x_last")
def _(spark, d):
    w = features.windows(daily(spark, d), KEY, "pos", ["value"], "value", 64, 14, stride=2)
    return w.select("series_id", "target_pos", "y", F.element_at("x", 1)["value"].alias("x_first"), F.element_at("x", -1)["value"].alias("x_last"))


@query("w25_slice_stride_shift", with_("hourly", """SELECT station, ts, pm25, wind_shift FROM (
    SELECT *, lag(wind, 24) OVER (PARTITION BY station ORDER BY pos) AS wind_shift FROM hourly)
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND pos % 6 = 0"""))
def _(spark, d):
    f = features.slice_shift(hourly(spark, d), STATION, "pos", "ts", "2024-01-05", "2024-01-20", 6, {"wind": 24})
    return f.select("station", "ts", "pm25", "wind_shift")


# ================================================================== linear forecasters and joins


@query("w21_ar_rolling_forecast")
def _(spark, d):
    return forecast.ar_rolling(roled(spark, d), KEY, "date", "pos", "value", 7, 14)


@query("w22_linear_ar_forecast")
def _(spark, d):
    return forecast.ar_one_step(hourly_roled(spark, d), STATION, "ts", "pos", "pm25", 6)


_HORIZONS = (1, 7, 14)
_ALL_SQL = " UNION ALL ".join(f"({s(h)})" for h in _HORIZONS for s in (_persist_sql, _seasonal_sql))


@query("j4_prediction_alignment", with_("daily roled", f"""SELECT series_id, date, horizon, method, y_true, y_pred FROM (
    SELECT *, count(*) OVER (PARTITION BY series_id, date, horizon) AS m FROM ({_ALL_SQL}) WHERE y_pred IS NOT NULL) WHERE m = 2"""), "2: y_true y_pred")
def _(spark, d):
    p = forecast.temperature_baselines(roled(spark, d), KEY, "date", "pos", "value", _HORIZONS)
    return score.align(p, ["series_id", "horizon"], "date", 2).select("series_id", "date", "horizon", "method", "y_true", "y_pred")


_BASE_SQL = with_("daily roled", f"""SELECT m.series_id, m.horizon, m.method, m.rmse, m.mae, m.acc, 1 - m.rmse / (r.rmse + 1e-12) AS skill FROM (
  SELECT series_id, horizon, method, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
    sum((y_true - c) * (y_pred - c)) / sqrt(sum(pow(y_true - c, 2)) * sum(pow(y_pred - c, 2))) AS acc FROM (
      SELECT *, avg(y_true) OVER (PARTITION BY series_id, horizon, method) AS c FROM ({_ALL_SQL})) GROUP BY 1, 2, 3) m JOIN (
  SELECT series_id, horizon, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM ({_ALL_SQL}) WHERE method = 'persistence' GROUP BY 1, 2) r
  USING (series_id, horizon)""")


def temperature_baselines(spark, d) -> DataFrame:
    p = forecast.temperature_baselines(roled(spark, d), KEY, "date", "pos", "value", _HORIZONS)
    m = metrics.table(p, ["series_id", "horizon", "method"], ["rmse", "mae", "acc"])
    return score.skill_against(m, ["series_id", "horizon"], "persistence").select(
        "series_id", "horizon", "method", "rmse", "mae", "acc", "skill")


query("c1_forecast_baselines", _BASE_SQL, "4: rmse mae; 6: acc skill")(temperature_baselines)


@query("j5_test_membership", with_("daily roled", """SELECT series_id, pos, value FROM daily WHERE (series_id, pos) IN (SELECT (series_id, pos) FROM roled WHERE role = 'test')"""), "2: value")
def _(spark, d):
    x = daily(spark, d)
    return splits.restrict(x, roled(spark, d).filter("role = 'test'"), ["series_id", "pos"]).select("series_id", "pos", "value")


@query("j9_resample_join", """SELECT a.day AS ts, a.v AS price, b.v AS quantity FROM
    (SELECT date_trunc('month', o_orderdate) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1) a JOIN
    (SELECT date_trunc('month', l_shipdate) AS day, avg(l_quantity) AS v FROM lineitem GROUP BY 1) b ON a.day = b.day""", "4: price quantity")
def _(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    b = read(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"))
    return features.resample_join(a, b, [], "ts", "month", ["price"], ["quantity"])


@query("j11_threshold_broadcast", """SELECT e.event_id, CAST(e.value > t.thr AS INTEGER) AS exceeds FROM events e JOIN
    (SELECT event_type, quantile_cont(value, 0.9) AS thr FROM events GROUP BY 1) t USING (event_type)""")
def _(spark, d):
    from ..operators import extremes
    e = read(spark, d, "events")
    thr = extremes.threshold(e, ["event_type"], "value", 0.9, "thr")
    return e.join(thr, "event_type").select("event_id", scalars.exceeds(F.col("value"), F.col("thr")).alias("exceeds"))


# ================================================================== splits


@query("u3_train_tail_union", with_("daily roled", """SELECT series_id, pos, role FROM roled r WHERE role = 'test' UNION ALL
    SELECT r.series_id, r.pos, r.role FROM roled r WHERE role = 'val' AND pos >= floor(n_steps * 0.85::DOUBLE) - 30"""))
def _(spark, d):
    r = roled(spark, d)
    tail = r.filter((F.col("role") == "val") & (F.col("pos") >= F.floor(F.col("n_steps") * F.lit(0.85)) - 30))
    return r.filter("role = 'test'").unionByName(tail).select("series_id", "pos", "role")


@query("u4_fold_overlaps", f"SELECT fold_id, series_id, pos, n_roles FROM (SELECT fold_id, series_id, pos, count(DISTINCT role) AS n_roles FROM ({_walk_sql(7, 3, 0.15, 1)}) GROUP BY 1, 2, 3) WHERE n_roles > 1")
def _(spark, d):
    folds = splits.walk_forward(daily(spark, d), KEY, "pos", 7, 3, n="n_steps")
    return splits.overlaps(folds, ["series_id", "pos"])


@query("i20_hash_split", """SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM (
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0|' || o_orderkey)) AS rn,
      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def _(spark, d):
    return splits.hash_split(read(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", {"train": 0.7, "test": 0.3}).select("o_orderkey", "role")


@query("f3_splitter_registry", _walk_sql(5, 2, 0.2, 3).replace("'walk-forward-block-' || (fold_id + 2) AS regime_label", "'x' AS tag"))
def _(spark, d):
    f = splits.create("walk_forward")(daily(spark, d), KEY, "pos", n_blocks=5, n_initial=2, val_fraction=0.2, gap=3, n="n_steps")
    return f.select("series_id", "pos", "fold_id", "role", F.lit("x").alias("tag"))


@query("f4_skill_vs_persistence", with_("daily roled", """SELECT series_id, 1 - sqrt(avg(pow(value - s, 2))) / (sqrt(avg(pow(value - p, 2))) + 1e-12) AS skill, count(*) AS n FROM (
    SELECT series_id, role, value, lag(value, 1) OVER w AS p, lag(value, 7) OVER w AS s FROM roled WINDOW w AS (PARTITION BY series_id ORDER BY pos))
    WHERE role = 'test' AND s IS NOT NULL GROUP BY 1"""), "6: skill")
def _(spark, d):
    """A weekly naive forecast scored against the last value."""
    from ..functions.skill import primary
    f = lag_columns(roled(spark, d), KEY, "pos", {"reference_pred": ("value", 1), "y_pred": ("value", 7)})
    f = f.filter("role = 'test' AND y_pred IS NOT NULL").withColumnRenamed("value", "y_true")
    return f.groupBy(*KEY).agg(primary("skill_vs_persistence").alias("skill"), F.count(F.lit(1)).alias("n"))


@query("f4_primary_metric", """SELECT l_returnflag AS key, sqrt(avg(pow(l_extendedprice / 1000.0 - l_quantity * 1.5, 2))) AS rmse,
    avg(abs(l_extendedprice / 1000.0 - l_quantity * 1.5)) AS mae FROM lineitem GROUP BY 1""", "6: rmse mae")
def _(spark, d):
    from ..functions.skill import primary
    p = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), (F.col("l_extendedprice") / 1000.0).alias("y_true"),
                                          (F.col("l_quantity") * 1.5).alias("y_pred"))
    return p.groupBy("key").agg(primary("lat_weighted_rmse").alias("rmse"), primary("mae").alias("mae"))


@query("f5_backbones")
def _(spark, d):
    r = roled(spark, d)
    parts = [forecast.backbone(n)(r, KEY, "date", "pos", "value", 1) for n in ("persistence", "seasonal_naive", "ridge")]
    return metrics.table(reduce(DataFrame.unionByName, parts), ["series_id", "method"], ["rmse", "mae"])


@query("f6_forecaster_contract", with_("daily roled", _persist_sql(1)), "2: y_true y_pred")
def _(spark, d):
    return forecast.backbone("persistence")(roled(spark, d), KEY, "date", "pos", "value", 1)


@query("s6_whitespace_text", "SELECT c_custkey AS station, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def _(spark, d):
    from ..session import shared_dir
    path = shared_dir(spark, "text")
    c = read(spark, d, "customer")
    c.select(F.concat(F.lit("  "), F.col("c_custkey"), F.lit("   "), F.col("c_nationkey"), F.lit("\t "), F.col("c_acctbal")).alias("value")).write.text(path)
    return io.scan_whitespace(spark, path, {"station": "bigint", "nation": "int", "balance": "double"})


@query("p17_wet_days", with_("daily", "SELECT series_id, date, value FROM daily WHERE value > 0"), "2: value")
def _(spark, d):
    return daily(spark, d).filter(F.col("value") > 0).select("series_id", "date", "value")

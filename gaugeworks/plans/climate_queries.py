"""Extremes, trends, intervals, hierarchy and catchments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extremes, forecast, hier, hydro, intervals, metrics, models, profile, score, splits, trend
from ..session import store
from .base import (CTE, GAUGE, KEY, STATION, catchment, catchment_roled, daily, hourly, hourly_roled, observations, query,
                   read, roled, sql_two_sided_p, with_)

# ================================================================== block maxima and indices

CTE["amax"] = "amax AS (SELECT series_id, CAST(year(date) AS INTEGER) AS year, max(value) AS value FROM daily GROUP BY 1, 2)"
CTE["rx5"] = """rx5 AS (SELECT series_id, CAST(year(date) AS INTEGER) AS year, round(max(s), 2) AS value FROM (SELECT series_id, date,
    CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END AS s FROM daily
    WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE s IS NOT NULL GROUP BY 1, 2)"""
CTE["r95"] = """r95 AS (SELECT d.series_id, CAST(year(d.date) AS INTEGER) AS year, round(sum(CASE WHEN d.value > t.thr THEN d.value ELSE 0.0 END), 2) AS value
    FROM daily d JOIN (SELECT series_id, quantile_cont(value, 0.95) AS thr FROM daily WHERE value > 0 GROUP BY 1) t USING (series_id) GROUP BY 1, 2)"""


def amax(spark, d):
    return extremes.annual_maxima(daily(spark, d), KEY, "date", "value")


def rx5(spark, d):
    return extremes.rx5day(daily(spark, d), KEY, "pos", "date", "value").withColumn("value", F.round("value", 2))


def r95(spark, d):
    # a daily record: one value per day and key, so the key is bounded by the calendar
    return extremes.r95p(daily(spark, d), KEY, "date", "value", hot_rows=None).withColumn("value", F.round("value", 2))


@query("g22_annual_maxima", with_("daily amax", "SELECT * FROM amax"), "2: value")
def _(spark, d):
    return amax(spark, d)


@query("x1_rx5day", with_("daily rx5", "SELECT * FROM rx5"), "2: value")
def _(spark, d):
    return rx5(spark, d)


@query("x3_r95p", with_("daily r95", "SELECT * FROM r95"), "2: value")
def _(spark, d):
    return r95(spark, d)


@query("x2_empirical_return_level", with_("daily amax", """SELECT series_id, t AS period, quantile_cont(value, 1 - 1 / t) AS level FROM amax,
    (SELECT unnest([2.0::DOUBLE, 5.0, 10.0, 20.0]) AS t) GROUP BY 1, 2""").replace("quantile_cont(value, 1 - 1 / t) AS level",
       "CASE t WHEN 2 THEN quantile_cont(value, 0.5) WHEN 5 THEN quantile_cont(value, 0.8) WHEN 10 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 0.95) END AS level"),
       "3: level")
def _(spark, d):
    return extremes.empirical_return_level(amax(spark, d), KEY, "value", [2, 5, 10, 20])


@query("x13_exceedance_threshold", "SELECT event_type, quantile_cont(value, 0.9) AS threshold FROM events GROUP BY 1", "6: threshold")
def _(spark, d):
    return extremes.threshold(read(spark, d, "events"), ["event_type"], "value")


CTE["mk"] = f"""mkp AS (SELECT a.series_id, sum(sign(b.value - a.value)) AS s FROM months a JOIN months b ON b.series_id = a.series_id AND b.t > a.t GROUP BY 1),
mkt AS (SELECT series_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT series_id, value, count(*) AS c FROM months GROUP BY 1, 2) GROUP BY 1),
mkz AS (SELECT series_id, CAST(s AS BIGINT) AS s, CAST(n AS BIGINT) AS n, CASE WHEN var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS z FROM (
  SELECT series_id, s, n, (n * (n - 1) * (2 * n + 5) - tie) / 18.0::DOUBLE AS var FROM mkp JOIN mkt USING (series_id))),
mk AS (SELECT series_id, s, z, {sql_two_sided_p('z')} AS p_value, n FROM mkz)"""
CTE["months"] = """months AS (SELECT series_id, (year(date) - 1995) * 12 + month(date) - 1 AS t, round(max(value), 2) AS value FROM daily GROUP BY 1, 2)"""
CTE["sen"] = """sen AS (SELECT a.series_id, quantile_cont((b.value - a.value) / (b.t - a.t), 0.5) AS sen_slope FROM months a
    JOIN months b ON b.series_id = a.series_id AND b.t > a.t GROUP BY 1)"""


def months(spark, d):
    t = ((F.year("date") - 1995) * 12 + F.month("date") - 1).cast("long")
    return daily(spark, d).groupBy("series_id", t.alias("t")).agg(F.round(F.max("value"), 2).alias("value"))


@query("j3_time_pairs", with_("daily months", """SELECT a.series_id, count(*) AS n_pairs, sum(CAST(b.value > a.value AS BIGINT)) AS n_up FROM months a
    JOIN months b ON b.series_id = a.series_id AND b.t > a.t GROUP BY 1""").replace("sum(CAST(b.value > a.value AS BIGINT))", "CAST(sum(CAST(b.value > a.value AS BIGINT)) AS BIGINT)"))
def _(spark, d):
    return trend.pair_counts(months(spark, d), KEY, "t", "value")


@query("x4_mann_kendall", with_("daily months mk", "SELECT * FROM mk"), "6: z; 5: p_value")
def _(spark, d):
    return trend.mann_kendall(months(spark, d), KEY, "t", "value")


@query("x5_sen_slope", with_("daily months sen", "SELECT * FROM sen"), "5: sen_slope")
def _(spark, d):
    return trend.sen_slope(months(spark, d), KEY, "t", "value")


@query("x6_sen_line", with_("daily months sen", """SELECT s.series_id, s.sen_slope, quantile_cont(m.value - s.sen_slope * m.t, 0.5) AS intercept
    FROM sen s JOIN months m USING (series_id) GROUP BY 1, 2"""), "5: sen_slope; 3: intercept")
def _(spark, d):
    return trend.sen_line(months(spark, d), KEY, "t", "value", hot_rows=None)


_LMOM = """lm AS (SELECT series_id, n, b0, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM (
  SELECT series_id, max(n) AS n, avg(value) AS b0, avg((i - 1) / (n - 1) * value) AS b1, avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * value) AS b2 FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY value, {order}) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM {src}) GROUP BY 1)),
gk AS (SELECT *, 7.8590 * c0 + 2.9554 * c0 * c0 AS c FROM (SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS c0 FROM lm)),
gs AS (SELECT *, l2 * c / ((1 - pow(2, -c)) * gamma(1 + c)) AS scale FROM gk),
gev AS (SELECT series_id, c, b0 - scale * (1 - gamma(1 + c)) / c AS loc, scale, CAST(n AS BIGINT) AS n, -c AS xi FROM gs)"""
CTE["gev"] = _LMOM.format(src="months", order="t")


def gev(spark, d):
    return extremes.gev_fit(months(spark, d), KEY, "value", order=["t"])


@query("x7_gev_lmoments", with_("daily months gev", "SELECT * FROM gev"), "6: c xi; 2: loc scale")
def _(spark, d):
    return gev(spark, d).select("series_id", "c", "loc", "scale", "n", "xi")


@query("x7_gev_likelihood", with_("daily months gev", """SELECT series_id, sum(CASE WHEN t > 0 THEN ln(scale) + (1 - 1 / c) * ln(greatest(t, 1e-300)) + pow(greatest(t, 0), 1 / c) ELSE 'Infinity'::DOUBLE END) AS nll FROM (
    SELECT g.series_id, g.c, g.scale, 1 - g.c * (m.value - g.loc) / g.scale AS t FROM months m JOIN gev g USING (series_id)) GROUP BY 1"""), "4: nll")
def _(spark, d):
    m = months(spark, d)
    return extremes.gev_nll(m, extremes.gev_fit(m, KEY, "value", order=["t"]), KEY, "value")


@query("x7_gev_maximum_likelihood")
def _(spark, d):
    return extremes.gev_mle(months(spark, d), KEY, "value")


_LEVEL = "loc + scale / c * (1 - pow(-ln(1 - 1 / period), c))"


@query("x8_gev_return_level", with_("daily months gev", f"SELECT series_id, period, {_LEVEL} AS level FROM gev, (SELECT unnest([20.0::DOUBLE, 50.0, 100.0]) AS period)"),
       "2: level")
def _(spark, d):
    return extremes.return_levels(gev(spark, d), KEY, [20, 50, 100])


@query("x9_return_level_curve", with_("daily months gev", f"""SELECT series_id, CAST(i AS INTEGER) AS i, period, {_LEVEL} AS level FROM gev,
    (SELECT i, exp(ln(2.0) + i * (ln(200.0) - ln(2.0)) / 59) AS period FROM (SELECT unnest(range(60)) AS i))"""), "6: period; 2: level")
def _(spark, d):
    return extremes.return_curve(gev(spark, d), KEY)


_BOOT_N = 500


@query("x10_bootstrap_return_levels", with_("daily amax", f"""SELECT p.series_id, p.period, p.level, b.lo, b.hi, b.n_ok FROM (
  SELECT series_id, period, {_LEVEL} AS level FROM (SELECT * FROM gev_point), (SELECT unnest([20.0::DOUBLE, 100.0]) AS period)) p JOIN (
  SELECT series_id, period, quantile_cont(lv, 0.025) AS lo, quantile_cont(lv, 0.975) AS hi, count(*) AS n_ok FROM (
    SELECT *, {_LEVEL} AS lv FROM gev_boot, (SELECT unnest([20.0::DOUBLE, 100.0]) AS period)) WHERE isfinite(lv) GROUP BY 1, 2) b USING (series_id, period)""").replace(
    "\nSELECT p.series_id", f""",
v AS (SELECT series_id, list(value ORDER BY value) AS v, count(*) AS n FROM amax GROUP BY 1),
draws AS (SELECT series_id, rep, n, list_sort(list_transform(range(n), lambda i: v[1 + (('0x' || substr(md5(series_id || '|' || rep || '|' || i || '|7'), 1, 15))::BIGINT % n)])) AS s
  FROM v, (SELECT unnest(range({_BOOT_N})) AS rep)),
long AS (SELECT series_id, rep, n, i, s[i] AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM draws)),
mom AS (SELECT series_id, -1 AS rep, avg(value) AS b0, avg((i - 1) / (n - 1) * value) AS b1, avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * value) AS b2 FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY value) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM amax) GROUP BY 1
  UNION ALL SELECT series_id, rep, avg(x), avg((i - 1) / (n - 1) * x), avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * x) FROM (
    SELECT series_id, rep, CAST(n AS DOUBLE) AS n, CAST(i AS DOUBLE) AS i, x FROM long) GROUP BY 1, 2),
gfit AS (SELECT *, l2 * c / ((1 - pow(2, -c)) * gamma(1 + c)) AS scale FROM (SELECT *, 7.8590 * c0 + 2.9554 * c0 * c0 AS c FROM (
  SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS c0 FROM (SELECT series_id, rep, b0, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM mom
    WHERE 2 * b1 - b0 > 1e-12)))),
gall AS (SELECT series_id, rep, c, scale, b0 - scale * (1 - gamma(1 + c)) / c AS loc FROM gfit),
gev_point AS (SELECT * FROM gall WHERE rep = -1),
gev_boot AS (SELECT * FROM gall WHERE rep >= 0)
SELECT p.series_id"""), "1: level lo hi")
def _(spark, d):
    return extremes.bootstrap_ci(amax(spark, d), KEY, "value", [20, 100], n_boot=_BOOT_N, seed=7)


CTE["acf1"] = """acf1 AS (SELECT series_id, corr(value, p) AS r1 FROM (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS p
    FROM months) WHERE p IS NOT NULL GROUP BY 1)"""


@query("x11_validation_gate", with_("daily months mk gev acf1", """SELECT series_id, n < 20 AS few_blocks, p_value < 0.05 AS trend_in_maxima, abs(r1) > 0.3 AS autocorrelated,
    abs(xi) > 0.5 AS extreme_shape, NOT (n < 20 OR p_value < 0.05 OR abs(r1) > 0.3 OR abs(xi) > 0.5) AS passed, 0.05 / 3 AS bonferroni_alpha
    FROM (SELECT series_id, n, p_value FROM mk) JOIN acf1 USING (series_id) JOIN (SELECT series_id, xi FROM gev) USING (series_id)"""), "9: bonferroni_alpha")
def _(spark, d):
    m = months(spark, d)
    mk = trend.mann_kendall(m, KEY, "t", "value").select("series_id", "n", "p_value")
    checks = (mk.join(trend.lag1_autocorr(m, KEY, "t", "value"), KEY)
              .join(extremes.gev_fit(m, KEY, "value", order=["t"]).select("series_id", "xi"), KEY))
    v = extremes.validate(checks, n_tests=3)
    names = ["few_blocks", "trend_in_maxima", "autocorrelated", "extreme_shape"]
    return v.select("series_id", *[F.array_contains("warnings", n).alias(n) for n in names], "passed", "bonferroni_alpha")


_IDX = " UNION ALL ".join(f"SELECT '{n}' AS index_name, series_id, year, value FROM {t}" for n, t in (("rx1day", "amax"), ("rx5day", "rx5"), ("r95p", "r95")))


@query("x12_trend_table", with_("daily amax rx5 r95", f"""SELECT index_name, series_id, s, n, z, {sql_two_sided_p('z')} AS p_value, sen_slope, 0.05 / 3 AS bonferroni_alpha,
    {sql_two_sided_p('z')} < 0.05 / 3 AS significant FROM (
    SELECT index_name, series_id, CAST(s AS BIGINT) AS s, CAST(n AS BIGINT) AS n, sen_slope,
      CASE WHEN var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS z FROM (
      SELECT p.index_name, p.series_id, p.s, p.sen_slope, t.n, (t.n * (t.n - 1) * (2 * t.n + 5) - t.tie) / 18.0::DOUBLE AS var FROM (
        SELECT a.index_name, a.series_id, sum(sign(b.value - a.value)) AS s, quantile_cont((b.value - a.value) / (b.year - a.year), 0.5) AS sen_slope
        FROM idx a JOIN idx b ON b.series_id = a.series_id AND b.index_name = a.index_name AND b.year > a.year GROUP BY 1, 2) p JOIN (
        SELECT index_name, series_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT index_name, series_id, value, count(*) AS c FROM idx GROUP BY 1, 2, 3) GROUP BY 1, 2) t
        USING (index_name, series_id)))""").replace("\nSELECT index_name, series_id, s,", f",\nidx AS ({_IDX})\nSELECT index_name, series_id, s,"),
       "6: z; 5: p_value; 4: sen_slope; 9: bonferroni_alpha")
def _(spark, d):
    t = trend.table({"rx1day": amax(spark, d), "rx5day": rx5(spark, d), "r95p": r95(spark, d)}, KEY, "year", "value")
    return t.select("index_name", "series_id", "s", "n", "z", "p_value", "sen_slope", "bonferroni_alpha", "significant")


@query("w23_plotting_positions", with_("daily amax", """SELECT series_id, year, value, rank, (rank - 0.44) / (n + 0.12) AS position,
    1 / (1 - (rank - 0.44) / (n + 0.12)) AS return_period FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, year) AS rank,
    count(*) OVER (PARTITION BY series_id) AS n FROM amax)"""), "2: value; 6: position return_period")
def _(spark, d):
    return extremes.plotting_positions(amax(spark, d), KEY, "value", ["year"])


@query("c2_extremes_pipeline", with_("daily months mk gev sen", f"""SELECT series_id, z, p_value, sen_slope, c, loc, scale, period, {_LEVEL} AS level
    FROM mk JOIN sen USING (series_id) JOIN (SELECT series_id, c, loc, scale FROM gev) USING (series_id), (SELECT unnest([20.0::DOUBLE, 50.0, 100.0]) AS period)"""),
       "6: z c; 5: p_value sen_slope; 2: loc scale level")
def _(spark, d):
    m = months(spark, d)
    fit = extremes.gev_fit(m, KEY, "value", order=["t"]).select("series_id", "c", "loc", "scale")
    t = trend.mann_kendall(m, KEY, "t", "value").join(trend.sen_slope(m, KEY, "t", "value"), KEY)
    return (t.join(fit, KEY).join(extremes.return_levels(fit, KEY, [20, 50, 100]), KEY)
            .select("series_id", "z", "p_value", "sen_slope", "c", "loc", "scale", "period", "level"))


# ================================================================== intervals


def _calibrated(spark, d):
    """Seasonal predictions with val rows for calibration and test rows for scoring."""
    return forecast.persistence(roled(spark, d), KEY, "date", "pos", "value", 7, role=None), roled(spark, d).select("series_id", "pos", "role")


CTE["cp"] = """cp AS (SELECT series_id, pos, role, value AS y_true, p AS y_pred, 1000.0 + abs(p) AS sigma FROM (
    SELECT *, lag(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM roled) WHERE p IS NOT NULL)"""


def cp(spark, d):
    from ..operators.series import lag_columns
    x = lag_columns(roled(spark, d), KEY, "pos", {"p": ("value", 7)}).filter("p is not null")
    return x.select("series_id", "pos", "role", F.col("value").alias("y_true"), F.col("p").alias("y_pred"), (1000.0 + F.abs("p")).alias("sigma"))


def _cq(score, levels="[0.8::DOUBLE, 0.9, 0.95]"):
    return f"""q AS (SELECT series_id, level, coalesce(max(sc) FILTER (WHERE rk = ceil((n + 1) * level)), 'Infinity'::DOUBLE) AS q FROM (
    SELECT series_id, {score} AS sc, row_number() OVER (PARTITION BY series_id ORDER BY {score}) AS rk, count(*) OVER (PARTITION BY series_id) AS n
    FROM cp WHERE role = 'val'), (SELECT unnest({levels}) AS level) GROUP BY 1, 2)"""


def _with_q(score, body, levels="[0.8::DOUBLE, 0.9, 0.95]"):
    return with_("daily roled cp", "").rstrip() + ",\n" + _cq(score, levels) + "\n" + body


@query("i1_conformal_quantile", _with_q("abs(y_true - y_pred)", "SELECT series_id, q, n FROM q JOIN (SELECT series_id, count(*) AS n FROM cp WHERE role = 'val' GROUP BY 1) USING (series_id)",
                                        "[0.9::DOUBLE]"), "2: q")
def _(spark, d):
    s = cp(spark, d).filter("role = 'val'").withColumn("score", F.abs(F.col("y_true") - F.col("y_pred")))
    return intervals.conformal_quantile(s, KEY, "score", 0.9)


_LV = (0.8, 0.9, 0.95)


@query("i2_split_conformal", _with_q("abs(y_true - y_pred)", "SELECT series_id, pos, level, y_pred - q AS lower, y_pred + q AS upper FROM cp JOIN q USING (series_id) WHERE role = 'test'"),
       "2: lower upper")
def _(spark, d):
    x = cp(spark, d)
    b = intervals.split_conformal(x.filter("role = 'val'"), x.filter("role = 'test'"), KEY, _LV)
    return b.select("series_id", "pos", "level", "lower", "upper")


@query("i3_normalized_conformal", _with_q("abs(y_true - y_pred) / sigma", "SELECT series_id, pos, level, y_pred - q * sigma AS lower, y_pred + q * sigma AS upper FROM cp JOIN q USING (series_id) WHERE role = 'test'"),
       "3: lower upper")
def _(spark, d):
    x = cp(spark, d)
    b = intervals.normalized_conformal(x.filter("role = 'val'"), x.filter("role = 'test'"), KEY, _LV, "sigma")
    return b.select("series_id", "pos", "level", "lower", "upper")


CTE["scale"] = """scale AS (SELECT series_id, stddev_samp(y_true - y_pred) AS sigma_hat, avg(abs(y_true - y_pred)) AS mean_abs FROM cp WHERE role = 'train' GROUP BY 1)"""


@query("g28_residual_scale", with_("daily roled cp scale", "SELECT * FROM scale"), "4: sigma_hat mean_abs")
def _(spark, d):
    return intervals.residual_scale(cp(spark, d).filter("role = 'train'"), KEY)


CTE["zs"] = "zs AS (SELECT unnest([0.8::DOUBLE, 0.9, 0.95]) AS level, unnest([1.2815515655446008::DOUBLE, 1.6448536269514722, 1.959963984540054]) AS z)"


@query("i4_normal_theory_band", with_("daily roled cp scale zs", "SELECT series_id, pos, level, y_pred - z * sigma_hat AS lower, y_pred + z * sigma_hat AS upper FROM cp JOIN scale USING (series_id), zs WHERE role = 'test'"),
       "3: lower upper")
def _(spark, d):
    x = cp(spark, d)
    b = intervals.normal_theory(x.filter("role = 'test'"), intervals.residual_scale(x.filter("role = 'train'"), KEY), KEY, _LV)
    return b.select("series_id", "pos", "level", "lower", "upper")


def _horner(var, cs):
    out = repr(cs[0]) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {var} + ({c!r}::DOUBLE))"
    return out


def _ppf_sql(p):
    from ..functions.stats import ACKLAM_A as A, ACKLAM_B as B, ACKLAM_C as C, ACKLAM_D as D
    tail = lambda u: f"({_horner(f'sqrt(-2 * ln({u}))', C)} / {_horner(f'sqrt(-2 * ln({u}))', [*D, 1.0])})"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"({_horner(r, A)} * ({p} - 0.5) / {_horner(r, [*B, 1.0])})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} <= 0.97575 THEN {mid} ELSE -{tail(f'(1 - {p})')} END"


@query("i5_normal_quantile", f"SELECT p_partkey, {_ppf_sql('p')} AS z FROM (SELECT p_partkey, (p_partkey % 997 + 1) / 998.0::DOUBLE AS p FROM part)", "6: z")
def _(spark, d):
    from ..functions.stats import norm_ppf
    return read(spark, d, "part").select("p_partkey", norm_ppf((F.col("p_partkey") % 997 + 1) / 998.0).alias("z"))


@query("i6_ridge_forecaster")
def _(spark, d):
    f = splits_frame(spark, d)
    c = models.ridge(f.filter("role = 'train'"), KEY, [f"value_lag{i}" for i in range(1, 8)], "value", 1.0, penalise_intercept=False)
    return c.select("series_id", "n", F.transform("beta", lambda v: F.round(v, 6)).alias("beta"))


def splits_frame(spark, d):
    from ..operators import features
    return features.lags(roled(spark, d), KEY, "pos", "value", 7, reset_by="role").dropna()


_COV = """SELECT series_id, level, avg(CAST(y_true >= lower AND y_true <= upper AS DOUBLE)) AS coverage, avg(upper - lower) AS width, count(*) AS n,
    abs(avg(CAST(y_true >= lower AND y_true <= upper AS DOUBLE)) - level) AS gap"""


@query("g16_interval_coverage", _with_q("abs(y_true - y_pred)", f"""{_COV} FROM (SELECT series_id, level, y_true, y_pred - q AS lower, y_pred + q AS upper FROM cp JOIN q USING (series_id)
    WHERE role = 'test') GROUP BY 1, 2"""), "6: coverage gap; 3: width")
def _(spark, d):
    x = cp(spark, d)
    return intervals.coverage(intervals.split_conformal(x.filter("role = 'val'"), x.filter("role = 'test'"), KEY, _LV), KEY)


@query("c11_interval_comparison", _with_q("abs(y_true - y_pred)", f"""SELECT method, avg(gap) AS mean_gap FROM (
    SELECT 'split' AS method, * FROM ({_COV} FROM (SELECT series_id, level, y_true, y_pred - q AS lower, y_pred + q AS upper FROM cp JOIN q USING (series_id) WHERE role = 'test') GROUP BY 1, 2)
    UNION ALL SELECT 'normal', * FROM ({_COV} FROM (SELECT series_id, level, y_true, y_pred - z * sigma_hat AS lower, y_pred + z * sigma_hat AS upper
      FROM cp JOIN (SELECT series_id, stddev_samp(y_true - y_pred) AS sigma_hat FROM cp WHERE role = 'train' GROUP BY 1) USING (series_id),
      (SELECT unnest([0.8::DOUBLE, 0.9, 0.95]) AS level, unnest([1.2815515655446008::DOUBLE, 1.6448536269514722, 1.959963984540054]) AS z) WHERE role = 'test') GROUP BY 1, 2)) GROUP BY 1"""),
       "6: mean_gap")
def _(spark, d):
    x = cp(spark, d)
    test = x.filter("role = 'test'")
    a = intervals.coverage(intervals.split_conformal(x.filter("role = 'val'"), test, KEY, _LV), KEY).withColumn("method", F.lit("split"))
    b = intervals.coverage(intervals.normal_theory(test, intervals.residual_scale(x.filter("role = 'train'"), KEY), KEY, _LV), KEY)
    return intervals.mean_gap(a.unionByName(b.withColumn("method", F.lit("normal"))), ["method"])


# ------------------------------------------------------------------ ridge forecaster with a fitted residual scale

_LAGS = [f"value_lag{i}" for i in range(1, 8)]


def _ridge_sql(out: str, src: str, key: str, xs, y: str, lam: float) -> str:
    """CTEs that end in ``out`` (key, b0, b1, ...): a ridge fit with free intercept by elimination on the centred moments."""
    k = len(xs)
    cells = [f"covar_pop({xs[i]}, {xs[j]}) * count(*)" + (f" + {lam}" if i == j else "") + f" AS a{i}_{j}" for i in range(k) for j in range(k)]
    rhs = [f"covar_pop({x}, {y}) * count(*) AS a{i}_{k}" for i, x in enumerate(xs)]
    means = [f"avg({x}) AS m{i}" for i, x in enumerate(xs)] + [f"avg({y}) AS my"]
    steps = [f"{out}_0 AS (SELECT {key}, {', '.join(cells + rhs + means)} FROM {src} GROUP BY 1)"]
    for p in range(k):
        new = [f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(k) if i != p for j in range(p + 1, k + 1)]
        steps.append(f"{out}_{p + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {out}_{p})")
    beta = [f"a{i}_{k} / a{i}_{i}" for i in range(k)]
    centre = " - ".join(["my", *[f"{b} * m{i}" for i, b in enumerate(beta)]])
    steps.append(f"{out} AS (SELECT {key}, {centre} AS b0, {', '.join(f'{b} AS b{i + 1}' for i, b in enumerate(beta))} FROM {out}_{k})")
    return ",\n".join(steps)


_DOT = " + ".join(["b0", *[f"b{i + 1} * {x}" for i, x in enumerate(_LAGS)]])
CTE["ridge"] = ("lagf AS (SELECT * FROM (SELECT series_id, pos, role, value AS y_true, " + ", ".join(f"lag(value, {i}) OVER w AS value_lag{i}" for i in range(1, 8))
                + " FROM roled WINDOW w AS (PARTITION BY series_id, role ORDER BY pos)) WHERE value_lag7 IS NOT NULL),\n"
                + "ltrain AS (SELECT * FROM lagf WHERE role = 'train'),\n" + _ridge_sql("rfit", "ltrain", "series_id", _LAGS, "y_true", 1.0)
                + f",\nlres AS (SELECT l.*, abs(y_true - ({_DOT})) AS ar FROM ltrain l JOIN rfit USING (series_id)),\n"
                + _ridge_sql("sfit", "lres", "series_id", _LAGS, "ar", 1.0)
                + f""",
rfloor AS (SELECT series_id, 0.1 * (avg(ar) + 1e-12) AS fl, stddev_samp(y_pred_r) AS sigma_hat FROM (SELECT r.series_id, ar, y_true - ({_DOT}) AS y_pred_r FROM lres r JOIN rfit USING (series_id)) GROUP BY 1),
rp0 AS (SELECT l.*, {_DOT} AS y_pred FROM lagf l JOIN rfit USING (series_id)),
rp AS (SELECT r.series_id, pos, role, y_true, y_pred, greatest({_DOT}, fl) AS sigma FROM rp0 r JOIN sfit USING (series_id) JOIN rfloor USING (series_id))""")


def ridge_predictions(spark, d):
    f = splits_frame(spark, d)
    return intervals.ridge_with_scale(f.filter("role = 'train'"), f, KEY, _LAGS, "value").withColumnRenamed("value", "y_true")


@query("i6_ridge_coefficients", with_("daily roled ridge", "SELECT series_id, " + ", ".join(f"b{i}" for i in range(8)) + " FROM rfit"), "2: b0; 5: " + " ".join(f"b{i}" for i in range(1, 8)))
def _(spark, d):
    c = models.ridge(splits_frame(spark, d).filter("role = 'train'"), KEY, _LAGS, "value", 1.0, penalise_intercept=False)
    return c.select("series_id", *[F.element_at("beta", i + 1).alias(f"b{i}") for i in range(8)])


@query("i6_residual_scale", with_("daily roled ridge", "SELECT series_id, pos, y_pred, sigma FROM rp"), "1: y_pred sigma")
def _(spark, d):
    return ridge_predictions(spark, d).select("series_id", "pos", "y_pred", "sigma")


def _bands_sql(score: str, half: str) -> str:
    """Coverage of conformal bands: the rank of the level among the calibration scores, +infinity beyond them."""
    return f"""{_COV} FROM (SELECT t.series_id, level, y_true, y_pred - q * {half} AS lower, y_pred + q * {half} AS upper FROM rp t JOIN (
      SELECT series_id, level, coalesce(s[CAST(ceil((len(s) + 1) * level) AS BIGINT)], 'Infinity'::DOUBLE) AS q FROM (
        SELECT series_id, list({score} ORDER BY {score}) AS s FROM rp WHERE role = 'val' GROUP BY 1), (SELECT unnest([0.8::DOUBLE, 0.9, 0.95]) AS level)) USING (series_id)
      WHERE role = 'test') GROUP BY 1, 2"""


@query("c11_ridge_intervals", with_("daily roled ridge", f"""SELECT method, series_id, level, coverage, width, gap FROM (
    SELECT 'split' AS method, * FROM ({_bands_sql("abs(y_true - y_pred)", "1")}) UNION ALL
    SELECT 'normalized', * FROM ({_bands_sql("abs(y_true - y_pred) / sigma", "sigma")}) UNION ALL
    SELECT 'normal', * FROM ({_COV} FROM (SELECT series_id, level, y_true, y_pred - z * sigma_hat AS lower, y_pred + z * sigma_hat AS upper FROM rp JOIN rfloor USING (series_id),
      (SELECT unnest([0.8::DOUBLE, 0.9, 0.95]) AS level, unnest([1.2815515655446008::DOUBLE, 1.6448536269514722, 1.959963984540054]) AS z) WHERE role = 'test') GROUP BY 1, 2))"""),
       "6: coverage gap; 1: width")
def _(spark, d):
    """One ridge forecaster, three bands: constant width, width by the fitted residual scale, normal theory."""
    x = store(ridge_predictions(spark, d).select("series_id", "pos", "role", "y_true", "y_pred", "sigma"), "ridge")   # read by all three
    val, test = x.filter("role = 'val'"), x.filter("role = 'test'")
    bands = {"split": intervals.split_conformal(val, test, KEY, _LV), "normalized": intervals.normalized_conformal(val, test, KEY, _LV, "sigma"),
             "normal": intervals.normal_theory(test, intervals.residual_scale(x.filter("role = 'train'"), KEY), KEY, _LV)}
    parts = [intervals.coverage(b, KEY).select(F.lit(m).alias("method"), "series_id", "level", "coverage", "width", "gap") for m, b in bands.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ================================================================== hierarchy

CTE["suff"] = "suff AS (SELECT network, station, count(value) AS n, avg(value) AS ybar, coalesce(var_samp(value), 0) AS svar FROM obs GROUP BY 1, 2)"
CTE["hyper"] = """hyper AS (SELECT network, avg(ybar) AS mu, greatest(0.1, coalesce(stddev_samp(ybar), 0.1)) AS tau,
    greatest(0.1, sqrt(coalesce(avg(svar) FILTER (WHERE n > 1), 0))) AS sigma FROM suff GROUP BY 1)"""
CTE["post"] = """post AS (SELECT *, pm - 1.959963984540054 * psd AS lo95, pm + 1.959963984540054 * psd AS hi95 FROM (
    SELECT network, station, n, ybar, (mu / (tau * tau) + n * ybar / (sigma * sigma)) / (1 / (tau * tau) + n / (sigma * sigma)) AS pm,
      sqrt(1 / (1 / (tau * tau) + n / (sigma * sigma))) AS psd FROM {join}))"""
CTE["post_eb"] = CTE["post"].format(join="suff JOIN hyper USING (network)")
CTE["post_known"] = CTE["post"].format(join="suff, (SELECT 60.0 AS mu, 8.0 AS tau, 50.0 AS sigma)")
_ST = ["network", "station"]


@query("g20_sufficient_statistics", with_("obs suff", "SELECT * FROM suff"), "6: ybar svar")
def _(spark, d):
    return hier.sufficient_stats(observations(spark, d), _ST, "value")


@query("g29_moment_hyperparameters", with_("obs suff hyper", "SELECT * FROM hyper"), "6: mu tau sigma")
def _(spark, d):
    return hier.moment_hyper(hier.sufficient_stats(observations(spark, d), _ST, "value"), ["network"])


@query("i7_conjugate_posterior", with_("obs suff post_known", "SELECT network, station, pm AS post_mean, psd AS post_sd, lo95, hi95 FROM post"), "6: post_mean post_sd lo95 hi95")
def _(spark, d):
    s = hier.sufficient_stats(observations(spark, d), _ST, "value")
    p = hier.shrink(s.withColumn("mu", F.lit(60.0)).withColumn("tau", F.lit(8.0)).withColumn("sigma", F.lit(50.0)))
    return p.select(*_ST, "post_mean", "post_sd", "lo95", "hi95")


@query("i8_empirical_bayes", with_("obs suff hyper post_eb", "SELECT network, station, pm AS post_mean, psd AS post_sd, lo95, hi95 FROM post"), "6: post_mean post_sd lo95 hi95")
def _(spark, d):
    return hier.empirical_bayes(observations(spark, d), ["network"], "station", "value").select(*_ST, "post_mean", "post_sd", "lo95", "hi95")


@query("i9_draw_summary", """SELECT event_type AS station, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo95,
    quantile_cont(value, 0.975) AS hi95 FROM events GROUP BY 1""", "6: mean sd lo95 hi95")
def _(spark, d):
    return hier.summarize_draws(read(spark, d, "events").withColumnRenamed("event_type", "station"), ["station"], "value")


_TRUTH = "truth AS (SELECT event_type AS network, user_id AS station, avg(value) AS theta FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)"


@query("g17_posterior_evaluation", with_("obs suff hyper post_eb", f"""SELECT network, avg(CAST(theta >= lo95 AND theta <= hi95 AS DOUBLE)) AS coverage,
    sqrt(avg(pow(pm - theta, 2))) AS rmse, avg(hi95 - lo95) AS width, count(*) AS n FROM post JOIN (SELECT event_type AS network, user_id AS station,
      avg(value) AS theta FROM events WHERE hour(ts) < 12 GROUP BY 1, 2) USING (network, station) GROUP BY 1"""), "6: coverage rmse width")
def _(spark, d):
    truth = read(spark, d, "events").filter(F.hour("ts") < 12).groupBy(
        F.col("event_type").alias("network"), F.col("user_id").alias("station")).agg(F.avg("value").alias("theta"))
    return hier.evaluate(hier.empirical_bayes(observations(spark, d), ["network"], "station", "value"), truth, _ST, ["network"])


@query("g26_context_features", with_("obs suff", """SELECT s.network, s.station, s.n, s.ybar, s.ybar - c.g AS dev, ln(1 + s.n) AS log1p_n, c.g AS global_mean,
    ln(c.sb + 1e-6) AS log_between, ln(c.sw + 1e-6) AS log_within, ln(1 + c.s) AS log1p_stations FROM suff s JOIN (
    SELECT network, avg(ybar) AS g, coalesce(stddev_samp(ybar), 0) AS sb, count(*) AS s,
      coalesce(sqrt(sum(svar * (n - 1)) FILTER (WHERE n > 1) / greatest(1.0, sum(n - 1) FILTER (WHERE n > 1))), 0) AS sw FROM suff GROUP BY 1) c USING (network)"""),
       "6: ybar dev log1p_n global_mean log_between log_within log1p_stations")
def _(spark, d):
    c = hier.context_features(hier.sufficient_stats(observations(spark, d), _ST, "value"), ["network"])
    return c.select(*_ST, "n", "ybar", "dev", "log1p_n", "global_mean", "log_between", "log_within", "log1p_stations")


@query("c12_posterior_comparison", with_("obs suff hyper post_eb", """SELECT method, sqrt(avg(pow(est - theta, 2))) AS rmse FROM (
    SELECT unnest(['raw', 'shrunk']) AS method, unnest([ybar, pm]) AS est, theta FROM post JOIN (SELECT event_type AS network, user_id AS station,
      avg(value) AS theta FROM events WHERE hour(ts) < 12 GROUP BY 1, 2) USING (network, station)) GROUP BY 1"""), "6: rmse")
def _(spark, d):
    truth = read(spark, d, "events").filter(F.hour("ts") < 12).groupBy(
        F.col("event_type").alias("network"), F.col("user_id").alias("station")).agg(F.avg("value").alias("y_true"))
    p = hier.empirical_bayes(observations(spark, d), ["network"], "station", "value").join(truth, _ST)
    m = F.explode(F.array(F.struct(F.lit("raw").alias("method"), F.col("ybar").alias("y_pred")),
                          F.struct(F.lit("shrunk").alias("method"), F.col("post_mean").alias("y_pred"))))
    return metrics.table(p.select("y_true", m.alias("m")).select("y_true", "m.*"), ["method"], ["rmse"])


# ================================================================== catchments

CTE["apis"] = """apis AS (SELECT gauge_id, pos, lag(s) OVER (PARTITION BY gauge_id ORDER BY pos) AS api FROM (
    SELECT gauge_id, pos, list_reduce(list(precip) OVER (PARTITION BY gauge_id ORDER BY pos ROWS BETWEEN 400 PRECEDING AND CURRENT ROW), lambda a, x: 0.92 * a + x) AS s FROM catchment))"""


@query("w13_antecedent_wetness", with_("catchment apis", "SELECT * FROM apis"), "5: api")
def _(spark, d):
    return hydro.api(catchment(spark, d), GAUGE, "pos", "precip").select("gauge_id", "pos", "api")


@query("w14_linear_reservoir", "WITH RECURSIVE " + CTE["catchment"] + ",\n" + CTE["croled"] + """,
    s0 AS (SELECT gauge_id, avg(streamflow) AS s0 FROM croled WHERE role = 'train' GROUP BY 1),
    base AS MATERIALIZED (SELECT gauge_id, pos, role, precip, streamflow FROM croled),
    ks AS (SELECT 0.02 + i * (0.6 - 0.02) / 11 AS k FROM (SELECT unnest(range(12)) AS i)),
    run(gauge_id, pos, k, s) AS (SELECT gauge_id, CAST(-1 AS BIGINT), k, s0 FROM s0, ks
      UNION ALL SELECT r.gauge_id, r.pos + 1, r.k, (1 - r.k) * r.s + b.precip FROM run r JOIN base b ON b.gauge_id = r.gauge_id AND b.pos = r.pos + 1),
    sim AS (SELECT r.gauge_id, r.pos, r.k, b.role, b.streamflow, r.k * r.s AS q FROM run r JOIN base b ON b.gauge_id = r.gauge_id AND b.pos = r.pos),
    err AS (SELECT gauge_id, k, sqrt(avg(pow(q - streamflow, 2))) AS e FROM sim WHERE role = 'train' GROUP BY 1, 2),
    best AS (SELECT gauge_id, k FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY e, k) AS r FROM err) WHERE r = 1)
    SELECT s.gauge_id, s.pos, s.k, s.streamflow AS y_true, greatest(s.q, 0) AS y_pred FROM sim s JOIN best b ON b.gauge_id = s.gauge_id AND b.k = s.k WHERE s.role = 'test'""",
       "9: k; 5: y_true y_pred")
def _(spark, d):
    return hydro.linear_reservoir(catchment_roled(spark, d), GAUGE, "pos", "precip", "streamflow").select("gauge_id", "pos", "k", "y_true", "y_pred")


_KERNEL = hydro.triangular_kernel(5, 2)
_ROUTE = " + ".join(f"{w!r}::DOUBLE * coalesce(lag(precip, {j}) OVER w, 0.0)" for j, w in enumerate(_KERNEL))


@query("w15_unit_hydrograph", with_("catchment", f"SELECT gauge_id, pos, {_ROUTE} AS routed FROM catchment WINDOW w AS (PARTITION BY gauge_id ORDER BY pos)"), "6: routed")
def _(spark, d):
    return hydro.route(catchment(spark, d), GAUGE, "pos", "precip", _KERNEL).select("gauge_id", "pos", "routed")


@query("w16_runoff_design", with_("catchment apis", """SELECT gauge_id, pos, p0 AS p_lag0, p7 AS p_lag7, api, temperature, pet FROM (
    SELECT gauge_id, pos, precip AS p0, lag(precip, 7) OVER w AS p7, temperature, pet FROM catchment WINDOW w AS (PARTITION BY gauge_id ORDER BY pos))
    JOIN apis USING (gauge_id, pos) WHERE p7 IS NOT NULL"""), "5: api; 6: pet")
def _(spark, d):
    f, _ = hydro.design(catchment(spark, d), GAUGE, "pos", "precip")
    return f.select("gauge_id", "pos", "p_lag0", "p_lag7", "api", "temperature", "pet")


@query("g24_normal_equations", with_("catchment", """SELECT gauge_id, count(*) AS n, sum(precip) AS sx1, sum(temperature) AS sx2, sum(precip * precip) AS s11,
    sum(precip * temperature) AS s12, sum(temperature * temperature) AS s22, sum(precip * streamflow) AS s1y, sum(temperature * streamflow) AS s2y, sum(streamflow) AS sy
    FROM catchment GROUP BY 1"""), "2: sx1 sx2 s11 s12 s22 s1y s2y sy")
def _(spark, d):
    g = models.gram(catchment(spark, d), GAUGE, ["precip", "temperature"], "streamflow")
    at = lambda c, i: F.element_at(c, i)
    return g.select("gauge_id", "n", at("sx", 1).alias("sx1"), at("sx", 2).alias("sx2"), at("sxx", 1).alias("s11"), at("sxx", 2).alias("s12"),
                    at("sxx", 3).alias("s22"), at("sxy", 1).alias("s1y"), at("sxy", 2).alias("s2y"), "sy")


@query("c9_runoff_baselines")
def _(spark, d):
    c = catchment_roled(spark, d)
    lin = hydro.linear_runoff(c, GAUGE, "pos", "precip", "streamflow").select("gauge_id", "pos", F.lit("linear").alias("method"), "y_true", "y_pred")
    res = hydro.linear_reservoir(c, GAUGE, "pos", "precip", "streamflow").select("gauge_id", "pos", F.lit("reservoir").alias("method"), "y_true", "y_pred")
    return metrics.table(score.align(lin.unionByName(res), GAUGE, "pos", 2), ["gauge_id", "method"], ["rmse", "nse", "kge"])


# ================================================================== ledger folds and optional checks


@query("g30_fold_scores", with_("daily roled", """SELECT fold_id, role, sqrt(avg(pow(value - p, 2))) AS rmse, avg(abs(value - p)) AS mae FROM (
    SELECT series_id, pos, value, lag(value, 1) OVER (PARTITION BY series_id ORDER BY pos) AS p, n_steps FROM daily) x JOIN (
      SELECT fold_id, s.pos, role FROM (SELECT DISTINCT pos, n_steps FROM daily) s, LATERAL (SELECT f.fold_id,
        CASE WHEN s.pos < f.tv - f.nv THEN 'train' WHEN s.pos < f.tv THEN 'val' WHEN s.pos < f.t0 THEN 'purged' WHEN s.pos < f.t1 THEN 'test' END AS role FROM (
          SELECT *, greatest(1, CAST(round_even(tv * 0.15::DOUBLE, 0) AS BIGINT)) AS nv FROM (SELECT *, t0 - 1 AS tv FROM (
            SELECT fold_id, CAST(round_even(s.n_steps / 7.0::DOUBLE * (fold_id + 3), 0) AS BIGINT) AS t0, CAST(round_even(s.n_steps / 7.0::DOUBLE * (fold_id + 4), 0) AS BIGINT) AS t1
            FROM (SELECT unnest(range(4)) AS fold_id)))) f) WHERE role IN ('val', 'test')) r USING (pos) WHERE p IS NOT NULL GROUP BY 1, 2""").replace(
            "SELECT fold_id, role, sqrt", "SELECT CAST(fold_id AS INTEGER) AS fold_id, role, sqrt"), "3: rmse mae")
def _(spark, d):
    from ..operators import ledger
    from ..operators.series import lag_columns
    x = lag_columns(daily(spark, d), KEY, "pos", {"y_pred": ("value", 1)}).withColumn("y_true", F.col("value"))
    folds = splits.walk_forward(x, KEY, "pos", 7, 3, n="n_steps").filter(F.col("role").isin("val", "test"))
    return ledger.fold_scores(folds).select("fold_id", "role", "rmse", "mae")


@query("o1_benjamini_hochberg", """WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM part),
    r AS (SELECT *, p * count(*) OVER () / max(rn) OVER (PARTITION BY p) AS raw FROM (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM p))
    SELECT p_partkey, p, min(least(raw, 1.0)) OVER (ORDER BY p DESC) AS p_adj, min(least(raw, 1.0)) OVER (ORDER BY p DESC) <= 0.05 AS reject FROM r""", "9: p_adj")
def _(spark, d):
    x = read(spark, d, "part").select("p_partkey", (((F.col("p_partkey") * 7919) % 1000 + 1) / 1000.0).alias("p"))
    return trend.benjamini_hochberg(x, [], "p")


@query("o2_group_kfold", "SELECT c_custkey, CAST(('0x' || substr(md5(CAST(c_nationkey AS VARCHAR)), 1, 15))::BIGINT % 5 AS INTEGER) AS fold_id FROM customer")
def _(spark, d):
    return splits.group_kfold(read(spark, d, "customer"), "c_nationkey", 5).select("c_custkey", "fold_id")


@query("o3_purge_embargo", with_("daily", """SELECT series_id, pos, CASE WHEN pos >= 1000 AND pos < 1200 THEN 'test' WHEN pos >= 993 AND pos < 1000 THEN 'purged'
    WHEN pos >= 1200 AND pos < 1214 THEN 'embargo' ELSE 'train' END AS role FROM daily"""))
def _(spark, d):
    return splits.purge_embargo(daily(spark, d), "pos", 1000, 1200, 7, 14).select("series_id", "pos", "role")


@query("o4_station_qc", with_("hourly", """SELECT station, count(*) FILTER (WHERE pm25 >= 10) AS n_ok, count(*) FILTER (WHERE pm25 < 10) AS n_negative,
    count(*) FILTER (WHERE pm25 IS NULL) AS n_missing FROM hourly GROUP BY 1"""))
def _(spark, d):
    return profile.station_qc(hourly(spark, d), STATION, "pm25", 10.0)


@query("o5_peaks_over_threshold", with_("daily", """SELECT series_id, cluster, max(value) AS peak, count(*) AS n_steps, min(pos) AS start_pos FROM (
    SELECT *, CAST(sum(CASE WHEN pos - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY pos) AS BIGINT) AS cluster FROM (
      SELECT *, lag(pos) OVER (PARTITION BY series_id ORDER BY pos) AS prev FROM daily WHERE value > 500000)) GROUP BY 1, 2"""), "2: peak")
def _(spark, d):
    return extremes.peaks_over_threshold(daily(spark, d), KEY, "pos", "value", F.lit(500000.0), 3)


@query("o7_residual_diagnostics", with_("daily", """SELECT series_id, count(*) AS n, sum(pow(e - l1, 2)) / sum(e * e) AS durbin_watson, sum(e * l1) / sum(e * e) AS acf1,
    sum(e * l2) / sum(e * e) AS acf2, sum(e * l3) / sum(e * e) AS acf3, count(*) * (count(*) + 2) * (pow(sum(e * l1) / sum(e * e), 2) / (count(*) - 1)
      + pow(sum(e * l2) / sum(e * e), 2) / (count(*) - 2) + pow(sum(e * l3) / sum(e * e), 2) / (count(*) - 3)) AS ljung_box FROM (
    SELECT series_id, e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3 FROM (
      SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS e FROM daily) WINDOW w AS (PARTITION BY series_id ORDER BY pos)) GROUP BY 1"""),
       "6: durbin_watson acf1 acf2 acf3 ljung_box")
def _(spark, d):
    return trend.residual_diagnostics(daily(spark, d), KEY, "pos", "value", 3)


@query("o9_gap_fill", with_("hourly", """SELECT station, pos, coalesce(pm25, last_value(pm25 IGNORE NULLS) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) AS filled FROM hourly"""))
def _(spark, d):
    return profile.gap_fill(hourly(spark, d), STATION, "pos", "pm25", max_gap=24).select("station", "pos", "filled")


_BOTH_SIDES = """SELECT station, pos, pm25, max(CASE WHEN pm25 IS NOT NULL THEN pos END) OVER back AS b, min(CASE WHEN pm25 IS NOT NULL THEN pos END) OVER ahead AS a,
    last_value(pm25 IGNORE NULLS) OVER back AS bv, first_value(pm25 IGNORE NULLS) OVER ahead AS av FROM hourly
    WINDOW back AS (PARTITION BY station ORDER BY pos ROWS UNBOUNDED PRECEDING), ahead AS (PARTITION BY station ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("o9_gap_fill_all", with_("hourly", f"SELECT station, pos, coalesce(pm25, bv) AS filled FROM ({_BOTH_SIDES})"))
def _(spark, d):
    return profile.gap_fill(hourly(spark, d), STATION, "pos", "pm25").select("station", "pos", "filled")


@query("o9_gap_fill_linear", with_("hourly", f"SELECT station, pos, coalesce(pm25, bv + (pos - b) / (a - b) * (av - bv)) AS filled FROM ({_BOTH_SIDES})"), "6: filled")
def _(spark, d):
    return profile.gap_fill(hourly(spark, d), STATION, "pos", "pm25", linear=True).select("station", "pos", "filled")


@query("o10_effort_weighted_counts", "SELECT l_suppkey AS cell, sum(l_quantity) / sum(l_linenumber) AS rate, CAST(sum(l_linenumber) AS BIGINT) AS effort FROM lineitem GROUP BY 1", "6: rate")
def _(spark, d):
    return profile.effort_weighted(read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "cell"), ["cell"], "l_quantity", "l_linenumber")

"""Error, efficiency, classification and probability metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skill as S
from ..operators import metrics, score
from .base import predictions, probability, query, read, with_

_AGG = {
    "g1_rmse": ("rmse", "sqrt(avg(pow(y_true - y_pred, 2)))"),
    "g2_mae": ("mae", "avg(abs(y_true - y_pred))"),
    "g3_bias": ("bias", "avg(y_pred - y_true)"),
    "g4_mape": ("mape", "avg(abs(y_true - y_pred) / (abs(y_true) + 1e-8)) * 100"),
    "g5_r2": ("r2", "1 - sum(pow(y_true - y_pred, 2)) / nullif(count(*) * var_pop(y_true), 0)"),
    "g14_nse": ("nse", "1 - sum(pow(y_true - y_pred, 2)) / nullif(count(*) * var_pop(y_true), 0)"),
    "g15_kge": ("kge", "1 - sqrt(pow(corr(y_true, y_pred) - 1, 2) + pow(stddev_pop(y_pred) / stddev_pop(y_true) - 1, 2) "
                       "+ pow(avg(y_pred) / avg(y_true) - 1, 2))"),
}


def _metric(name, metric, expr):
    @query(name, with_("preds", f"SELECT key, method, {expr} AS {metric} FROM preds GROUP BY 1, 2"), f"6: {metric}")
    def _(spark, d):
        return metrics.table(predictions(spark, d), ["key", "method"], [metric])


for _name, (_m, _e) in _AGG.items():
    _metric(_name, _m, _e)


@query("g6_anomaly_correlation", with_("preds", """SELECT key, method, sum((y_true - c) * (y_pred - c)) / sqrt(sum(pow(y_true - c, 2)) * sum(pow(y_pred - c, 2))) AS acc
    FROM (SELECT *, avg(y_true) OVER (PARTITION BY key, method) AS c FROM preds) GROUP BY 1, 2"""), "6: acc")
def _(spark, d):
    return metrics.table(predictions(spark, d), ["key", "method"], ["acc"])


@query("g6_anomaly_correlation_climatology", with_("preds", """SELECT key, method, sum((y_true - c) * (y_pred - c)) / sqrt(sum(pow(y_true - c, 2)) * sum(pow(y_pred - c, 2))) AS acc
    FROM (SELECT *, 30.0 + l_linenumber AS c FROM preds) GROUP BY 1, 2"""), "6: acc")
def _(spark, d):
    return metrics.anomaly_correlation(predictions(spark, d).withColumn("c", 30.0 + F.col("l_linenumber")), ["key", "method"], "c")


@query("g7_latitude_weighted_rmse", with_("preds", """SELECT p.key, p.method, sqrt(avg(pow(p.y_true - p.y_pred, 2) * cos(radians(lat)) / n.mc)) AS lat_rmse
    FROM (SELECT *, l_linenumber * 12.0 - 48 AS lat FROM preds) p JOIN (SELECT key, method, avg(cos(radians(lat))) AS mc FROM
      (SELECT DISTINCT key, method, l_linenumber * 12.0 - 48 AS lat FROM preds) GROUP BY 1, 2) n ON n.key = p.key AND n.method = p.method GROUP BY 1, 2"""),
       "6: lat_rmse")
def _(spark, d):
    return metrics.latitude_rmse(predictions(spark, d).withColumn("lat", F.col("l_linenumber") * 12.0 - 48), ["key", "method"], "lat")


_M = """m AS (SELECT key, method, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
    1 - sum(pow(y_true - y_pred, 2)) / (count(*) * var_pop(y_true)) AS nse FROM preds GROUP BY 1, 2)"""


def _m(spark, d):
    return metrics.table(predictions(spark, d), ["key", "method"], ["rmse", "mae", "nse"])


def _with_m(body):
    return with_("preds", "").rstrip() + ",\n" + _M + "\n" + body


@query("g8_skill_score", _with_m("""SELECT a.key, a.method, a.rmse, 1 - a.rmse / (b.rmse + 1e-12) AS skill,
    (a.nse - b.nse) / (abs(b.nse) + 1e-12) AS nse_skill FROM m a JOIN m b ON b.key = a.key AND b.method = 'linear'"""), "6: rmse skill nse_skill")
def _(spark, d):
    m = _m(spark, d)
    a = score.skill_against(m, ["key"], "linear")
    b = score.skill_against(m, ["key"], "linear", "nse", "nse_skill").select("key", "method", "nse_skill")
    return a.join(b, ["key", "method"]).select("key", "method", "rmse", "skill", "nse_skill")


@query("g9_skill_vs_reference", _with_m("""SELECT a.key, 1 - a.rmse / (b.rmse + 1e-12) AS skill FROM m a JOIN m b ON b.key = a.key
    AND b.method = 'linear' WHERE a.method = 'discounted'"""), "6: skill")
def _(spark, d):
    return score.skill_against(_m(spark, d), ["key"], "linear").filter("method = 'discounted'").select("key", "skill")


_CLS = "SELECT l_returnflag AS key, l_linenumber AS t, CAST(floor(l_quantity) AS INTEGER) % 8 AS p FROM lineitem"


def _classes(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linenumber").alias("t"),
                                             (F.floor("l_quantity").cast("int") % 8).alias("p"))


@query("g10_classification_report", f"""WITH c AS ({_CLS}), k AS (SELECT key, t AS cls FROM c UNION SELECT key, p FROM c),
    s AS (SELECT k.key, k.cls, count(*) FILTER (WHERE c.t = k.cls AND c.p = k.cls) AS tp, count(*) FILTER (WHERE c.p = k.cls) AS np,
      count(*) FILTER (WHERE c.t = k.cls) AS nt FROM k JOIN c ON c.key = k.key AND (c.t = k.cls OR c.p = k.cls) GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS rc FROM s)
    SELECT key, sum(tp) / sum(nt) AS accuracy, avg(pr) AS macro_precision, avg(rc) AS macro_recall,
      avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) AS macro_f1, count(*) AS n_classes FROM r GROUP BY 1""",
       "6: accuracy macro_precision macro_recall macro_f1")
def _(spark, d):
    return metrics.classification(_classes(spark, d), ["key"], "t", "p")


@query("g11_confusion_matrix", f"""SELECT key, t, p, count(*) AS n, count(*) / greatest(sum(count(*)) OVER (PARTITION BY key, t), 1) AS share
    FROM ({_CLS}) GROUP BY 1, 2, 3""", "6: share")
def _(spark, d):
    return metrics.confusion(_classes(spark, d), ["key"], "t", "p")


@query("u5_class_union", f"WITH c AS ({_CLS}) SELECT key, t AS cls FROM c UNION SELECT key, p FROM c")
def _(spark, d):
    c = _classes(spark, d)
    return c.select("key", F.explode(F.array("t", "p")).alias("cls")).distinct()


_SPIKE = """count(*) FILTER (WHERE y_true > 60 AND y_pred > 60) AS tp, count(*) FILTER (WHERE NOT y_true > 60 AND y_pred > 60) AS fp,
    count(*) FILTER (WHERE y_true > 60 AND NOT y_pred > 60) AS fn, count(*) FILTER (WHERE NOT y_true > 60 AND NOT y_pred > 60) AS tn"""


@query("g12_spike_scores", with_("preds", f"""SELECT key, method, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    tp + fn AS support, tp, fp, fn, tn FROM (SELECT key, method, {_SPIKE} FROM preds GROUP BY 1, 2)"""), "6: precision recall f1")
def _(spark, d):
    return metrics.spike(predictions(spark, d), ["key", "method"], F.lit(60.0))


@query("g13_metric_bundle", with_("preds", f"""SELECT key, method, n, rmse, mae, bias, nse, kge, tp AS spike_tp, fp AS spike_fp, fn AS spike_fn, tn AS spike_tn FROM (
    SELECT key, method, count(*) AS n, {_AGG['g1_rmse'][1]} AS rmse, {_AGG['g2_mae'][1]} AS mae, {_AGG['g3_bias'][1]} AS bias,
    {_AGG['g14_nse'][1]} AS nse, {_AGG['g15_kge'][1]} AS kge, {_SPIKE} FROM preds GROUP BY 1, 2)"""), "6: rmse mae bias nse kge")
def _(spark, d):
    b = metrics.bundle(predictions(spark, d), ["key", "method"], F.lit(60.0))
    return b.select("key", "method", "n", "rmse", "mae", "bias", "nse", "kge", "spike_tp", "spike_fp", "spike_fn", "spike_tn")


@query("g18_probability_scores", with_("prob", """SELECT r.lang, (r.rs - r.np * (r.np + 1) / 2.0) / nullif(r.np * (r.nn - r.np), 0) AS auc, b.brier, b.prevalence_gap, b.surface_corr FROM (
    SELECT lang, sum(rk) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS np, count(*) AS nn FROM (
      SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM prob) GROUP BY 1) r
    JOIN (SELECT lang, avg(pow(p - y, 2)) AS brier, abs(avg(p) - avg(y)) AS prevalence_gap, corr(p, surface) AS surface_corr FROM prob GROUP BY 1) b USING (lang)"""),
       "6: auc brier prevalence_gap surface_corr")
def _(spark, d):
    return metrics.binary_probability(probability(spark, d), ["lang"], "y", "p", "surface")


@query("g25_covariate_informativeness", """SELECT l_returnflag AS key, corr(l_quantity, l_extendedprice) AS pearson_r,
    regr_r2(l_extendedprice, l_quantity) AS r2_linear FROM lineitem GROUP BY 1""", "6: pearson_r r2_linear")
def _(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "key")
    return metrics.informativeness(li, ["key"], "l_quantity", "l_extendedprice")


@query("g31_method_deltas", _with_m("""SELECT a.key, u.metric, CASE u.metric WHEN 'rmse' THEN a.rmse ELSE a.mae END AS before_value,
    CASE u.metric WHEN 'rmse' THEN b.rmse ELSE b.mae END AS after_value,
    CASE u.metric WHEN 'rmse' THEN b.rmse - a.rmse ELSE b.mae - a.mae END AS delta FROM m a JOIN m b ON b.key = a.key AND a.method = 'linear' AND b.method = 'discounted',
    (SELECT unnest(['rmse', 'mae']) AS metric) u"""), "6: before_value after_value delta")
def _(spark, d):
    rows = score.long_metrics(_m(spark, d), ["key", "method"], ["rmse", "mae"])
    return score.deltas(rows, ["key"], "linear", "discounted")


@query("i21_best_method", _with_m("""SELECT key, arg_min(method, rmse) AS best_method, min(rmse) AS best_rmse FROM m GROUP BY 1"""), "6: best_rmse")
def _(spark, d):
    return score.best(_m(spark, d), ["key"], "rmse")


@query("s5_metrics_rows", _with_m("""SELECT 'prices' AS experiment, key || '/' || method AS method, u.metric,
    CASE u.metric WHEN 'rmse' THEN rmse WHEN 'mae' THEN mae ELSE nse END AS value FROM m, (SELECT unnest(['rmse', 'mae', 'nse']) AS metric) u"""), "6: value")
def _(spark, d):
    m = _m(spark, d).withColumn("method", F.concat_ws("/", "key", "method")).withColumn("experiment", F.lit("prices"))
    return score.long_metrics(m, ["experiment", "method"], ["rmse", "mae", "nse"])

"""Stations and grids, image patches, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, profile, raster, similarity, spatial
from ..operators.attach import attach
from .base import CTE, BAND_SLICES, cells, patch_pairs, patches, query, read, stations, with_

# ================================================================== stations -> cells

_ST = "coords stations cells"


@query("j1_inverse_distance", with_(_ST, """SELECT c.cell_id, sum(s.value / w) / sum(1 / w) AS pred FROM (SELECT c.cell_id, s.value,
    pow(greatest(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)), 1e-9), 2) AS w FROM cells c, stations s) t JOIN cells c ON c.cell_id = t.cell_id JOIN (SELECT 1) s ON true GROUP BY 1""")
       .replace("sum(s.value / w) / sum(1 / w)", "sum(t.value / t.w) / sum(1 / t.w)"), "6: pred")
def _(spark, d):
    return spatial.idw(stations(spark, d), cells(spark, d), [], "cell_id")


@query("j1_inverse_distance_within", with_(_ST, """SELECT cell_id, sum(value / w) / sum(1 / w) AS pred FROM (SELECT c.cell_id, s.value, pow(greatest(dd, 1e-9), 2) AS w
    FROM (SELECT c.cell_id, s.value, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS dd FROM cells c, stations s) s JOIN cells c ON c.cell_id = s.cell_id WHERE dd <= 8.0) GROUP BY 1"""), "6: pred")
def _(spark, d):
    return spatial.idw_within(stations(spark, d), cells(spark, d), [], "cell_id", 8.0)


_PAIRS = """pr AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dd, 0.5 * pow(a.value - b.value, 2) AS g FROM stations a JOIN stations b ON a.id < b.id)"""


@query("j2_pair_distances", with_("coords stations", "").rstrip() + ",\n" + _PAIRS + "\nSELECT quantile_cont(dd, 0.9) AS max_dist FROM pr", "6: max_dist")
def _(spark, d):
    return spatial.pair_distance_quantile(stations(spark, d), [])


@query("g21_semivariogram", with_("coords stations", "").rstrip() + ",\n" + _PAIRS + """,
    mx AS (SELECT quantile_cont(dd, 0.9) AS m FROM pr)
    SELECT CAST(b AS INTEGER) AS bin, (b + 0.5) * m / 15 AS lag, avg(g) AS gamma, count(g) AS n_pairs FROM (SELECT unnest(range(15)) AS b) CROSS JOIN mx
    LEFT JOIN pr ON floor(dd / (m / 15)) = b AND dd < m GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY b, m"), "6: lag gamma")
def _(spark, d):
    return spatial.variogram(stations(spark, d), [])


CTE["vgfit"] = _PAIRS + """,
    mx AS (SELECT quantile_cont(dd, 0.9) AS m FROM pr),
    vg AS (SELECT (floor(dd / (m / 15)) + 0.5) * m / 15 AS h, avg(g) AS g, CAST(count(*) AS DOUBLE) AS w FROM pr CROSS JOIN mx WHERE dd < m GROUP BY floor(dd / (m / 15)), m),
    ve AS (SELECT ln(greatest(min(h), 1e-9) / 2) AS lo, ln(max(h) * 3) AS hi FROM vg),
    vr AS (SELECT exp(lo + i * ((hi - lo) / 59)) AS rng FROM ve, (SELECT unnest(range(60)) AS i)),
    vs AS (SELECT rng, sum(w) AS w, sum(w * u) AS wu, sum(w * u * u) AS wuu, sum(w * g) AS wg, sum(w * u * g) AS wug, sum(w * g * g) AS wgg
      FROM (SELECT rng, w, g, 1 - exp(-h / rng) AS u FROM vg, vr) GROUP BY 1),
    vb AS (SELECT *, (w * wug - wu * wg) / (w * wuu - wu * wu) AS sl FROM vs),
    vc AS (SELECT *, greatest((wg - sl * wu) / w, 1e-9) AS nugget, greatest(sl, 1e-9) AS sill FROM vb),
    vgfit AS (SELECT nugget, sill, rng FROM vc ORDER BY nugget * nugget * w + 2 * nugget * sill * wu + sill * sill * wuu - 2 * nugget * wg - 2 * sill * wug + wgg, rng LIMIT 1)"""
#: Ordinary kriging from three stations: the covariance matrix inverted by cofactors.
_KRIGE3 = """,
    near AS (SELECT * FROM (SELECT c.cell_id, s.x, s.y, {value} AS z, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS dd,
        row_number() OVER (PARTITION BY c.cell_id ORDER BY sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)), s.id) AS r FROM cells c, {stations} s) WHERE r <= 3),
    tri AS (SELECT a.cell_id, a.z AS z1, b.z AS z2, e.z AS z3, v.sill + v.nugget AS k, v.sill * exp(-a.dd / v.rng) AS r1, v.sill * exp(-b.dd / v.rng) AS r2, v.sill * exp(-e.dd / v.rng) AS r3,
        v.sill * exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / v.rng) AS c12, v.sill * exp(-sqrt(pow(a.x - e.x, 2) + pow(a.y - e.y, 2)) / v.rng) AS c13,
        v.sill * exp(-sqrt(pow(b.x - e.x, 2) + pow(b.y - e.y, 2)) / v.rng) AS c23
      FROM near a JOIN near b ON b.cell_id = a.cell_id AND b.r = 2 JOIN near e ON e.cell_id = a.cell_id AND e.r = 3, vgfit v WHERE a.r = 1),
    inv AS (SELECT *, k * k - c23 * c23 AS i11, c13 * c23 - c12 * k AS i12, c12 * c23 - c13 * k AS i13, k * k - c13 * c13 AS i22, c12 * c13 - c23 * k AS i23, k * k - c12 * c12 AS i33,
        k * (k * k - c23 * c23) - c12 * (c12 * k - c23 * c13) + c13 * (c12 * c23 - k * c13) AS det FROM tri),
    sol AS (SELECT *, (i11 * r1 + i12 * r2 + i13 * r3) / det AS a1, (i12 * r1 + i22 * r2 + i23 * r3) / det AS a2, (i13 * r1 + i23 * r2 + i33 * r3) / det AS a3,
        (i11 + i12 + i13) / det AS b1, (i12 + i22 + i23) / det AS b2, (i13 + i23 + i33) / det AS b3 FROM inv),
    lag AS (SELECT *, (a1 + a2 + a3 - 1) / (b1 + b2 + b3) AS mu FROM sol),
    krige AS (SELECT cell_id, (a1 - mu * b1) * z1 + (a2 - mu * b2) * z2 + (a3 - mu * b3) * z3 AS mean,
        sqrt(greatest(k - ((a1 - mu * b1) * r1 + (a2 - mu * b2) * r2 + (a3 - mu * b3) * r3 + mu), 0)) AS sd FROM lag)"""


def _fitted(s, keys=()):
    return spatial.fit_variogram(spatial.variogram(s, list(keys)), list(keys))


def _networks(df, number: str):
    """Stations or cells of three networks, dealt by their number."""
    return df.withColumn("network", F.expr(f"{number} div 2 % 3"))


@query("j12_variogram_fit", with_("coords stations vgfit", "SELECT * FROM vgfit"), "6: nugget sill rng")
def _(spark, d):
    return _fitted(stations(spark, d))


@query("j12_local_kriging")
def _(spark, d):
    s = stations(spark, d)
    return spatial.kriging(s, cells(spark, d), [], "cell_id", model=_fitted(s))


@query("j12_kriging_of_three", with_("coords stations cells vgfit", "SELECT * FROM krige").replace("\nSELECT * FROM krige", _KRIGE3.format(value="s.value", stations="stations") + "\nSELECT * FROM krige"),
       "5: mean sd")
def _(spark, d):
    s = stations(spark, d)
    return spatial.kriging(s, cells(spark, d), [], "cell_id", model=_fitted(s), k_near=3)


@query("j12_kriging_of_networks")
def _(spark, d):
    s, c = _networks(stations(spark, d), "id"), _networks(cells(spark, d), "cell_id")
    return spatial.kriging(s, c, ["network"], "cell_id", model=_fitted(s, ["network"]))


@query("o6_regression_kriging")
def _(spark, d):
    s = stations(spark, d)
    return spatial.regression_kriging(s, cells(spark, d), [], "cell_id", ["x", "y", "cov"], model=_fitted(s))


@query("c6_coordinate_interpolation")
def _(spark, d):
    s, c = stations(spark, d), cells(spark, d)
    truth = c.select("cell_id", F.col("truth").alias("y_true"))
    a = spatial.idw(s, c, [], "cell_id").select("cell_id", F.lit("idw").alias("method"), F.col("pred").alias("y_pred"))
    b = spatial.kriging(s, c, [], "cell_id", model=_fitted(s)).select("cell_id", F.lit("kriging").alias("method"), F.col("mean").alias("y_pred"))
    return metrics.table(a.unionByName(b).join(truth, "cell_id"), ["method"], ["rmse", "mae"])


# ================================================================== gridded fields

NX, NY = 53, 40
AXES = dict(x0=-40.0, dx=1.5, nx=NX, y0=-40.0, dy=2.0, ny=NY)


def full_field(spark, d):
    """iy, ix, value without keys: mean order price by customer band and week."""
    return read(spark, d, "orders").groupBy(
        (F.col("o_custkey") % NY).alias("iy"), F.floor((F.dayofyear("o_orderdate") - 1) / 7).cast("long").alias("ix")).agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("value"))


def sparse_field(spark, d):
    """The same field per priority with every cell present; cells without orders are NULL."""
    have = read(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("layer"), (F.col("o_custkey") % NY).alias("iy"),
        F.floor((F.dayofyear("o_orderdate") - 1) / 7).cast("long").alias("ix")).agg((F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("value"))
    spine = have.select("layer").distinct().withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NX * NY - 1).cast("long"))))
    spine = spine.select("layer", F.floor(F.col("_c") / NX).alias("iy"), (F.col("_c") % NX).alias("ix"))
    return spine.join(have, ["layer", "iy", "ix"], "left")


CTE["field"] = f"""field AS (SELECT o_custkey % {NY} AS iy, (dayofyear(o_orderdate) - 1) // 7 AS ix, round(sum(o_totalprice), 2) / count(*) AS value FROM orders GROUP BY 1, 2)"""
CTE["sparse"] = f"""have AS (SELECT o_orderpriority AS layer, o_custkey % {NY} AS iy, (dayofyear(o_orderdate) - 1) // 7 AS ix, round(sum(o_totalprice), 2) / count(*) AS value FROM orders GROUP BY 1, 2, 3),
sparse AS (SELECT l.layer, c // {NX} AS iy, c % {NX} AS ix, h.value FROM (SELECT DISTINCT layer FROM have) l CROSS JOIN (SELECT unnest(range({NX * NY})) AS c)
  LEFT JOIN have h ON h.layer = l.layer AND h.iy = c // {NX} AND h.ix = c % {NX})"""


def _bilinear_sql(points: str, keep: str, axes: dict, grid: str = "field", keys: str = "") -> str:
    k = lambda t: f" AND {t}.{keys} = p.{keys}" if keys else ""
    corner = lambda t, dx, dy: f"LEFT JOIN {grid} {t} ON {t}.ix = p.cx + {dx} AND {t}.iy = p.cy + {dy}{k(t)}"
    term = lambda w, t: f"CASE WHEN {w} > 0 THEN {w} * {t}.value ELSE 0 END"
    return f"""SELECT {keep}, {term('(1 - tx) * (1 - ty)', 'a')} + {term('tx * (1 - ty)', 'b')} + {term('(1 - tx) * ty', 'c')} + {term('tx * ty', 'e')} AS sampled FROM (
    SELECT *, greatest(0.0, least(1.0, u - cx)) AS tx, greatest(0.0, least(1.0, v - cy)) AS ty FROM (
      SELECT *, greatest(0, least(CAST(floor(u) AS BIGINT), {axes['nx'] - 2})) AS cx, greatest(0, least(CAST(floor(v) AS BIGINT), {axes['ny'] - 2})) AS cy FROM (
        SELECT *, (x - {axes['x0']}) / {axes['dx']} AS u, (y - {axes['y0']}) / {axes['dy']} AS v FROM {points}))) p
    {corner('a', 0, 0)} {corner('b', 1, 0)} {corner('c', 0, 1)} {corner('e', 1, 1)}"""


@query("j7_bilinear_sampling", with_("coords cells field", _bilinear_sql("cells", "cell_id", AXES)), "3: sampled")
def _(spark, d):
    return raster.sample_bilinear(cells(spark, d), full_field(spark, d), [], "x", "y", AXES).select("cell_id", "sampled")


@query("j8_nearest_cell", with_("coords cells field", f"""SELECT cell_id, f.value AS sampled FROM (SELECT *, greatest(0, least(CAST(floor((x + 40.0) / 1.5 + 0.5) AS BIGINT), {NX - 1})) AS px,
    greatest(0, least(CAST(floor((y + 40.0) / 2.0 + 0.5) AS BIGINT), {NY - 1})) AS py FROM cells) p JOIN field f ON f.ix = px AND f.iy = py"""))
def _(spark, d):
    return raster.sample_nearest(cells(spark, d), full_field(spark, d), [], "x", "y", AXES).select("cell_id", "sampled")


_DST = dict(x0=-39.0, dx=2.2, nx=36, y0=-39.5, dy=1.1, ny=72)


@query("j13_bilinear_regrid", with_("sparse", "").rstrip() + ",\nfl AS (SELECT layer, iy, ix, coalesce(value, 0.0) AS value FROM sparse)\n"
       + f"SELECT layer, ty, tx, sampled AS value FROM ({_bilinear_sql('tgt', 'p.layer, p.ty_i AS ty, p.tx_i AS tx', AXES, 'fl', 'layer')})".replace(
           "FROM tgt", "FROM (SELECT DISTINCT layer, t % 36 AS tx_i, t // 36 AS ty_i, -39.0 + (t % 36) * 2.2::DOUBLE AS x, -39.5 + (t // 36) * 1.1::DOUBLE AS y FROM fl, (SELECT unnest(range(36 * 72)) AS t)) tgt"))
def _(spark, d):
    f = sparse_field(spark, d).fillna({"value": 0.0})
    return raster.regrid_bilinear(f, ["layer"], AXES, _DST)


_SRC_E = dict(x0=0.0, dx=1.0, nx=NX, y0=-60.0, dy=3.0, ny=NY)
_DST_E = dict(x0=0.5, dx=3.7, nx=14, y0=-58.0, dy=7.0, ny=16)


@query("j14_conservative_regrid", with_("sparse", f"""SELECT layer, ty, tx, sum(wx * wy * value) / sum(wx * wy) AS value FROM sparse s
    JOIN (SELECT t AS tx, i AS ix, least(0.5 + (t + 1) * 3.7, i + 1.0) - greatest(0.5 + t * 3.7, i + 0.0) AS wx FROM (SELECT unnest(range(14)) AS t), (SELECT unnest(range({NX})) AS i)) a
      ON a.ix = s.ix AND a.wx > 0
    JOIN (SELECT *, sin(radians(least(-58.0 + (t + 1) * 7.0, -60.0 + (i + 1) * 3.0))) - sin(radians(greatest(-58.0 + t * 7.0, -60.0 + i * 3.0))) AS wy, t AS ty, i AS iy
      FROM (SELECT unnest(range(16)) AS t), (SELECT unnest(range({NY})) AS i)
      WHERE least(-58.0 + (t + 1) * 7.0, -60.0 + (i + 1) * 3.0) > greatest(-58.0 + t * 7.0, -60.0 + i * 3.0)) b ON b.iy = s.iy AND b.wy > 0
    WHERE value IS NOT NULL GROUP BY 1, 2, 3"""), "3: value")
def _(spark, d):
    return raster.regrid_conservative(sparse_field(spark, d), ["layer"], _SRC_E, _DST_E)


@query("j15_fill_nearest", with_("sparse", """SELECT layer, iy, ix, coalesce(value, v) AS value FROM (SELECT m.layer, m.iy, m.ix, m.value, g.v FROM sparse m LEFT JOIN (
    SELECT m.layer, m.iy, m.ix, arg_min(s.value, (s.iy - m.iy) * (s.iy - m.iy) * 1000000000 + (s.ix - m.ix) * (s.ix - m.ix) * 1000000000 + s.iy * 10000 + s.ix) AS v
    FROM sparse m JOIN sparse s ON s.layer = m.layer WHERE m.value IS NULL AND s.value IS NOT NULL GROUP BY 1, 2, 3) g
    ON g.layer = m.layer AND g.iy = m.iy AND g.ix = m.ix)"""))
def _(spark, d):
    return raster.fill_nearest(sparse_field(spark, d), ["layer"])


@query("g32_field_summary", with_("sparse", "SELECT layer, count(value) AS n, min(value) AS vmin, max(value) AS vmax, avg(value) AS vmean, stddev_pop(value) AS vstd FROM sparse GROUP BY 1"),
       "3: vmin vmax vmean vstd")
def _(spark, d):
    return profile.field_summary(sparse_field(spark, d), ["layer"], "value")


# ================================================================== patches

_all = " || ".join(BAND_SLICES)
_ratio = lambda a, b: f"list_avg(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) / (z[1] + z[2] + 1e-6)))"


@query("p12_spectral_indices", with_("patches", f"SELECT patch_id, {_ratio('nir', 'red')} AS ndvi, {_ratio('green', 'nir')} AS ndwi, list_avg(swir) AS swir_mean, list_avg({_all}) AS brightness FROM patches"),
       "6: ndvi ndwi swir_mean brightness")
def _(spark, d):
    return raster.spectral_indices(patches(spark, d)).select("patch_id", "ndvi", "ndwi", "swir_mean", "brightness")


@query("p13_patch_ndvi", with_("patches ndvi", "SELECT patch_id, ndvi FROM ndvi"), "6: ndvi")
def _(spark, d):
    return raster.patch_ndvi(patches(spark, d)).select("patch_id", "ndvi")


def _drops(spark, d):
    t0, t1 = patch_pairs(spark, d)
    lab = t0.select("patch_id", F.col("label").alias("l0")).join(t1.select("patch_id", F.col("label").alias("l1")), "patch_id")
    lab = lab.select("patch_id", (F.col("l0") != F.col("l1")).cast("int").alias("changed"))
    x = raster.ndvi_drop(t0, t1, ["patch_id"]).join(lab, "patch_id")
    return x.withColumn("drop", F.round("drop", 9))


CTE["rdrops"] = 'rdrops AS (SELECT patch_id, changed, ndvi0, ndvi1, round("drop", 9) AS "drop" FROM drops)'
_D = "patches ndvi drops rdrops"


@query("j6_ndvi_drop_pairs", with_(_D, 'SELECT patch_id, "drop", changed FROM rdrops'))
def _(spark, d):
    return _drops(spark, d).select("patch_id", "drop", "changed")


@query("i10_detect_change", with_(_D, 'SELECT patch_id, CAST("drop" >= 0.05 AS INTEGER) AS pred FROM rdrops'))
def _(spark, d):
    return raster.detect_change(_drops(spark, d), F.lit(0.05)).select("patch_id", "pred")


_THR = """cand AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS t FROM (SELECT DISTINCT "drop" AS v FROM rdrops) UNION ALL SELECT min("drop") - 1e-3 FROM rdrops
    UNION ALL SELECT max("drop") + 1e-3 FROM rdrops),
sc AS (SELECT t, count(*) FILTER (WHERE changed = 1 AND "drop" >= t) AS tp, count(*) FILTER (WHERE changed = 0 AND "drop" >= t) AS fp,
    count(*) FILTER (WHERE changed = 1 AND "drop" < t) AS fn, count(*) FILTER (WHERE changed = 0 AND "drop" < t) AS tn FROM cand, rdrops WHERE t IS NOT NULL GROUP BY 1),
fs AS (SELECT t, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS f1 FROM sc),
thr AS (SELECT t AS threshold, f1 AS macro_f1 FROM fs ORDER BY round(f1, 12) DESC, t LIMIT 1)"""


@query("i11_best_threshold", with_(_D, "").rstrip() + ",\n" + _THR + "\nSELECT * FROM thr", "9: threshold; 6: macro_f1")
def _(spark, d):
    return raster.best_threshold(_drops(spark, d), [], "drop", "changed")


@query("t2k_most_changed", with_(_D, 'SELECT patch_id, "drop" FROM rdrops ORDER BY "drop" DESC, patch_id LIMIT 20'))
def _(spark, d):
    return raster.rank_change(_drops(spark, d), "patch_id", 20).select("patch_id", "drop")


@query("c4_change_detection", with_(_D, "").rstrip() + ",\n" + _THR + """
    SELECT count(*) FILTER (WHERE changed = CAST("drop" >= threshold AS INTEGER)) / count(*) AS accuracy, any_value(macro_f1) AS macro_f1 FROM rdrops, thr""", "6: accuracy macro_f1")
def _(spark, d):
    x = _drops(spark, d)
    p = raster.detect_change(attach(x, raster.best_threshold(x, [], "drop", "changed"), []), F.col("threshold"))
    return metrics.classification(p, [], "changed", "pred").select("accuracy", "macro_f1")


@query("p18_rescale_bands", with_("patches", """SELECT patch_id, list_sum(list_transform(red, lambda v: (v * 0.5 - 0.1 - 0.2) / 0.4)) AS red_sum,
    list_sum(list_transform(nir, lambda v: (v * 0.5 - 0.1) / 1.0)) AS nir_sum FROM patches"""), "6: red_sum nir_sum")
def _(spark, d):
    r = raster.rescale(patches(spark, d), ["red", "nir"], 0.5, -0.1, {"red": (0.2, 0.4)})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return r.select("patch_id", total("red").alias("red_sum"), total("nir").alias("nir_sum"))


@query("p18_unit_conversion", "SELECT event_id, value - 273.15 AS celsius FROM events", "6: celsius")
def _(spark, d):
    from ..functions.scalars import kelvin_to_celsius
    return read(spark, d, "events").select("event_id", kelvin_to_celsius(F.col("value")).alias("celsius"))


# ================================================================== embeddings


def _train_test(spark, d):
    e = read(spark, d, "embeddings")
    return e.filter(F.col("vec_id") % 5 != 0), e.filter(F.col("vec_id") % 5 == 0)


_MU = """mom AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM (SELECT unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, vec_id FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY 1),
z AS (SELECT vec_id, label, list((v - mu) / (sd + 1e-8) ORDER BY i) AS e FROM (SELECT unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, vec_id, label FROM embeddings) JOIN mom USING (i) GROUP BY 1, 2)"""


@query("j10_knn_vote", f"""WITH {_MU},
    nn AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, t.e), 8), t.vec_id) AS r FROM z q JOIN z t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
    vt AS (SELECT vec_id, label, count(*) AS c FROM nn WHERE r <= 5 GROUP BY 1, 2)
    SELECT vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS k FROM vt) WHERE k = 1""")
def _(spark, d):
    tr, te = _train_test(spark, d)
    tz = similarity.standardize_arrays(tr, tr, "embedding")
    qz = similarity.standardize_arrays(tr, te, "embedding")
    return similarity.knn_classify(tz, qz, "vec_id", "embedding", "label", 5)


@query("i18_linear_probe")
def _(spark, d):
    tr, te = _train_test(spark, d)
    return similarity.linear_probe(tr, te, "embedding", "label").select("vec_id", "label", F.col("pred").cast("int").alias("pred"))


@query("c5_embedding_heads")
def _(spark, d):
    tr, te = _train_test(spark, d)
    tz = similarity.standardize_arrays(tr, tr, "embedding")
    qz = similarity.standardize_arrays(tr, te, "embedding")
    knn = similarity.knn_classify(tz, qz, "vec_id", "embedding", "label", 5).join(te.select("vec_id", "label"), "vec_id")
    lin = similarity.linear_probe(tr, te, "embedding", "label")
    both = knn.select(F.lit("knn").alias("head"), "label", F.col("pred").cast("int").alias("pred")).unionByName(
        lin.select(F.lit("linear").alias("head"), "label", F.col("pred").cast("int").alias("pred")))
    return metrics.classification(both, ["head"], "label", "pred")


@query("f2_user_encoder", """SELECT vec_id, list_avg(CAST(embedding AS DOUBLE[])) AS m FROM embeddings""", "5: m")
def _(spark, d):
    import numpy as np
    enc = similarity.encode(read(spark, d, "embeddings"), lambda b: np.stack(b["embedding"].to_numpy()).mean(axis=1, dtype="float64", keepdims=True),
                            ["embedding"], "code", ["vec_id"])
    return enc.select("vec_id", F.element_at("code", 1).cast("double").alias("m"))


@query("o8_principal_components")
def _(spark, d):
    x = cells(spark, d)
    return profile.kmeans(profile.pca(x, ["x", "y", "cov"], 2).transform(
        __import__("pyspark.ml.feature", fromlist=["VectorAssembler"]).VectorAssembler(inputCols=["x", "y", "cov"], outputCol="_v").transform(x)).drop("_v", "pc"),
        ["x", "y", "cov"], 3).select("cell_id", "cluster")

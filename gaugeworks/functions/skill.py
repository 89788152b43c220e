"""Skill and calibration metrics as aggregate columns over (y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GUARD = 1e-12


def _safe(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(F.avg((t - p) * (t - p)))


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p))


def bias(t: Column, p: Column) -> Column:
    return F.avg(p - t)


def mape(t: Column, p: Column, eps: float = 1e-8) -> Column:
    return F.avg(F.abs(t - p) / (F.abs(t) + eps)) * 100.0


def nse(t: Column, p: Column) -> Column:
    """1 - SSE / total sum of squares (also R squared); NULL for a constant truth."""
    sst = F.count(t) * F.var_pop(t)
    return F.when(sst > 0, 1.0 - F.sum((t - p) * (t - p)) / sst)


r2 = nse


def kge(t: Column, p: Column) -> Column:
    """Kling-Gupta efficiency with population deviations."""
    st, sp, mt, mp = F.stddev_pop(t), F.stddev_pop(p), F.avg(t), F.avg(p)
    r = F.when(sp > 0, F.coalesce(F.corr(t, p), F.lit(0.0))).otherwise(0.0)
    ok = (st > 0) & (mt != 0)
    return F.when(ok, 1.0 - F.sqrt((r - 1) ** 2 + (sp / st - 1) ** 2 + (mp / mt - 1) ** 2))


def acc(t: Column, p: Column) -> Column:
    """Anomaly correlation against the mean of the truth (the prediction is not re-centred)."""
    n, mt, mp = F.count(t), F.avg(t), F.avg(p)
    cross = n * F.covar_pop(t, p)
    ss_t = n * F.var_pop(t)
    ss_p = n * (F.var_pop(p) + (mp - mt) * (mp - mt))
    return _safe(cross, F.sqrt(ss_t * ss_p))


def acc_given(t: Column, p: Column, clim: Column) -> Column:
    """Anomaly correlation against a climatology column."""
    return _safe(F.sum((t - clim) * (p - clim)),
                 F.sqrt(F.sum((t - clim) ** 2) * F.sum((p - clim) ** 2)))


def skill(m: Column, ref: Column, higher_is_better: bool = False) -> Column:
    if higher_is_better:
        return (m - ref) / (F.abs(ref) + GUARD)
    return 1.0 - m / (ref + GUARD)


def spike(t: Column, p: Column, threshold: Column) -> dict[str, Column]:
    """Exceedance detection counts and scores (strictly above the threshold)."""
    a, b = t > threshold, p > threshold
    tp, fp, fn, tn = F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b), F.count_if(~a & ~b)
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return {"precision": prec, "recall": rec, "f1": f1, "support": tp + fn, "tp": tp, "fp": fp, "fn": fn, "tn": tn}


REGISTRY = {"rmse": rmse, "mae": mae, "bias": bias, "mape": mape, "r2": r2, "nse": nse, "kge": kge, "acc": acc,
            "lat_weighted_rmse": rmse}   # on a one-dimensional series every weight is 1
HIGHER_IS_BETTER = {"r2", "nse", "kge", "acc"}


def skill_vs_persistence(t: Column, p: Column, ref: Column) -> Column:
    """Skill of the root mean squared error against that of a reference prediction."""
    return skill(rmse(t, p), rmse(t, ref))


def primary(name: str, reference: str = "reference_pred") -> Column:
    """Aggregate for a configured primary metric; ``skill_vs_persistence`` also reads the ``reference`` column."""
    t, p = F.col("y_true"), F.col("y_pred")
    if name == "skill_vs_persistence":
        return skill_vs_persistence(t, p, F.col(reference))
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}; one of {sorted([*REGISTRY, 'skill_vs_persistence'])}")
    return REGISTRY[name](t, p)

"""Scalar feature expressions (all native columns)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

YEAR_DAYS = 365.25


def calendar(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), day of year and a 1.0/0.0 weekend flag."""
    dow = F.weekday(ts)
    return {"hour": F.hour(ts), "dow": dow, "doy": F.dayofyear(ts),
            "is_weekend": F.when(dow >= 5, 1.0).otherwise(0.0)}


def cyclical(value: Column, period: float, name: str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def doy_cycle(ts: Column | None = None, *, pos: Column | None = None, period: float = YEAR_DAYS,
              zero_based: bool = False, name: str = "doy") -> dict[str, Column]:
    """Annual cycle from a date, or from a 0-based position when there is no calendar."""
    if ts is not None:
        day = F.dayofyear(ts)
    else:
        day = pos % 365 + (0 if zero_based else 1)
    return cyclical(day, period, name)


def exceeds(value: Column, threshold: Column) -> Column:
    return (value > threshold).cast("int")


def clip_min(value: Column, low: float = 0.0) -> Column:
    return F.greatest(value, F.lit(low))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def pet(temperature: Column, doy: Column, base: float = 0.6, temp_coef: float = 0.12) -> Column:
    """Potential evapotranspiration from temperature and season, mm per day."""
    season = 1.0 + 0.5 * F.cos(F.lit(2.0) * F.pi() * (doy - 196) / F.lit(YEAR_DAYS))
    warm = F.greatest(temperature, F.lit(0.0))
    return F.greatest(F.lit(base) * season + F.lit(temp_coef) * warm, F.lit(0.0))


def spatial_design(x: Column, y: Column, cov: Column, domain: float) -> dict[str, Column]:
    u, v = x / F.lit(float(domain)), y / F.lit(float(domain))
    return {"fx": u, "fy": v, "fcov": cov, "fxy": u * v, "fcov2": cov * cov, "fxcov": u * cov, "fycov": v * cov}


def glm_design(t: Column, p: Column, e: Column) -> dict[str, Column]:
    """Linear terms plus squares of temperature and precipitation (elevation is not squared)."""
    return {"t": t, "p": p, "e": e, "t2": t * t, "p2": p * p}


def regime_bins(phase: Column, k: int) -> Column:
    """Bin a slow index in [-1, 1] into 0..k-1."""
    return F.least(F.greatest(F.floor((phase + 1.0) / 2.0 * k), F.lit(0)), F.lit(k - 1)).cast("int")


def kelvin_to_celsius(v: Column) -> Column:
    return v - 273.15


def md5_int(text: Column) -> Column:
    """60-bit non-negative integer from an md5 digest; the same value in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

"""Column forms of special functions that Spark SQL has no built-in for."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Published polynomial coefficients.
# Abramowitz & Stegun 7.1.26 (error function, absolute error below 1.5e-7)
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
# Acklam's rational approximation of the normal quantile
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
ACKLAM_LOW = 0.02425
# Lanczos approximation of the gamma function, g = 7
LANCZOS_G = 7.0
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7]


def _poly(x: Column, coeffs) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (1.0 + F.lit(ERF_P) * ax)
    y = 1.0 - _poly(t, ERF_A[::-1]) * t * F.exp(-ax * ax)
    return F.signum(x) * y


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - norm_cdf(F.abs(z)))


def norm_ppf(p: Column) -> Column:
    """Normal quantile; NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    mid = _poly(r, ACKLAM_A) * q / _poly(r, ACKLAM_B + [1.0])

    def tail(u: Column) -> Column:
        s = F.sqrt(-2.0 * F.log(u))
        return _poly(s, ACKLAM_C) / _poly(s, ACKLAM_D + [1.0])

    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < ACKLAM_LOW, tail(p))
            .when(p <= 1 - ACKLAM_LOW, mid)
            .otherwise(-tail(1.0 - p)))


def normal_z(level: float) -> float:
    """Two-sided normal multiplier of a nominal level."""
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def gamma(x: Column) -> Column:
    """Gamma function for x > 0.5."""
    z = x - 1.0
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        s = s + F.lit(c) / (z + float(i))
    t = z + LANCZOS_G + 0.5
    return F.sqrt(F.lit(2.0) * F.pi()) * F.pow(t, z + 0.5) * F.exp(-t) * s

"""Special functions Spark has no built-in for.

Log-gamma, digamma and the normal quantile are plain column expressions. The incomplete gamma and beta
functions iterate, so they run as Arrow-batched numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Lanczos coefficients, g = 7, 9 terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
# Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425
# Two-sided 95% and 90%/99% Student t critical values for 1..29 degrees of freedom.
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
        2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045)
T_90 = (6.314, 2.920, 2.353, 2.132, 2.015, 1.943, 1.895, 1.860, 1.833, 1.812, 1.796, 1.782, 1.771, 1.761, 1.753,
        1.746, 1.740, 1.734, 1.729, 1.725, 1.721, 1.717, 1.714, 1.711, 1.708, 1.706, 1.703, 1.701, 1.699)
T_99 = (63.657, 9.925, 5.841, 4.604, 4.032, 3.707, 3.499, 3.355, 3.250, 3.169, 3.106, 3.055, 3.012, 2.977, 2.947,
        2.921, 2.898, 2.878, 2.861, 2.845, 2.831, 2.819, 2.807, 2.797, 2.787, 2.779, 2.771, 2.763, 2.756)
T_TABLES = {0.90: T_90, 0.95: T_95, 0.99: T_99}


def _horner(coefficients: tuple[float, ...], x: Column, tail: float | None = None) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total if tail is None else total * x + F.lit(tail)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: shift up by 6, then the asymptotic series."""
    y = x + 6.0
    inv = F.lit(1.0) / (y * y)
    series = F.ln(y) - F.lit(0.5) / y - inv * (F.lit(1 / 12) - inv * (F.lit(1 / 120) - inv * F.lit(1 / 252)))
    for i in range(6):
        series = series - F.lit(1.0) / (x + float(i))
    return series


def trigamma(x: Column) -> Column:
    y = x + 6.0
    inv = F.lit(1.0) / (y * y)
    series = F.lit(1.0) / y + inv * F.lit(0.5) + inv / y * (F.lit(1 / 6) - inv * (F.lit(1 / 30) - inv * F.lit(1 / 42)))
    for i in range(6):
        series = series + F.lit(1.0) / ((x + float(i)) * (x + float(i)))
    return series


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal CDF on (0, 1); NULL outside."""
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    q = p - 0.5
    r = q * q
    lower = _horner(ACKLAM_C, low) / _horner(ACKLAM_D, low, 1.0)
    upper = -_horner(ACKLAM_C, high) / _horner(ACKLAM_D, high, 1.0)
    centre = _horner(ACKLAM_A, r) * q / _horner(ACKLAM_B, r, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < ACKLAM_LOW, lower)
        .when(p > 1 - ACKLAM_LOW, upper)
        .otherwise(centre)
    )


def _np_log_gamma(a: np.ndarray) -> np.ndarray:
    z = a - 1.0
    series = np.full_like(a, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series += c / (z + i)
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


# Temme's uniform expansion of the incomplete gamma ratio for large shapes (three orders).
TEMME_0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -0.000178755144032922, 0.0000391926317852244)
TEMME_1 = (-1 / 540, -1 / 288, 1 / 378, -0.000990226337448560, 0.000205761316872428)
TEMME_2 = (0.00413359788359788, -0.00268132716049383, 0.000771604938271605)
LARGE_SHAPE = 100.0


def _large_shape_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    mu = (x - a) / a
    half = np.maximum(mu - np.log1p(mu), 0.0)
    eta = np.sign(mu) * np.sqrt(2 * half)
    near = np.clip(eta, -1.0, 1.0)
    first = sum(c * near**i for i, c in enumerate(TEMME_0))
    second = sum(c * near**i for i, c in enumerate(TEMME_1))
    third = sum(c * near**i for i, c in enumerate(TEMME_2))
    tail = np.fromiter((0.5 * math.erfc(v) for v in np.ravel(-eta * np.sqrt(a / 2))), float, a.size).reshape(a.shape)
    return tail - np.exp(-a * half) / np.sqrt(2 * np.pi * a) * (first + second / a + third / a**2)


def regularised_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x): power series below a + 1, continued fraction evaluated from its tail above.

    Both slow down with the square root of a, so shapes above 100 use the uniform expansion
    (error below 1e-10).
    """
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    known = (a > 0) & (x >= 0)
    out[known & (x == 0)] = 0.0
    huge = known & (x > 0) & (a > LARGE_SHAPE)
    if huge.any():
        out[huge] = _large_shape_gamma(a[huge], x[huge])
    known = known & (a <= LARGE_SHAPE)
    small = known & (x > 0) & (x < a + 1)
    if small.any():
        s, v = a[small], x[small]
        term = 1.0 / s
        total = term.copy()
        for n in range(1, 1000):
            term = term * v / (s + n)
            total += term
            if np.all(term <= total * 1e-17):
                break
        out[small] = total * np.exp(s * np.log(v) - v - _np_log_gamma(s))
    large = known & (x >= a + 1)
    if large.any():
        s, v = a[large], x[large]
        tail = np.zeros_like(s)
        for n in range(80, 0, -1):
            tail = n * (n - s) / (v + 2 * n + 1 - s - tail)
        out[large] = 1.0 - np.exp(s * np.log(v) - v - _np_log_gamma(s)) / (v + 1 - s - tail)
    return out


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by its continued fraction, using the symmetric form where it converges faster."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    known = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[known & (x == 0)] = 0.0
    out[known & (x == 1)] = 1.0
    inner = known & (x > 0) & (x < 1)
    if not inner.any():
        return out
    p, q, v = a[inner], b[inner], x[inner]
    flip = v > (p + 1) / (p + q + 2)
    p, q, v = np.where(flip, q, p), np.where(flip, p, q), np.where(flip, 1 - v, v)
    front = np.exp(_np_log_gamma(p + q) - _np_log_gamma(p) - _np_log_gamma(q) + p * np.log(v) + q * np.log1p(-v)) / p
    tail = np.zeros_like(p)
    for m in range(300, 0, -1):
        odd = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
        tail = even / (1 + odd / (1 + tail))
    first = -(p + q) * v / (p + 1)
    value = front / (1 + first / (1 + tail))
    out[inner] = np.where(flip, 1 - value, value)
    return out


@F.pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """CDF of the gamma distribution, location 0."""
    values = regularised_gamma(shape.to_numpy(float), x.to_numpy(float) / scale.to_numpy(float))
    return pd.Series(values).where(np.isfinite(values), None)


def _np_normal_quantile(p: np.ndarray) -> np.ndarray:
    """:func:`normal_quantile` of an array; NaN outside (0, 1)."""
    q = p - 0.5
    r = q * q
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = np.sqrt(-2.0 * np.log(p)), np.sqrt(-2.0 * np.log(1.0 - p))
        lower, upper = (np.polyval(ACKLAM_C, x) / np.polyval((*ACKLAM_D, 1.0), x) for x in (low, high))
        centre = np.polyval(ACKLAM_A, r) * q / np.polyval((*ACKLAM_B, 1.0), r)
    return np.where((p > 0) & (p < 1), np.where(p < ACKLAM_LOW, lower, np.where(p > 1 - ACKLAM_LOW, -upper, centre)), np.nan)


@F.pandas_udf(DoubleType())
def likely_shape(a: pd.Series) -> pd.Series:
    """Maximum likelihood shape of a gamma distribution from A = ln mean(x) - mean(ln x): the closed form and four generalised Newton steps.

    Not a column expression: digamma and trigamma of four steps make a method beyond what the JVM compiles.
    """
    a = a.to_numpy(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = (1 + np.sqrt(1 + 4 * a / 3)) / (4 * a)
        for _ in range(4):
            y = k + 6.0
            inv = 1.0 / (y * y)
            di = np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252)))
            tri = 1.0 / y + inv * 0.5 + inv / y * (1 / 6 - inv * (1 / 30 - inv * (1 / 42)))
            for i in range(6):
                di = di - 1.0 / (k + i)
                tri = tri + 1.0 / ((k + i) * (k + i))
            k = 1.0 / (1.0 / k + (np.log(k) - di - a) / (k * k * (1.0 / k - tri)))
    return pd.Series(k).where(np.isfinite(k), None)


@F.pandas_udf(DoubleType())
def gamma_score(x: pd.Series, shape: pd.Series, scale: pd.Series, zero: pd.Series, limit: pd.Series) -> pd.Series:
    """Normal quantile of zero + (1 - zero) G(x), G the gamma CDF (0 up to x = 0), cut at ``limit`` on both sides; NULL where an input is.

    Not a column expression, for the same reason as :func:`likely_shape`.
    """
    x, shape, scale, zero, limit = (v.to_numpy(float) for v in (x, shape, scale, zero, limit))
    g = np.where((x <= 0) & ~np.isnan(shape), 0.0, regularised_gamma(shape, x / scale))
    p = zero + (1 - zero) * np.where(np.isfinite(g), g, np.nan)
    score = np.where(p <= 0, -limit, np.where(p >= 1, limit, np.clip(_np_normal_quantile(p), -limit, limit)))
    return pd.Series(score).where(np.isfinite(score), None)


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of Pearson r over n pairs (t test with n - 2 degrees of freedom)."""
    dof = n.to_numpy(float) - 2
    # t^2 / (t^2 + dof) equals r^2, so the p-value is I_{1-r^2}(dof/2, 1/2).
    values = regularised_beta(dof / 2, np.full(len(dof), 0.5), np.clip(1 - r.to_numpy(float) ** 2, 0, 1))
    return pd.Series(values).where(np.isfinite(values), None)


def t_critical(n: Column, confidence: float = 0.95) -> Column:
    """Two-sided t critical value for samples below 30, 1.96 from there on."""
    if confidence not in T_TABLES:
        raise ValueError(f"confidence must be one of {sorted(T_TABLES)}")
    table = F.array(*[F.lit(v) for v in T_TABLES[confidence]])
    return F.when((n >= 2) & (n < 30), F.try_element_at(table, (n - 1).cast("int"))).when(n >= 30, F.lit(1.96))

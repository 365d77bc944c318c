"""Functions of a whole series or sample in Python: smoother, full autocorrelation, scoring.

A series is one cell's calendar, so its length is bounded by the calendar and not by the data volume.
Series travel as arrays, many per Arrow batch, and numpy works on all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

from drygrid.operators.common import CELL, Keys


def apply_series(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Apply ``fn`` to each series as a frame sorted by time."""

    def sorted_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(time, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(sorted_fn, schema)


def as_arrays(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", carry: Sequence[str] = ()) -> DataFrame:
    """One row per series: sorted ``times`` and ``values`` (NULL kept) and an array of each column in ``carry``."""
    row = F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(c) for c in carry])
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return packed.select(*keys, F.col("_r.t").alias("times"), F.col("_r.v").alias("values"), *[F.col("_r")[c].alias(c) for c in carry])


def from_arrays(df: DataFrame, keys: Keys = CELL, time: str = "time", values: Sequence[str] = ("value",)) -> DataFrame:
    zipped = F.arrays_zip("times", *values)
    return df.select(*keys, F.inline(zipped)).withColumnRenamed("times", time)


# --- Whittaker smoother --------------------------------------------------------------------------------


def solve_smoother(y: np.ndarray, w: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Minimise sum w (y - z)^2 + lam sum (second differences of z)^2 along the last axis.

    The system is symmetric with two off-diagonals; it is factorised once along time for all rows of the
    batch together. ``lam`` broadcasts over the leading axes.
    """
    n = y.shape[-1]
    lead = np.broadcast_shapes(y.shape[:-1], np.shape(lam))
    y, w = np.broadcast_to(y, (*lead, n)), np.broadcast_to(w, (*lead, n))
    lam = np.broadcast_to(lam, lead)
    if n < 3:
        return np.where(w > 0, y, 0.0)
    main, one, two = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, c in ((0, 1.0), (1, -2.0), (2, 1.0)):
        main[k:n - 2 + k] += c * c
    one[: n - 2] += -2.0
    one[1 : n - 1] += -2.0
    two[: n - 2] = 1.0
    d, e, f, z = (np.zeros((n, *lead)) for _ in range(4))
    for i in range(n):
        pivot = w[..., i] + lam * main[i]
        sub = lam * one[i]
        rhs = w[..., i] * y[..., i]
        if i >= 1:
            pivot = pivot - e[i - 1] ** 2 * d[i - 1]
            sub = sub - e[i - 1] * f[i - 1] * d[i - 1]
            rhs = rhs - e[i - 1] * z[i - 1]
        if i >= 2:
            pivot = pivot - f[i - 2] ** 2 * d[i - 2]
            rhs = rhs - f[i - 2] * z[i - 2]
        d[i] = pivot
        safe = np.where(pivot == 0, 1.0, pivot)
        e[i] = sub / safe if i < n - 1 else 0.0
        f[i] = lam * two[i] / safe if i < n - 2 else 0.0
        z[i] = rhs
    z /= np.where(d == 0, 1.0, d)
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1] + (f[i] * z[i + 2] if i + 2 < n else 0.0)
    return np.moveaxis(z, 0, -1)


def asymmetric_smoother(y: np.ndarray, w: np.ndarray, lam: np.ndarray, p: float, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Repeat the solve with weight p above and 1 - p below the curve until it stops moving, at most ``rounds`` times.

    Returns the curves and whether each has settled.
    """
    z = np.zeros(np.broadcast_shapes(y.shape[:-1], np.shape(lam)) + (y.shape[-1],))
    moved = np.ones(z.shape[:-1])
    for _ in range(rounds):
        side = np.where(y > z, p, 1 - p)
        new = solve_smoother(y, w * side, lam)
        moved = np.abs(new - z).sum(axis=-1)
        z = new
        if not moved.any():
            break
    return z, moved == 0


def v_curve_smoother(y: np.ndarray, w: np.ndarray, exponents: np.ndarray, p: float | None, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed rows, the chosen lambda of each, at the lowest point of the V-curve, and whether the row has settled.

    The V-curve measures the step between neighbouring lambdas in the (log fit, log roughness) plane.
    """
    lam = 10.0 ** exponents
    cube_y, cube_w = y[:, None, :], w[:, None, :]
    grid = np.broadcast_to(lam, (y.shape[0], lam.size))
    if p is None:
        z = solve_smoother(cube_y, cube_w, grid)
    else:
        z, _ = asymmetric_smoother(cube_y, cube_w, grid, p, rounds)
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.log((cube_w * (cube_y - z) ** 2).sum(axis=-1))
        rough = np.log((np.diff(z, 2, axis=-1) ** 2).sum(axis=-1))
        step = np.hypot(np.diff(fit, axis=1), np.diff(rough, axis=1))
    step = np.where(np.isfinite(step), step, np.inf) / (np.log(10) * (exponents[1] - exponents[0]))
    best = step.argmin(axis=1)
    chosen = 10.0 ** ((exponents[best] + exponents[best + 1]) / 2)
    final, settled = (solve_smoother(y, w, chosen), np.ones(len(y), bool)) if p is None else asymmetric_smoother(y, w, chosen, p, rounds)
    return final, chosen, settled


SMOOTHED = StructType().add("smoothed", ArrayType(DoubleType())).add("lam", DoubleType()).add("settled", BooleanType())


def whittaker(
    df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", out: str = "smoothed",
    lam: float | None = None, p: float | None = 0.99, lambda_min: float = -2.0, lambda_max: float = 3.0, step: float = 0.2, rounds: int = 10, carry: Sequence[str] = (),
) -> DataFrame:
    """Penalised smoother of every series: (keys, time, value, out, lam, settled) and the columns in ``carry``.

    NULL has weight 0 and gets a fitted value. With ``lam`` the penalty is fixed and symmetric; otherwise
    it is chosen per series on exponents lambda_min, +step … below lambda_max, with asymmetric weight
    ``p`` (None for symmetric). Asymmetric weights are refined at most ``rounds`` times; ``settled`` tells
    whether the last round changed nothing. Rows must already form a daily calendar. Series without any
    value stay NULL. Only the values travel to Python.
    """
    packed = as_arrays(df, keys, time, value, carry)
    exponents = np.round(np.arange(lambda_min, lambda_max, step), 2)

    @F.pandas_udf(SMOOTHED)
    def smooth(values: pd.Series) -> pd.DataFrame:
        lengths = values.map(len).to_numpy()
        result: list = [None] * len(values)
        used, fixed = np.full(len(values), np.nan), np.ones(len(values), dtype=bool)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            # Bounds the work array to about 25 million numbers however long the series are.
            width = max(1, 1_000_000 // max(1, int(n)))
            for s in range(0, len(rows), width):
                part = rows[s:s + width]
                y = np.stack([np.asarray(values.iloc[r], float) for r in part])
                w = (~np.isnan(y)).astype(float)
                y = np.where(w > 0, y, 0.0)
                if lam is not None:
                    z, chosen, settled = solve_smoother(y, w, np.full(len(part), float(lam))), np.full(len(part), float(lam)), np.ones(len(part), bool)
                else:
                    z, chosen, settled = v_curve_smoother(y, w, exponents, p, rounds)
                known = w.any(axis=1)
                for k, r in enumerate(part):
                    result[r] = z[k] if known[k] else np.full(int(n), np.nan)
                used[part] = np.where(known, chosen, np.nan)
                fixed[part] = settled | ~known
        return pd.DataFrame({"smoothed": result, "lam": used, "settled": fixed})

    done = packed.withColumn("_s", smooth("values"))
    rows = done.select(*keys, F.col("_s.lam").alias("lam"), F.col("_s.settled").alias("settled"), F.inline(F.arrays_zip("times", "values", *carry, F.col("_s.smoothed").alias("smoothed"))))
    null = F.lit(None).cast("double")
    return rows.select(*keys, F.col("times").alias(time), F.nanvl("values", null).alias(value), F.nanvl("smoothed", null).alias(out), F.nanvl("lam", null).alias("lam"), "settled", *carry)


# --- autocorrelation over all lags ---------------------------------------------------------------------


def lag_correlations(v: np.ndarray, nlags: int) -> np.ndarray:
    """Pearson r of v[:n-k] and v[k:] for k = 1..nlags; a NaN in the stretch makes it NaN."""
    n = len(v)
    out = np.full(nlags, np.nan)
    bad = np.isnan(v)
    x = np.where(bad, 0.0, v)
    x = x - (x[~bad].mean() if (~bad).any() else 0.0)
    head, tail = np.cumsum(x), np.cumsum(x[::-1])
    head2, tail2 = np.cumsum(x * x), np.cumsum((x * x)[::-1])
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(x, size)
    cross = np.fft.irfft(spectrum * np.conj(spectrum), size)[:n]
    first_bad = np.argmax(bad) if bad.any() else n
    last_bad = n - 1 - np.argmax(bad[::-1]) if bad.any() else -1
    k = np.arange(1, min(nlags, n - 2) + 1)
    m = n - k
    sx, sy, sx2, sy2 = head[m - 1], tail[m - 1], head2[m - 1], tail2[m - 1]
    vx, vy = sx2 - sx * sx / m, sy2 - sy * sy / m
    good = (first_bad >= m) & (last_bad < k) & (vx > 1e-12 * np.maximum(1.0, sx2)) & (vy > 1e-12 * np.maximum(1.0, sy2))
    at = k[good] - 1
    out[at] = (cross[k[good]] - (sx * sy / m)[good]) / np.sqrt((vx * vy)[good])
    return out


def full_autocorrelation(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", nlags: int | None = None) -> DataFrame:
    """(keys, lead, r) for lags 1..nlags, by default every lag up to the series length minus 2.

    Lag products come from one FFT per series, so no row pairs are formed. Only the values travel to Python.
    """
    packed = as_arrays(df, keys, time, value)

    @F.pandas_udf(ArrayType(DoubleType()))
    def correlations(values: pd.Series) -> pd.Series:
        return values.map(lambda v: lag_correlations(np.asarray(v, float), max(len(v) - 2, 0) if nlags is None else nlags))

    rows = packed.select(*keys, F.posexplode(correlations("values")).alias("_k", "r"))
    return rows.select(*keys, (F.col("_k") + 1).alias("lead"), F.nanvl(F.col("r"), F.lit(None).cast("double")).alias("r"))


# --- model scoring -------------------------------------------------------------------------------------


def score_samples(
    samples: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, members: int | None = None
) -> DataFrame:
    """Score samples with a user model, one Arrow batch at a time.

    ``fn`` maps a frame of samples to a frame of predictions. ``members`` repeats each sample once per
    ensemble member with its number in ``member``.
    """
    work = samples
    if members is not None:
        work = work.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return work.mapInPandas(run, schema)


def member_mean(scored: DataFrame, by: Sequence[str], pred: str = "y_pred") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(pred).alias(pred))

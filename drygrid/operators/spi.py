"""Standardised precipitation index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from drygrid.functions.special import gamma_score, likely_shape
from drygrid.operators.common import CELL, Keys
from drygrid.operators.temporal import rolling

# Fixed value: the index is clipped where the CDF reaches 0 or 1 in double precision.
SPI_LIMIT = 8.21


def gamma_parameters(
    df: DataFrame, window: int = 90, keys: Keys = CELL, time: str = "time", value: str = "value", method: str = "ML"
) -> DataFrame:
    """Rolling mean ``pr`` with the gamma fit of its day of year: ``prob_zero``, ``shape``, ``scale``.

    The fit needs only mean(x) and mean(ln x) of the positive values, so it is a window aggregate over
    (series, day of year) that reuses the partitioning of the rolling mean. ``ML`` takes four generalised
    Newton steps from the closed form to the maximum likelihood shape, ``APP`` is the closed form alone.
    """
    if method not in ("APP", "ML"):
        raise ValueError("method must be 'APP' or 'ML'")
    w = Window.partitionBy(*keys, "_doy")
    work = df.withColumn("pr", rolling(value, window, "mean", keys, time)).withColumn("_doy", F.dayofyear(time))
    positive = F.when(F.col("pr") > 0, F.col("pr"))
    work = work.withColumns({
        "prob_zero": F.avg((F.col("pr") == 0).cast("double")).over(w),
        "_mean": F.avg(positive).over(w),
        "_log": F.avg(F.ln(positive)).over(w),
    }).withColumn("_a", F.ln("_mean") - F.col("_log"))
    # No spread gives A = 0: no shape. Rounding can leave a tiny positive or negative A there.
    a = F.when(F.col("_a") > 1e-12, F.col("_a"))
    if method == "APP":
        work = work.withColumn("shape", (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a))
    else:
        work = work.withColumn("shape", likely_shape(a))
    return work.withColumn("scale", F.col("_mean") / F.col("shape")).drop("_doy", "_mean", "_log", "_a")


def spi(
    df: DataFrame, window: int = 90, keys: Keys = CELL, time: str = "time", value: str = "value", method: str = "ML"
) -> DataFrame:
    """Add ``spi``: the normal quantile of p0 + (1 - p0) G(x), NULL until the window is full."""
    fitted = gamma_parameters(df, window, keys, time, value, method)
    index = gamma_score("pr", "shape", "scale", "prob_zero", F.lit(SPI_LIMIT))
    return fitted.withColumn("spi", index).select(*df.columns, "pr", "spi")

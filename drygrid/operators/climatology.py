"""Anomalies, condition indices and day-of-year statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.functions import calendar as cal
from drygrid.operators.common import CELL, Keys
from drygrid.operators.quantiles import exact_quantiles, quantile_columns


def _group(df: DataFrame, keys: Keys, key: Column):
    return df.withColumn("_k", key), Window.partitionBy(*keys, "_k")


def monthly_anomaly(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", against: str = "mean") -> DataFrame:
    """Value minus the mean (or maximum) of its calendar month over all years."""
    if against not in ("mean", "max"):
        raise ValueError("against must be 'mean' or 'max'")
    work, w = _group(df, keys, F.month(time))
    reference = (F.avg if against == "mean" else F.max)(value).over(w)
    return work.withColumn("anomaly", F.col(value) - reference).drop("_k")


def within_month_anomaly(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    """Daily value minus the mean of its own month."""
    work, w = _group(df, keys, cal.month_start(F.col(time)))
    return work.withColumn("anomaly", F.col(value) - F.avg(value).over(w)).drop("_k")


def relative_monthly_anomaly(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", against: str = "mean") -> DataFrame:
    """Monthly mean against the mean (or maximum) of that calendar month's means, as a share of it."""
    months = df.groupBy(*keys, cal.month_start(F.col(time)).alias(time)).agg(F.avg(value).alias(value))
    work, w = _group(months, keys, F.month(time))
    reference = (F.avg if against == "mean" else F.max)(value).over(w)
    return work.withColumn("anomaly", F.try_divide(F.col(value) - reference, reference)).drop("_k")


def standardised(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", by: str = "dayofyear", out: str = "svi") -> DataFrame:
    """z-score against the same day of year (or calendar month), population standard deviation."""
    key = {"dayofyear": F.dayofyear, "month": F.month}[by](time)
    work, w = _group(df, keys, key)
    score = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return work.withColumn(out, score).drop("_k")


def condition_index(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", out: str = "vci") -> DataFrame:
    """100 (x - min) / (max - min) over the same day of year; no range gives NULL."""
    work, w = _group(df, keys, F.dayofyear(time))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return work.withColumn(out, F.lit(100.0) * F.try_divide(F.col(value) - low, high - low)).drop("_k")


def domain_series(df: DataFrame, by: Sequence[str] = ("time",), value: str = "value", bounded: bool = False) -> DataFrame:
    """Mean and median over the other axes (space for ``by`` = time, time for ``by`` = cell). ``bounded``: see ``exact_quantiles``."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    median = quantile_columns(df, value, {"median": 0.5}, by, bounded)
    return mean.join(median, list(by), "left")


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def day_of_year_distribution(
    df: DataFrame,
    time: str = "time",
    value: str = "value",
    by: Sequence[str] = (),
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    key: str = "doy",
    bounded: bool = False,
) -> DataFrame:
    """Count, mean and quartiles of all cells and years per day of year (``key='month_day'``: MM-dd). ``bounded``: see ``exact_quantiles``."""
    work = df.where(F.col(value).isNotNull())
    if years is not None:
        work = work.where(F.year(time).isin(*years))
    if months is not None:
        work = work.where(F.month(time).isin(*months))
    label = F.dayofyear(time) if key == "doy" else cal.month_day(F.col(time))
    work = work.select(*by, label.alias(key), F.col(value).alias("_value"))
    groups = [*by, key]
    moments = work.groupBy(*groups).agg(F.count("_value").alias("n"), F.avg("_value").alias("mean"))
    return moments.join(quantile_columns(work, "_value", QUARTILES, groups, bounded), groups)


def year_against_all(df: DataFrame, year: int, time: str = "time", value: str = "value", drop_last_day: bool = False, bounded: bool = False) -> DataFrame:
    """Median and mean of one year beside those of every year, per month-day.

    The month-day key lines leap and common years up; days the year lacks are left out.
    """
    work = df.where(F.col(value).isNotNull()).select(
        cal.month_day(F.col(time)).alias("month_day"), (F.year(time) == year).alias("_own"), F.col(value).alias("_value")
    )
    own = F.when(F.col("_own"), F.col("_value"))
    means = work.groupBy("month_day").agg(F.avg(own).alias("year_mean"), F.avg("_value").alias("all_mean"), F.count(own).alias("_n"))
    medians = quantile_columns(work, "_value", {"all_median": 0.5}, ["month_day"], bounded)
    mine = quantile_columns(work.where("_own"), "_value", {"year_median": 0.5}, ["month_day"], bounded)
    out = means.where("_n > 0").drop("_n").join(mine, "month_day").join(medians, "month_day")
    return out.where(F.col("month_day") != "12-31") if drop_last_day else out


def flag_share(df: DataFrame, flag: str, by: Sequence[str] = ("product", "latency"), time: str = "time") -> DataFrame:
    """Mean of a 0/1 flag per day of year."""
    return df.groupBy(*by, F.dayofyear(time).alias("doy")).agg(F.avg(flag).alias("share"))


def forecast_spread(df: DataFrame, by: Sequence[str], value: str = "value", keep: str | None = None, bounded: bool = False) -> DataFrame:
    """Median and interquartile range per group over the cells where ``keep`` is 1."""
    work = df if keep is None else df.where(F.col(keep) == 1)
    return quantile_columns(work, value, QUARTILES, list(by), bounded)


__all__ = [
    "condition_index", "day_of_year_distribution", "domain_series", "exact_quantiles", "flag_share", "forecast_spread",
    "monthly_anomaly", "relative_monthly_anomaly", "standardised", "within_month_anomaly", "year_against_all",
]

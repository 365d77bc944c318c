"""Drought events, wet/dry transitions and seasonal dry/wet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drygrid.functions import calendar as cal
from drygrid.functions.values import dry_flag, wet_flag
from drygrid.operators.common import CELL, Keys, by_series
from drygrid.operators.temporal import drop_warm_up, rolling, running_sum


def transitions(
    df: DataFrame, steps: int, keys: Keys = CELL, time: str = "time", value: str = "spi",
    dry_limit: float = -2.0, wet_limit: float = 2.0, raw_flags: bool = False,
) -> DataFrame:
    """Wet and dry flags, their counts over the last ``steps`` rows, and dry-after-wet / wet-after-dry.

    ``raw_flags`` keeps the index value where a flag is 0 (the counts then add those values).
    """
    spi = F.col(value)
    wet, dry = wet_flag(spi, wet_limit), dry_flag(spi, dry_limit)
    if raw_flags:
        wet = F.when(wet == 1, F.lit(1.0)).otherwise(spi)
        dry = F.when(dry == 1, F.lit(1.0)).otherwise(spi)
    work = df.withColumn("wet", wet).withColumn("dry", dry)
    work = work.withColumns({"dry_cond": rolling("dry", steps, "sum", keys, time), "wet_cond": rolling("wet", steps, "sum", keys, time)})
    return work.withColumn("dw", F.when((F.col("wet_cond") >= 1) & (F.col("dry") == 1), 1).otherwise(0)).withColumn(
        "wd", F.when((F.col("dry_cond") >= 1) & (F.col("wet") == 1), 1).otherwise(0)
    )


def drought_runs(
    df: DataFrame,
    keys: Keys = CELL,
    time: str = "time",
    value: str = "spi",
    threshold: float = -1.0,
    warm_up: int | None = None,
    strict: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """One row per run of values below ``threshold``: onset, severity, duration, intensity.

    A row at or above the threshold opens a new run index; NULL rows neither break nor lengthen a run.
    ``strict`` reports the row that opened the index (the last day before onset) as the event time.
    The final aggregate groups by (series, index) and keeps the window's partitioning: one shuffle. An index that came from Python is no longer
    partitioned by series; ``tasks`` (see ``series_tasks``) then sizes the tasks of that shuffle.
    """
    df = by_series(df, keys, tasks)
    work = df if warm_up is None else drop_warm_up(df, warm_up, keys, time)
    calm = F.when(F.col(value) >= threshold, 1).otherwise(0)
    work = work.withColumn("_calm", calm)
    work = work.withColumn("_run", running_sum(F.col("_calm"), keys, time))
    inside = (F.col("_calm") == 0) & F.col(value).isNotNull()
    onset = F.min(F.col(time)) if strict else F.min(F.when(inside, F.col(time)))
    runs = work.groupBy(*keys, "_run").agg(
        onset.alias(time),
        F.abs(F.sum(F.when(inside, F.col(value)))).alias("severity"),
        F.count(F.when(inside, 1)).alias("duration"),
    )
    return (
        runs.where("duration > 0")
        .withColumn("intensity", F.col("severity") / F.col("duration"))
        .withColumn("year", F.year(time))
        .withColumn("month", F.month(time))
        .drop("_run")
    )


def dry_wet_by_season(
    df: DataFrame,
    region: str = "region",
    keys: Keys = CELL,
    time: str = "time",
    year_start: int | None = None,
    year_end: int | None = None,
    values: tuple[str, ...] = ("dw", "wd"),
    aggr: str | None = "season",
) -> DataFrame:
    """Mean per year, region and season: first over time in each cell, then over cells.

    December counts with the January and February of its own calendar year; ``year_end`` is exclusive.
    ``aggr=None`` returns the rows themselves.
    """
    if aggr not in ("season", None):
        raise ValueError("aggr must be 'season' or None")
    work = df
    if year_start is not None:
        work = work.where(F.year(time) >= year_start)
    if year_end is not None:
        work = work.where(F.year(time) < year_end)
    if aggr is None:
        return work
    work = work.withColumn("year", F.year(time)).withColumn("season", cal.season(F.col(time)))
    cells = work.groupBy(*keys, region, "year", "season").agg(*[F.avg(v).alias(v) for v in values])
    return cells.groupBy(region, "year", "season").agg(*[F.avg(v).alias(v) for v in values])


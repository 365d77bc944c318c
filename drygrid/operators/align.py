"""Alignment of cubes by key: intersection, merge, calendar and mask joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from drygrid.operators.common import CELL, Keys, first_per_key


def align(*cubes: DataFrame, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Inner intersection of two to four cubes on (cell, day), one row per key in each.

    Value columns must differ between cubes. The de-duplicating aggregates already hash on the join
    keys, so the joins add no shuffle.
    """
    if not 2 <= len(cubes) <= 4:
        raise ValueError("align takes two to four cubes")
    on = [*keys, time]

    def one_per_day(cube: DataFrame) -> DataFrame:
        rest = [c for c in cube.columns if c not in on]
        days = cube.select(*keys, F.to_date(time).alias(time), *rest, F.col(time).alias("_raw"))
        return first_per_key(days, on, "_raw").drop("_raw")

    return reduce(lambda a, b: a.join(b, on), [one_per_day(c) for c in cubes])


def merge_variables(*cubes: DataFrame, keys: Keys = CELL, time: str | None = "time") -> DataFrame:
    """Outer merge of cubes with different variables; a key present on one side only gets NULLs."""
    on = [*keys, time] if time else list(keys)
    return reduce(lambda a, b: a.join(b, on, "full_outer"), cubes)


def common_period(a: DataFrame, b: DataFrame, time: str = "time", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common date range.

    The range is a scalar subquery, so no job runs while the plan is built. ``strict`` checks at once that
    no day of the range is missing on either side and fails otherwise. Without it, tables that do not
    overlap come back unchanged.
    """
    def ends(df: DataFrame) -> Column:
        return df.agg(F.struct(F.to_date(F.min(time)).alias("first"), F.to_date(F.max(time)).alias("last")).alias("_v")).scalar()

    one, other = ends(a), ends(b)
    start, end = F.greatest(one["first"], other["first"]), F.least(one["last"], other["last"])
    if strict:
        days = [df.where(F.to_date(time).between(start, end)).agg(F.count_distinct(F.to_date(time)).alias("_v")).scalar() for df in (a, b)]
        row = a.sparkSession.range(1).select((F.date_diff(end, start) + 1).alias("expected"), days[0].alias("a"), days[1].alias("b")).first()
        if row.expected is None or row.expected < 1:
            raise ValueError("the two tables share no dates")
        if missing := row.expected - min(row.a, row.b):
            raise ValueError(f"{missing} days of the common range are missing")
    apart = F.coalesce(one["first"].isNull() | other["first"].isNull() | (start > end), F.lit(True))
    return tuple(df.where(apart | F.to_date(time).between(start, end)) for df in (a, b))


def repeat_over_time(df: DataFrame, layer: DataFrame, keys: Keys = CELL) -> DataFrame:
    """A layer without time joined to every date of its cell."""
    return df.join(layer, list(keys), "left")


def members_only(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def calendar_days(df: DataFrame, time: str = "time") -> DataFrame:
    """Every day from the first to the last date of the table."""
    ends = df.agg(F.to_date(F.min(time)).alias("a"), F.to_date(F.max(time)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias(time))


def absent_days(df: DataFrame, time: str = "time", start=None, end=None) -> DataFrame:
    """Days of the calendar on which the table has no row at all."""
    spark = df.sparkSession
    if start is not None and end is not None:
        bounds = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
        days = bounds.select(F.explode(F.sequence("a", "b")).alias(time))
    else:
        days = calendar_days(df, time)
    return days.join(df.select(F.to_date(time).alias(time)).distinct(), time, "left_anti")


def on_calendar(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """Calendar of the whole range united with the table's own dates, NULL on days it lacks."""
    return calendar_days(df, time).join(df.select(F.to_date(time).alias(time), value), time, "full_outer")


def copy_missing(df: DataFrame, reference: DataFrame, value: str = "value", reference_value: str | None = None, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """NULL wherever the reference is NULL or has no row."""
    on = [*keys, time]
    ref = reference.select(*on, F.col(reference_value or value).alias("_r"))
    joined = df.join(ref, on, "left")
    return joined.withColumn(value, F.when(F.col("_r").isNotNull(), F.col(value))).select(*df.columns)


def append_array(features: DataFrame, extra: DataFrame, on: Sequence[str], into: str, added: str) -> DataFrame:
    """Feature arrays extended by another table's arrays for the same sample."""
    joined = features.join(extra.select(*on, F.col(added).alias("_x")), list(on))
    return joined.withColumn(into, F.concat(into, "_x")).select(*features.columns)


def rename_axes(df: DataFrame) -> DataFrame:
    """longitude/x/X to ``lon`` and latitude/y/Y to ``lat``; projection columns dropped."""
    # Axis names in input files.
    names = {"longitude": "lon", "x": "lon", "X": "lon", "latitude": "lat", "y": "lat", "Y": "lat"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns}).drop("crs", "spatial_ref")


def axis_name(df: DataFrame, axis: str) -> str | None:
    """First column that can be the latitude or longitude axis."""
    # Axis names in input files.
    options = {"lon": ("lon", "longitude", "x", "X"), "lat": ("lat", "latitude", "y", "Y")}[axis]
    return next((c for c in options if c in df.columns), None)


def swap_axes(df: DataFrame) -> DataFrame:
    swapped = {"lat": "lon", "lon": "lat"}
    return df.select(*[F.col(c).alias(swapped.get(c, c)) for c in df.columns])


def reanalysis_names(df: DataFrame, time: str = "time") -> DataFrame:
    """Land reanalysis: dates one day later and plain variable names."""
    # Variable names of the reanalysis files.
    names = {"pev": "potential_evaporation", "e": "evaporation", "t2m": "2m_temperature", "tp": "total_precipitation"}
    return df.withColumn(time, F.date_add(time, 1)).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def masked(value: Column, mask: Column) -> Column:
    """Value where the mask is 1."""
    return F.when(mask == 1, value)


def mask_by_table(df: DataFrame, mask: DataFrame, flag: str = "mask", value: str = "value", keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Keep values on days the mask is 1, both sides cut to the day."""
    marks = mask.select(*keys, F.to_date(time).alias(time), F.col(flag).alias("_m")).groupBy(*keys, time).agg(F.max("_m").alias("_m"))
    joined = df.withColumn(time, F.to_date(time)).join(marks, [*keys, time], "left")
    return joined.withColumn(value, masked(F.col(value), F.col("_m"))).select(*df.columns)

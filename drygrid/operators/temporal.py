"""Operators along the time axis: calendar filling, resampling, rolling, interpolation, smoothing.

All windows share the partitioning by series keys, so a chain of them needs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.functions import calendar as cal
from drygrid.functions.values import floor_at_zero, kelvin_to_celsius, metres_to_millimetres
from drygrid.operators.common import CELL, Keys, back_from_end, by_series, one_value, series, sum_or_zero, up_to_now


def _day(value) -> Column | None:
    if value is None or isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def _stretch(df: DataFrame, keys: Keys, time: str, start, end) -> DataFrame:
    """Add ``_slot``: every calendar day a row stands for, its own day and the gap after it."""
    w = series(keys, time)
    here = F.col(time)
    first = F.lag(time).over(w).isNull()
    after = F.lead(time).over(w)
    start, end = _day(start), _day(end)
    low = here if start is None else F.when(first, F.least(here, start)).otherwise(here)
    tail = here if end is None else F.greatest(here, end)
    high = F.greatest(here, F.coalesce(F.date_sub(after, 1), tail))
    return df.withColumn("_low", low).withColumn("_high", high).withColumn("_slot", F.explode(F.sequence("_low", "_high")))


def fill_calendar(
    df: DataFrame,
    keys: Keys = CELL,
    time: str = "time",
    values: Sequence[str] = ("value",),
    start=None,
    end=None,
    fill: float | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Daily calendar without holes per series; ``values`` are NULL (or ``fill``) on added days.

    Each row expands over the gap that follows it, so no calendar table and no join are needed, and the
    result keeps the partitioning by series. Other columns repeat. The planner sizes tasks by the rows before they expand; ``tasks``
    (see ``series_tasks``) sizes them by the calendar.
    """
    real = F.col("_slot") == F.col(time)
    blank = F.lit(fill)
    cols = []
    for c in df.columns:
        if c == time:
            cols.append(F.col("_slot").alias(c))
        elif c in values:
            cols.append(F.when(real, F.col(c)).otherwise(blank.cast(df.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(c))
    return _stretch(by_series(df, keys, tasks), keys, time, start, end).select(*cols)


def common_calendar(df: DataFrame, keys: Keys = CELL, time: str = "time", values: Sequence[str] = ("value",), start=None, end=None, fill: float | None = None, tasks: int | None = None) -> DataFrame:
    """:func:`fill_calendar` on one axis for all series: the given period, else the table's first to last day."""
    first = one_value(df, F.min(time)) if start is None else start
    last = one_value(df, F.max(time)) if end is None else end
    return fill_calendar(df, keys, time, values, first, last, fill, tasks)


def missing_days(df: DataFrame, keys: Keys = CELL, time: str = "time", start=None, end=None) -> DataFrame:
    """Calendar days a series lacks."""
    slots = _stretch(df.select(*keys, time), keys, time, start, end)
    return slots.where(F.col("_slot") != F.col(time)).select(*keys, F.col("_slot").alias(time))


def rolling(value: str, n: int, how: str = "sum", keys: Keys = CELL, time: str = "time") -> Column:
    """Sum or mean of the last n rows; NULL until n rows exist or when any of them is NULL."""
    frame = series(keys, time).rowsBetween(-(n - 1), 0)
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    total = (F.sum if how == "sum" else F.avg)(value).over(frame)
    return F.when(F.count(value).over(frame) == n, total)


def running_sum(value: Column, keys: Keys = CELL, time: str = "time") -> Column:
    return F.sum(value).over(up_to_now(keys, time))


def forward_fill(value: str, keys: Keys = CELL, time: str = "time") -> Column:
    return F.last(value, ignorenulls=True).over(up_to_now(keys, time))


def accumulate_shift(value: str, keys: Keys = CELL, time: str = "time") -> Column:
    """Hour h takes the value of hour h - 1."""
    return F.lag(value, 1).over(series(keys, time))


def interpolate(
    df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value", method: str = "linear", out: str | None = None
) -> DataFrame:
    """Fill NULLs between known values; ends are not extrapolated. Nearest ties take the earlier value."""
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear' or 'nearest'")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))
    work = df.withColumn("_k", known)
    work = work.withColumn("_p", F.last("_k", ignorenulls=True).over(up_to_now(keys, time)))
    work = work.withColumn("_n", F.last("_k", ignorenulls=True).over(back_from_end(keys, time)))

    def seconds(t: Column) -> Column:
        return F.unix_timestamp(t.cast("timestamp"))

    gone = seconds(F.col(time)) - seconds(F.col("_p")["t"])
    span = seconds(F.col("_n")["t"]) - seconds(F.col("_p")["t"])
    prev, nxt = F.col("_p")["v"], F.col("_n")["v"]
    if method == "linear":
        guess = prev + (nxt - prev) * F.try_divide(gone, span)
    else:
        guess = F.when(prev.isNotNull() & nxt.isNotNull(), F.when(gone * 2 <= span, prev).otherwise(nxt))
    return work.withColumn(out or value, F.coalesce(F.col(value).cast("double"), guess)).drop("_k", "_p", "_n")


def gap_streaks(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    """Add ``streaks`` and ``quality_flag``.

    ``quality_flag`` is the gap length on every day of a gap, else 0. ``streaks`` is the gap length on the
    first valid day after it (on the last day for a gap that ends the series), NULL inside gaps, else 0.
    """
    null = F.col(value).isNull()
    w = series(keys, time)
    work = df.withColumn("_g", F.count(value).over(up_to_now(keys, time)))
    work = work.withColumn("_len", F.count(F.when(null, 1)).over(Window.partitionBy(*keys, "_g")))
    ended = F.lag(F.when(null, F.col("_len"))).over(w)
    last = F.lead(time).over(w).isNull()
    return (
        work.withColumn("streaks", F.when(~null, F.coalesce(ended, F.lit(0))).when(last, F.col("_len")).cast("int"))
        .withColumn("quality_flag", F.when(null, F.col("_len")).otherwise(0).cast("int"))
        .drop("_g", "_len")
    )


def drop_long_gaps(value: Column, gap_length: Column, limit: int = 45) -> Column:
    """NULL where the gap is longer than ``limit`` days."""
    return F.when(gap_length <= limit, value)


def nth_difference(df: DataFrame, n: int = 1, keys: Keys = CELL, time: str = "time", value: str = "value", relative: bool = False) -> DataFrame:
    """Absolute n-th order difference, the first n rows dropped; ``relative`` divides by the value."""
    w = series(keys, time)
    work = df.withColumn("_d", F.col(value)).withColumn("_i", F.row_number().over(w))
    for _ in range(n):
        work = work.withColumn("_d", F.col("_d") - F.lag("_d").over(w))
    change = F.try_divide(F.col("_d"), F.col(value)) if relative else F.col("_d")
    return work.where(F.col("_i") > n).withColumn("difference", F.abs(change)).drop("_d", "_i")


def lag_difference(value: str, n: int = 1, keys: Keys = CELL, time: str = "time") -> Column:
    return F.col(value) - F.lag(value, n).over(series(keys, time))


def drop_warm_up(df: DataFrame, steps: int, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Drop the first steps + 1 rows of each series."""
    work = df.withColumn("_i", F.row_number().over(series(keys, time)))
    return work.where(F.col("_i") > steps + 1).drop("_i")


def keep_tail(df: DataFrame, n: int, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Last n rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def savitzky_golay(
    df: DataFrame, window: int, order: int, keys: Keys = CELL, time: str = "time", value: str = "value", out: str = "filled"
) -> DataFrame:
    """Local polynomial filter along time; the edge rows use the polynomial of the first / last window.

    The weights depend only on (window, order), so the filter is a fixed linear combination of
    neighbouring rows. NULL in the window gives NULL.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and larger than order")
    half = window // 2
    basis = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    weights = basis @ np.linalg.pinv(basis)
    w = series(keys, time)
    moved = {f"_o{k + window}": F.lag(value, -k).over(w) if k else F.col(value) for k in range(-(window - 1), window)}
    work = df.withColumns({"_i": F.row_number().over(w), **moved})
    work = work.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    def combine(position: int) -> Column:
        total = F.lit(0.0)
        for k in range(window):
            total = total + F.lit(float(weights[position, k])) * F.col(f"_o{k - position + window}")
        return total

    smooth = F.when(F.col("_n") < window, F.lit(None).cast("double"))
    for position in range(half):
        smooth = smooth.when(F.col("_i") == position + 1, combine(position))
        smooth = smooth.when(F.col("_n") - F.col("_i") == position, combine(window - 1 - position))
    return work.withColumn(out, smooth.otherwise(combine(half))).select(*df.columns, out)


# --- resampling ---------------------------------------------------------------------------------------


def n_day_mean(df: DataFrame, days: int = 5, keys: Keys = CELL, time: str = "time", value: str = "value", origin=None) -> DataFrame:
    """Mean per n-day bin anchored at the first date of the table (or ``origin``)."""
    anchor = _day(origin) if origin is not None else one_value(df, F.min(time))
    return df.groupBy(*keys, cal.n_day_bin(F.col(time), anchor, days).alias(time)).agg(F.avg(value).alias(value))


def weekly_mean(df: DataFrame, keys: Keys = CELL, time: str = "time", values: Sequence[str] = ("value",)) -> DataFrame:
    return df.groupBy(*keys, cal.week_end(F.col(time)).alias(time)).agg(*[F.avg(v).alias(v) for v in values])


def monthly_mean(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, cal.month_start(F.col(time)).alias(time)).agg(F.avg(value).alias(value))


def dekad_max(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, cal.dekad(F.col(time)).alias(time)).agg(F.max(value).alias(value))


def quarter_extremes(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    """Maximum and minimum of the quarter (from March) beside each day, with the distances to them."""
    w = Window.partitionBy(*keys, "_q")
    return (
        df.withColumn("_q", cal.march_quarter(F.col(time)))
        .withColumns({"wet_max": F.max(value).over(w), "dry_min": F.min(value).over(w)})
        .withColumn("diff_max", F.col("wet_max") - F.col(value))
        .withColumn("diff_min", F.col(value) - F.col("dry_min"))
        .drop("_q")
    )


def composite_max(*slots: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    """Maximum over all acquisition slots of a day: one table with a row for each slot, or a table for each."""
    both = slots[0].select(*keys, time, value)
    for slot in slots[1:]:
        both = both.unionByName(slot.select(*keys, time, value))
    return both.groupBy(*keys, F.to_date(time).alias(time)).agg(F.max(value).alias(value))


def daily_precipitation(hourly: DataFrame, value: str, keys: Keys = CELL, time: str = "time", out: str | None = None, shifted: bool = False) -> DataFrame:
    """Hourly accumulations to a daily total in millimetres, negatives to 0."""
    source = hourly if shifted else hourly.withColumn(value, accumulate_shift(value, keys, time))
    total = floor_at_zero(metres_to_millimetres(sum_or_zero(F.col(value))))
    return source.groupBy(*keys, F.to_date(time).alias(time)).agg(total.alias(out or value))


def daily_temperature(hourly: DataFrame, value: str, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Daily minimum and maximum in degrees Celsius."""
    celsius = kelvin_to_celsius(F.col(value))
    return hourly.groupBy(*keys, F.to_date(time).alias(time)).agg(F.min(celsius).alias("t_min"), F.max(celsius).alias("t_max"))


def hourly_to_daily(
    hourly: DataFrame,
    sums: Sequence[str] = (),
    extremes: Sequence[str] = (),
    keys: Keys = CELL,
    time: str = "time",
    shift: bool = True,
) -> DataFrame:
    """All daily variables in one aggregate: sums of ``sums``, min and max of ``extremes``."""
    source = hourly
    if shift:
        source = source.withColumns({v: accumulate_shift(v, keys, time) for v in [*sums, *extremes]})
    aggs = [sum_or_zero(F.col(v)).alias(v) for v in sums]
    for v in extremes:
        aggs += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return source.groupBy(*keys, F.to_date(time).alias(time)).agg(*aggs)


# --- relabelling --------------------------------------------------------------------------------------


def shift_days(df: DataFrame, days: int = 1, time: str = "time", add_last_day: bool = False) -> DataFrame:
    """Relabel dates by ``days``; optionally repeat the last day one day later."""
    moved = F.date_add(time, days)
    if not add_last_day:
        return df.withColumn(time, moved)
    last = one_value(df, F.max(time))
    both = F.when(F.col(time) == last, F.array(moved, F.date_add(time, days + 1))).otherwise(F.array(moved))
    return df.withColumn(time, F.explode(both))


def amount_to_rate(value: str, keys: Keys = CELL, time: str = "time") -> Column:
    """Amount over the seconds of its step; the last row uses the step before it."""
    w = series(keys, time)

    def sec(t: Column) -> Column:
        return F.unix_timestamp(t.cast("timestamp"))

    step = F.coalesce(sec(F.lead(time).over(w)) - sec(F.col(time)), sec(F.col(time)) - sec(F.lag(time).over(w)))
    return F.try_divide(F.col(value), step)


def temporal_resolution_hours(df: DataFrame, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Smallest step between consecutive rows, in hours."""
    w = series(keys, time)

    def sec(t: Column) -> Column:
        return F.unix_timestamp(t.cast("timestamp"))

    step = df.select((sec(F.lead(time).over(w)) - sec(F.col(time))).alias("s"))
    return step.agg((F.min("s") / F.lit(3600.0)).alias("hours"))


def every_nth_day(df: DataFrame, n: int, time: str = "time") -> DataFrame:
    """Frames 0, n, 2n … counted in days from the first date."""
    return df.where(F.pmod(F.datediff(F.col(time), one_value(df, F.min(time))), F.lit(n)) == 0)

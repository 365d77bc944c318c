"""Row subsetting: boxes, periods, masks, crops and deterministic random cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from drygrid.functions import calendar as cal
from drygrid.functions.cover import is_water, level_1
from drygrid.functions.grid import DOMAIN_LAT, DOMAIN_LON
from drygrid.functions.vegetation import ndvi
from drygrid.operators.common import CELL, Keys, first_per_key, one_value
from drygrid.operators.temporal import n_day_mean


def in_box(df: DataFrame, lon: tuple[float, float] = DOMAIN_LON, lat: tuple[float, float] = DOMAIN_LAT, invert: bool = False) -> DataFrame:
    """Cells inside the inclusive box; ``invert`` reads the two axes swapped."""
    x, y = ("lat", "lon") if invert else ("lon", "lat")
    return df.where(F.col(x).between(*lon) & F.col(y).between(*lat))


def between_times(df: DataFrame, start=None, end=None, time: str = "time") -> DataFrame:
    kind = df.schema[time].dataType
    out = df
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        out = out.where(F.col(time) <= F.lit(end).cast(kind))
    return out


def in_season(df: DataFrame, years: Sequence[int] | None = None, months: Sequence[int] | None = None, time: str = "time") -> DataFrame:
    out = df if years is None else df.where(F.year(time).isin(*years))
    return out if months is None else out.where(F.month(time).isin(*months))


def align_to_climatology(df: DataFrame, climate: DataFrame, time: str = "time", value: str = "climate") -> DataFrame:
    """Join a (month_day, value) climatology; Feb-29 has a partner only in leap years."""
    return df.withColumn("month_day", cal.month_day(F.col(time))).join(climate.select("month_day", value), "month_day")


def nearest_cell(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """Rows of the cell nearest in latitude and, independently, in longitude (ties: the smaller)."""
    best = df.agg(
        F.min_by("lat", F.struct(F.abs(F.col("lat") - lat), F.col("lat"))).alias("lat"),
        F.min_by("lon", F.struct(F.abs(F.col("lon") - lon), F.col("lon"))).alias("lon"),
    )
    return df.join(best, ["lat", "lon"], "left_semi")


def corner_crop(df: DataFrame, pixels: int = 64, side: str = "left") -> DataFrame:
    """The ``pixels`` highest latitudes by the lowest (left) or highest (right) longitudes."""
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    lats = df.select("lat").distinct().orderBy(F.col("lat").desc()).limit(pixels)
    order = F.col("lon").asc() if side == "left" else F.col("lon").desc()
    lons = df.select("lon").distinct().orderBy(order).limit(pixels)
    return df.join(lats, "lat", "left_semi").join(lons, "lon", "left_semi")


def drop_water(df: DataFrame, cover: DataFrame, value: str = "value", keys: Keys = CELL, code: str = "code", mode: str = "null") -> DataFrame:
    """NULL (``mode='null'``) or drop (``mode='drop'``) the water cells of a land-cover layer."""
    water = cover.where(is_water(level_1(F.col(code)))).select(*keys).distinct()
    if mode == "drop":
        return df.join(water, list(keys), "left_anti")
    if mode != "null":
        raise ValueError("mode must be 'null' or 'drop'")
    marked = df.join(water.withColumn("_w", F.lit(1)), list(keys), "left")
    return marked.withColumn(value, F.when(F.col("_w").isNull(), F.col(value))).drop("_w").select(*df.columns)


def keep_dry_share(df: DataFrame, water_share: DataFrame, value: str = "value", keys: Keys = CELL, share: str = "water") -> DataFrame:
    """Keep values only where the water share of the cell is exactly 0."""
    joined = df.join(water_share.select(*keys, F.col(share).alias("_s")), list(keys), "left")
    return joined.withColumn(value, F.when(F.col("_s") == 0, F.col(value))).select(*df.columns)


def apply_cloud_mask(
    df: DataFrame, mask: DataFrame, values: Sequence[str] = ("value",), keys: Keys = CELL, time: str = "time",
    align: bool = True, flag: str = "cloud_mask", arrival: str | None = None,
) -> DataFrame:
    """One row per (cell, day), NULL where the mask says cloud (2).

    ``align`` keeps days present on both sides; without it days with no mask keep their values.
    """
    days = df.withColumn("_raw", F.col(time)).withColumn(time, F.to_date(time))
    days = first_per_key(days, [*keys, time], arrival or "_raw").drop("_raw")
    marks = mask.select(*keys, F.to_date(time).alias(time), F.col(flag).alias("_m"))
    marks = marks.groupBy(*keys, time).agg(F.max("_m").alias("_m"))
    joined = days.join(marks, [*keys, time], "inner" if align else "left")
    clear = F.coalesce(F.col("_m") != 2, F.lit(True))
    return joined.select(*[F.when(clear, F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def clear_sky_ndvi(
    df: DataFrame, mask: DataFrame, keys: Keys = CELL, time: str = "time", red: str = "channel_1", nir: str = "channel_2",
    flag: str = "cloud_mask", include_water: bool = True, every_days: int | None = None,
) -> DataFrame:
    """NDVI under clear sky (``ndvi``) beside NDVI with only zeros removed (``ndvi_zero_cleaned``).

    Clear means mask 1, or 0 and 1 with ``include_water``. ``every_days`` averages both over n-day bins.
    """
    for c in (red, nir):
        if c not in df.columns:
            raise ValueError(f"variable {c} not in table")
    allowed = (0, 1) if include_water else (1,)
    days = df.withColumn(time, F.to_date(time))
    marks = mask.select(*keys, F.to_date(time).alias(time), F.col(flag).alias("_m")).groupBy(*keys, time).agg(F.max("_m").alias("_m"))
    raw = ndvi(F.col(red), F.col(nir))
    out = days.join(marks, [*keys, time], "left").withColumn("ndvi", F.when(F.col("_m").isin(*allowed), raw))
    out = out.withColumn("ndvi_zero_cleaned", F.nullif(raw, F.lit(0.0))).drop("_m")
    if every_days is None:
        return out
    cut = one_value(days, F.min(time))
    clean = n_day_mean(out, every_days, keys, time, "ndvi", origin=cut)
    zero = n_day_mean(out, every_days, keys, time, "ndvi_zero_cleaned", origin=cut)
    return clean.join(zero, [*keys, time])


def valid_cells(
    df: DataFrame, target: str, features: Sequence[str] = (), keys: Keys = CELL, time: str = "time", water: DataFrame | None = None,
) -> DataFrame:
    """Cells whose target is never NULL and whose features are known at the first time; water removed."""
    first = F.min_by(F.struct(*[F.col(f) for f in features]), F.col(time)).alias("_f") if features else F.lit(True).alias("_f")
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(target).alias("_k"), first).where("_n = _k")
    for f in features:
        cells = cells.where(F.col("_f")[f].isNotNull())
    cells = cells.select(*keys)
    return cells if water is None else cells.join(water.select(*keys).distinct(), list(keys), "left_anti")


def keep_cells(df: DataFrame, cells: DataFrame, keys: Keys = CELL, invert: bool = False) -> DataFrame:
    return df.join(cells.select(*keys), list(keys), "left_anti" if invert else "left_semi")


def scatter_back(nodes: DataFrame, grid: DataFrame, keys: Keys = CELL) -> DataFrame:
    """Node rows on the full grid again; cells without a node get NULL."""
    return grid.select(*keys).distinct().join(nodes, list(keys), "left")


def drop_empty_cells(df: DataFrame, value: str = "value", keys: Keys = CELL) -> DataFrame:
    """Drop cells that are NULL at every time."""
    known = df.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n > 0").select(*keys)
    return df.join(known, list(keys), "left_semi")


def random_cells(df: DataFrame, n: int, seed: int = 42, keys: Keys = CELL, value: str | None = None, check: bool = True) -> DataFrame:
    """n distinct cells in a seeded hash order, the same on every run; too few cells is an error."""
    source = df if value is None else df.where(F.col(value).isNotNull())
    cells = source.select(*keys).distinct()
    picked = cells.orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), *keys).limit(n)
    if check and picked.count() < n:
        raise ValueError(f"fewer than {n} valid cells")
    return picked


def first_per_time(df: DataFrame, keys: Keys = CELL, time: str = "time", arrival: str = "arrival") -> DataFrame:
    """Drop duplicate times, keeping the first to arrive."""
    return first_per_key(df, [*keys, time], arrival)


def both_in_unit_range(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).between(0, 1) & F.col(y).between(0, 1))


def on_date(df: DataFrame, date, time: str = "valid_date", positive: str | None = None, check: bool = False) -> DataFrame:
    """One date of a forecast table; ``positive`` keeps rows with that column >= 0.

    ``check`` fails when the date lies outside the table's range.
    """
    when = F.lit(date).cast("date")
    out = df.where(F.col(time) == when)
    if positive is not None:
        out = out.where(F.col(positive) >= 0)
    if check:
        ends = df.agg(F.min(time).alias("first"), F.max(time).alias("last")).where(when.between(F.col("first"), F.col("last")))
        if ends.isEmpty():
            raise ValueError(f"{date} outside the forecast range")
    return out


def drop_missing(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def top_by_axis(df: DataFrame, axis: str, n: int, descending: bool = True) -> DataFrame:
    """Rows whose ``axis`` value ranks among the n extreme distinct ones."""
    order: Column = F.col(axis).desc() if descending else F.col(axis).asc()
    return df.join(df.select(axis).distinct().orderBy(order).limit(n), axis, "left_semi")



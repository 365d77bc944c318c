"""Hydrology: hourly reanalysis to daily variables, prepared inputs, feature and target cubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from drygrid.functions.grid import GridSpec
from drygrid.functions.values import declare_missing, fill_missing, floor_at_zero
from drygrid.operators.align import merge_variables
from drygrid.operators.common import CELL, Keys
from drygrid.operators.regrid import regrid_bilinear
from drygrid.operators.samples import min_max_normalise
from drygrid.operators.spatial import clip_to_regions
from drygrid.operators.subset import between_times, corner_crop, drop_water, in_box
from drygrid.operators.temporal import common_calendar, hourly_to_daily, interpolate


def hydro_variables(
    hourly: DataFrame, target: DataFrame, grid: GridSpec, sums: Sequence[str], extremes: Sequence[str] = (), soil: DataFrame | None = None,
    soil_grid: GridSpec | None = None, soil_values: Sequence[str] = (), keys: Keys = CELL,
) -> DataFrame:
    """Hourly variables to daily, onto the target grid, merged with soil moisture layers."""
    daily = hourly_to_daily(hourly, sums, extremes, [*keys, "lat", "lon"])
    for v in sums:
        daily = daily.withColumn(v, floor_at_zero(F.col(v)))
    names = [c for c in daily.columns if c not in (*keys, "lat", "lon", "time")]
    out = regrid_bilinear(daily, target, grid, names, keys)
    if soil is None:
        return out
    layers = regrid_bilinear(soil, target, soil_grid or grid, soil_values, keys).drop("lat", "lon")
    merged = merge_variables(out.drop("lat", "lon"), layers, keys=keys)
    return merged.join(target.select(*keys, "lat", "lon"), list(keys))


def prepare_inputs(
    cube: DataFrame, values: Sequence[str], start=None, end=None, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None,
    target: DataFrame | None = None, grid: GridSpec | None = None, crop: int | None = None, edges: DataFrame | None = None, countries: list | None = None,
    interpolate_gaps: bool = True, fill: float | None = -1.0, keys: Keys = CELL,
) -> DataFrame:
    """Box, period, calendar, interpolation, regridding, scaling to [0, 1], fill value, crop or polygon clip.

    Every cell gets every day of the period (of the table's common range where it is open). The period is cut before interpolation;
    values at its ends are not extrapolated.
    """
    work = between_times(declare_missing(cube), start, end)
    if lon is not None and lat is not None:
        work = in_box(work, lon, lat)
    work = common_calendar(work.select(*keys, "lat", "lon", "time", *values), keys, values=values, start=start, end=end)
    if interpolate_gaps:
        for v in values:
            work = interpolate(work, keys, value=v)
    if target is not None and grid is not None:
        work = regrid_bilinear(work, target, grid, values, keys)
    work = min_max_normalise(work, values)
    if fill is not None:
        for v in values:
            work = work.withColumn(v, fill_missing(F.col(v), fill))
    if edges is not None:
        return clip_to_regions(work, edges, countries=countries, keys=keys)
    return work if crop is None else corner_crop(work, crop)


def features_and_target(features: DataFrame, target: DataFrame, cover: DataFrame, value: str = "ndvi", keys: Keys = CELL) -> DataFrame:
    """Feature cube joined with the target, whose water cells are NULL."""
    dry = drop_water(target.select(*keys, "time", value), cover, value, keys)
    return features.join(dry, [*keys, "time"])

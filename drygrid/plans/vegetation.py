"""Vegetation: reflectance to smoothed NDVI, condition index and drought share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drygrid.functions import vegetation as veg
from drygrid.functions.values import low_flag, null_outside
from drygrid.operators.climatology import condition_index
from drygrid.operators.common import CELL, Keys
from drygrid.operators.series import whittaker
from drygrid.operators.spatial import clip_to_regions
from drygrid.operators.subset import apply_cloud_mask, clear_sky_ndvi, drop_water, keep_dry_share
from drygrid.operators.temporal import drop_long_gaps, fill_calendar, gap_streaks
from drygrid.sources.tables import sensing_time


def ndvi_from_reflectance(scenes: DataFrame, edges: DataFrame | None = None, countries: list | None = None, keys: Keys = CELL) -> DataFrame:
    """Scenes (cell, file_path, product_name, channels) to NDVI rows: clip, time, radiance, index."""
    work = scenes if edges is None else clip_to_regions(scenes, edges, countries=countries, keys=keys)
    attribute = F.col("start_time") if "start_time" in work.columns else F.lit(None).cast("string")
    work = work.withColumn("time", sensing_time(attribute, F.col("file_path")))
    name = F.col("product_name")
    work = work.withColumn("channel_1", veg.radiance(F.col("channel_1"), name, 0)).withColumn("channel_2", veg.radiance(F.col("channel_2"), name, 1))
    return work.withColumn("ndvi", veg.ndvi(F.col("channel_1"), F.col("channel_2")))


def smoothed_ndvi(
    scenes: DataFrame, mask: DataFrame, keys: Keys = CELL, max_gap: int | None = None, lam: float | None = None, tasks: int | None = None, **smoother
) -> DataFrame:
    """NDVI under the cloud mask on a daily calendar, gap flags, smoother.

    The calendar, the gap flags and the smoother share one partitioning by cell. ``tasks``: see ``fill_calendar``.
    """
    ndvi = ndvi_from_reflectance(scenes, keys=keys).select(*keys, "time", "ndvi")
    clear = apply_cloud_mask(ndvi, mask, ["ndvi"], keys)
    daily = gap_streaks(fill_calendar(clear, keys, values=["ndvi"], tasks=tasks), keys, value="ndvi")
    out = whittaker(daily, keys, value="ndvi", lam=lam, carry=("streaks", "quality_flag"), **smoother)
    if max_gap is not None:
        out = out.withColumn("smoothed", drop_long_gaps(F.col("smoothed"), F.col("quality_flag"), max_gap))
    return out


def vegetation_condition(
    bands: DataFrame, mask: DataFrame, cover: DataFrame | None = None, water_share: DataFrame | None = None,
    edges: DataFrame | None = None, countries: list | None = None, keys: Keys = CELL, lam: float | None = 1.0, low: float = 10.0,
    tasks: int | None = None,
) -> DataFrame:
    """Clear-sky NDVI without water, smoothed on a calendar, condition index, flag of low condition."""
    work = bands if edges is None else clip_to_regions(bands, edges, countries=countries, keys=keys)
    ndvi = clear_sky_ndvi(work, mask, keys).select(*keys, "time", null_outside(F.col("ndvi")).alias("ndvi"))
    if cover is not None:
        ndvi = drop_water(ndvi, cover, "ndvi", keys)
    if water_share is not None:
        ndvi = keep_dry_share(ndvi, water_share, "ndvi", keys)
    smooth = whittaker(fill_calendar(ndvi, keys, values=["ndvi"], tasks=tasks), keys, value="ndvi", lam=lam)
    smooth = smooth.withColumn("smoothed", null_outside(F.col("smoothed")))
    vci = condition_index(smooth, keys, value="smoothed")
    return vci.withColumn("low_condition", low_flag(F.col("vci"), low))

"""Verification: product matching, scores per cover class, forecast report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from drygrid.functions.cover import NOT_LAND, level_1
from drygrid.functions.grid import GridSpec
from drygrid.functions.values import drought_flag, low_flag
from drygrid.operators.align import common_period, copy_missing
from drygrid.operators.common import CELL, Keys, by_series, union_all
from drygrid.operators.events import transitions
from drygrid.operators.regrid import regrid_bilinear, regrid_nearest
from drygrid.operators.ssim import ssim
from drygrid.operators.verify import agreement, bias_corrected, contingency, error_by_percentile, mask_mse, mean_scores, nse


def match_products(
    product: DataFrame, reference: DataFrame, grid: GridSpec, steps: int, extreme: str = "drought", keys: Keys = CELL, value: str = "spi",
    dry_limit: float = -2.0, wet_limit: float = 2.0, by: Sequence[str] = CELL, tasks: int | None = None,
) -> DataFrame:
    """Product onto the reference cells, common dates, common gaps, flags, agreement indices per ``by``.

    The planner sizes joins by what it knows of the raw tables. ``tasks`` (see ``series_tasks``) sizes them by the calendar: both sides are dealt
    by cell and date once, and no calendar is broadcast.
    """
    if extreme not in ("drought", "flood"):
        raise ValueError("extreme must be 'drought' or 'flood'")
    cells = reference.select(*keys, "lat", "lon").distinct()
    moved = regrid_nearest(product, cells, grid, [value], keys).select(*keys, "time", value)
    moved, kept = common_period(moved, reference.select(*keys, "time", value), strict=False)
    if tasks is not None:
        moved, kept = (by_series(side, [*keys, "time"], tasks).hint("merge") for side in (moved, kept))
    moved = copy_missing(moved, kept, value, keys=keys)
    flag = "dry" if extreme == "drought" else "wet"
    a = transitions(moved, steps, keys, value=value, dry_limit=dry_limit, wet_limit=wet_limit).select(*keys, "time", F.col(flag).alias("target"))
    b = transitions(kept, steps, keys, value=value, dry_limit=dry_limit, wet_limit=wet_limit).select(*keys, "time", F.col(flag).alias("reference"))
    return agreement(a.join(b, [*keys, "time"]), "target", "reference", by)


def scores_by_cover(
    observed: DataFrame, forecast: DataFrame, cover: DataFrame, grid: GridSpec | None = None, observed_value: str = "vci", forecast_value: str = "spi",
    observed_limit: float = 10.0, forecast_limit: float = -2.0, by_cover: bool = True, keys: Keys = CELL, strict: bool = False,
) -> DataFrame:
    """Drought of an index against drought of a forecast, averaged over time, per first-level cover class.

    Without ``grid`` the tables already share cells. Water, snow and unknown classes are left out.
    ``strict`` compares the forecast with the negated limit.
    """
    observed, forecast = common_period(observed, forecast, strict=False)
    if grid is not None:
        cells = observed.select(*keys, "lat", "lon").distinct()
        forecast = regrid_bilinear(forecast, cells, grid, [forecast_value], keys)
    limit = -forecast_limit if strict else forecast_limit
    both = observed.select(*keys, "time", low_flag(F.col(observed_value), observed_limit).alias("obs")).join(
        forecast.select(*keys, "time", drought_flag(F.col(forecast_value), limit).alias("fc")), [*keys, "time"]
    )
    if not by_cover:
        return mean_scores(contingency(both, "obs", "fc"))
    classes = cover.select(*keys, level_1(F.col("code")).alias("level1")).where(~F.col("level1").isin(*NOT_LAND))
    tagged = both.join(classes, list(keys))
    return mean_scores(contingency(tagged, "obs", "fc", by=["level1", "time"]), by=["level1"])


def forecast_report(df: DataFrame, horizons: Sequence[int], mask: str | None = "mask", images: Sequence[str] = ("valid_date",), row: str = "row", col: str = "col") -> DataFrame:
    """(horizon, metric, percentile, lower, value) after a linear bias correction per horizon.

    Single scores are rmse, nse and ssim; rmse, nse and bias follow per tenth of the truth. All horizons
    and metrics share the same passes.
    """
    fc = bias_corrected(df.where(F.col("horizon").isin(*horizons)), by=["horizon"]).withColumn("y_pred", F.col("y_corrected"))
    m = F.col(mask) if mask else None
    single = fc.groupBy("horizon").agg(F.sqrt(mask_mse(F.col("y_pred"), F.col("y"), m)).alias("rmse"), nse(F.col("y_pred"), F.col("y")).alias("nse"))
    similar = ssim(fc.withColumnsRenamed({"y_pred": "a", "y": "b"}), image=["horizon", *images], by=["horizon"], row=row, col=col)
    blank = F.lit(None).cast("double")
    whole = single.join(similar, "horizon").unpivot(["horizon"], ["rmse", "nse", "ssim"], "metric", "value")
    bands = error_by_percentile(fc, ["rmse", "nse", "bias"], by=["horizon"]).unpivot(["horizon", "percentile", "lower"], ["rmse", "nse", "bias"], "metric", "value")
    return union_all(whole.withColumn("percentile", blank).withColumn("lower", blank), bands).select("horizon", "metric", "percentile", "lower", "value")

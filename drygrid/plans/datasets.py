"""Datasets: index and soil table, events per product, training tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from drygrid.functions.grid import GridSpec
from drygrid.operators.common import CELL, Keys
from drygrid.operators.events import drought_runs
from drygrid.operators.regrid import lookup_layers, regrid_nearest
from drygrid.operators.samples import batches, chronological_split, fold_rows, supervised_windows
from drygrid.operators.spatial import clip_to_regions
from drygrid.operators.subset import between_times, valid_cells
from drygrid.operators.temporal import common_calendar, weekly_mean


def index_soil_dataset(
    vegetation: DataFrame, products: dict[str, tuple[DataFrame, GridSpec]], rasters: DataFrame, corners: tuple[float, float, float],
    layers: Sequence[str], start=None, end=None, value: str = "ndvi", keys: Keys = CELL,
) -> DataFrame:
    """Weekly vegetation index with precipitation indices and soil attributes of each cell.

    ``products`` maps a column name to (cube with that column, its grid). Rows with every measure NULL drop.
    """
    cells = vegetation.select(*keys, "lat", "lon").distinct()
    cubes = [between_times(vegetation, start, end).select(*keys, "time", value)]
    for name, (cube, grid) in products.items():
        moved = regrid_nearest(between_times(cube, start, end), cells, grid, [name], keys)
        cubes.append(moved.select(*keys, "time", name))
    merged = reduce(lambda a, b: a.join(b, [*keys, "time"], "full_outer"), cubes)
    measures = [value, *products]
    weekly = weekly_mean(merged, keys, values=measures).na.drop("all", subset=measures)
    x, y, size = corners
    return weekly.join(lookup_layers(cells, rasters, x, y, size, layers), list(keys))


def events_per_product(indices: DataFrame, edges: DataFrame | None = None, countries: list | None = None, start=None, end=None, keys: Sequence[str] = ("product", "latency", "cell_id"), **options) -> DataFrame:
    """Drought events of every product and latency in one pass: the product is part of the series key."""
    work = between_times(indices, start, end)
    if edges is not None:
        work = clip_to_regions(work, edges, countries=countries)
    return drought_runs(work, keys, **options)


def training_tables(
    cube: DataFrame, features: Sequence[str], target: str, length: int, horizon: int, out: int = 1, batch_size: int = 32, train: float = 0.7, val: float = 0.333,
    water: DataFrame | None = None, keys: Keys = CELL, folds: tuple[int, int, int] | None = None, fill: float | None = -1.0,
    tasks: int | None = None, **windows,
) -> DataFrame:
    """Valid cells, chronological split, windows inside each part of each series, batch numbers per part.

    All cells are put on one daily calendar first (added days hold ``fill``), so a sample number is one date in every cell. The split
    comes before the windows, so none crosses its border. ``folds`` = (window, test length, stride)
    cuts sliding folds instead; every fold and part is then its own series. The last sample of a part
    follows from its number of dates (one row a part, broadcast), so the windows are computed once and no row leaves its series. ``tasks``:
    see ``fill_calendar``.
    """
    cells = valid_cells(cube, target, features, keys, water=water)
    values = list(dict.fromkeys([*features, target]))
    kept = common_calendar(cube.join(cells, list(keys), "left_semi").select(*keys, "time", *values), keys, values=values, fill=fill, tasks=tasks)
    if folds is None:
        parts, tagged = ["split"], chronological_split(kept, train, val)
    else:
        parts, tagged = ["fold", "part"], fold_rows(kept, *folds)
    longest = tagged.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_n")).groupBy(*parts).agg(F.max("_n").alias("_n"))
    samples = supervised_windows(tagged, features, target, length, horizon, out, keys=[*keys, *parts], **windows)
    before = windows.get("diffusion_days") or length
    numbered = samples.join(F.broadcast(longest), parts)
    return batches(numbered, batch_size, last=F.col("_n") - (before + horizon + out)).drop("_n")

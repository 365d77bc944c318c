"""Regridding on integer grid indices: nearest, bilinear, majority class and raster lookup.

A target cell finds its source cells by index arithmetic and an equi-join. The mapping has one to four
rows per target cell and never depends on the length of the time axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from drygrid.functions.grid import GridSpec, arc_col, arc_row
from drygrid.operators.common import CELL, Keys


def index_cells(df: DataFrame, grid: GridSpec) -> DataFrame:
    return df.withColumn("row", grid.row(F.col("lat"))).withColumn("col", grid.col(F.col("lon")))


def regrid_nearest(source: DataFrame, target: DataFrame, grid: GridSpec, values: Sequence[str] = ("value",), keys: Keys = CELL, extra: Sequence[str] = ("time",)) -> DataFrame:
    """Each target cell takes the values of the source cell it falls in.

    ``source`` has lat/lon on ``grid``; ``target`` lists distinct target cells (keys, lat, lon).
    """
    cells = index_cells(target, grid).select(*keys, "lat", "lon", "row", "col")
    data = index_cells(source, grid).select("row", "col", *extra, *values)
    return data.join(cells, ["row", "col"]).select(*keys, "lat", "lon", *extra, *values)


def bilinear_weights(target: DataFrame, grid: GridSpec, keys: Keys = CELL) -> DataFrame:
    """(keys, row, col, weight): up to four source cells around each target cell, zero weights left out."""
    y, x = grid.row_position(F.col("lat")), grid.col_position(F.col("lon"))
    # A target on a source line must not be pushed off it by the last bits of the division.
    y = F.when(F.abs(y - F.rint(y)) < 1e-9, F.rint(y)).otherwise(y)
    x = F.when(F.abs(x - F.rint(x)) < 1e-9, F.rint(x)).otherwise(x)
    work = target.select(*keys, "lat", "lon", y.alias("_y"), x.alias("_x"))
    r0, c0 = F.floor("_y"), F.floor("_x")
    fy, fx = F.col("_y") - r0, F.col("_x") - c0

    def corner(dr: int, dc: int) -> Column:
        wy = fy if dr else 1 - fy
        wx = fx if dc else 1 - fx
        return F.struct((r0 + dr).cast("int").alias("row"), (c0 + dc).cast("int").alias("col"), (wy * wx).alias("weight"))

    corners = F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])
    return work.select(*keys, "lat", "lon", F.inline(corners)).where("weight > 0")


def regrid_bilinear(source: DataFrame, target: DataFrame, grid: GridSpec, values: Sequence[str] = ("value",), keys: Keys = CELL, extra: Sequence[str] = ("time",)) -> DataFrame:
    """Weighted mean of the surrounding source cells; missing ones drop out of both sums."""
    weights = bilinear_weights(target, grid, keys)
    data = index_cells(source, grid).select("row", "col", *extra, *values)
    joined = data.join(weights, ["row", "col"])
    aggs = []
    for v in values:
        w = F.when(F.col(v).isNotNull(), F.col("weight"))
        aggs.append(F.try_divide(F.sum(w * F.col(v)), F.sum(w)).alias(v))
    return joined.groupBy(*keys, "lat", "lon", *extra).agg(*aggs)


def onto_coarser(a: DataFrame, b: DataFrame, grid_a: GridSpec, grid_b: GridSpec, keys: Keys = CELL, value_a: str = "value_a", value_b: str = "value_b") -> DataFrame:
    """Resample the finer of two cubes onto the coarser grid and keep the common (cell, time) rows."""
    if abs(grid_a.dlat * grid_a.dlon) <= abs(grid_b.dlat * grid_b.dlon):
        fine, coarse, grid, v = a, b, grid_a, value_a
    else:
        fine, coarse, grid, v = b, a, grid_b, value_b
    cells = coarse.select(*keys, "lat", "lon").distinct()
    moved = regrid_bilinear(fine, cells, grid, [v], keys).select(*keys, "time", v)
    return coarse.join(moved, [*keys, "time"])


def regrid_majority(cover: DataFrame, grid: GridSpec, code: str = "code") -> DataFrame:
    """Most frequent class per target grid cell; ties take the lower code."""
    counts = index_cells(cover.where(F.col(code).isNotNull()), grid).groupBy("row", "col", code).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("row", "col").agg(F.max_by(code, F.struct("_n", -F.col(code))).alias(code))


# Layer names of the soil lookup in output order, and the scale of the slopes.
SLOPES = tuple(f"slope{i}" for i in range(1, 9))
LAND_COVERS = ("WAT", "NVG", "URB", "GRS", "FOR", "CULTRF", "CULTIR", "CULT")
SOIL_QUALITIES = tuple(f"SQ{i}" for i in range(1, 8))
SLOPE_SCALE = 10000.0


def soil_layers() -> list[str]:
    return ["elevation", "land", *SLOPES, *[f"{c}_LAND" for c in LAND_COVERS], *SOIL_QUALITIES]


def lookup_layers(
    cells: DataFrame, rasters: DataFrame, x_corner: float, y_corner: float, cellsize: float, layers: Sequence[str] | None = None, invert: bool = False
) -> DataFrame:
    """Attach sparse raster layers (layer, row, col, value) to cells by grid index, absent as 0.

    All layers come in one pivot and one join. Slopes are scaled; negative elevation and land are NULL.
    ``invert`` reads the cell axes swapped.
    """
    layers = list(layers) if layers is not None else soil_layers()
    lat, lon = ("lon", "lat") if invert else ("lat", "lon")
    placed = cells.withColumn("_row", arc_row(F.col(lat), y_corner, cellsize)).withColumn("_col", arc_col(F.col(lon), x_corner, cellsize))
    wide = rasters.where(F.col("layer").isin(*layers)).groupBy(F.col("row").alias("_row"), F.col("col").alias("_col")).agg(
        *[F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name) for name in layers]
    )
    out = placed.join(wide, ["_row", "_col"], "left")
    for name in layers:
        value = F.coalesce(F.col(name), F.lit(0.0))
        if name in SLOPES:
            value = value / F.lit(SLOPE_SCALE)
        if name in ("elevation", "land"):
            value = F.when(value >= 0, value)
        out = out.withColumn(name, value)
    return out.select(*cells.columns, *layers)

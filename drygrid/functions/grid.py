"""Longitude rolling, grid indices, the working domain and great-circle distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The working domain in degrees.
DOMAIN_LON = (32.016, 51.484)
DOMAIN_LAT = (-5.484, 15.484)
EARTH_RADIUS_KM = 6371.0088


@dataclass(frozen=True)
class GridSpec:
    """Regular grid: centre of row 0 / column 0 and the two steps (negative for descending axes)."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float

    def row(self, lat: Column) -> Column:
        return F.round((lat - F.lit(self.lat0)) / F.lit(self.dlat)).cast("int")

    def col(self, lon: Column) -> Column:
        return F.round((lon - F.lit(self.lon0)) / F.lit(self.dlon)).cast("int")

    def row_position(self, lat: Column) -> Column:
        return (lat - F.lit(self.lat0)) / F.lit(self.dlat)

    def col_position(self, lon: Column) -> Column:
        return (lon - F.lit(self.lon0)) / F.lit(self.dlon)


def roll_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def reanalysis_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0))


def reanalysis_lat(lat: Column) -> Column:
    return F.pmod(lat + 90.0, F.lit(180.0)) - 90.0


def arc_row(lat: Column, y_corner: float, cellsize: float) -> Column:
    """Row of an ASCII grid; halves round to even."""
    return F.abs(F.bround((lat + F.lit(float(y_corner))) / F.lit(cellsize), 0).cast("int"))


def arc_col(lon: Column, x_corner: float, cellsize: float) -> Column:
    return F.bround((lon - F.lit(float(x_corner))) / F.lit(cellsize), 0).cast("int")


def arc_lon(col: Column, x_corner: float, cellsize: float) -> Column:
    return F.lit(float(x_corner)) + col * F.lit(cellsize)


def arc_lat(row: Column, y_corner: float, cellsize: float) -> Column:
    return F.lit(abs(float(y_corner))) - row * F.lit(cellsize)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def pixel_grid(
    spark: SparkSession,
    rows: int,
    cols: int,
    lat_range: tuple[float, float] = DOMAIN_LAT,
    lon_range: tuple[float, float] = DOMAIN_LON,
) -> DataFrame:
    """Evenly spaced lat/lon mesh, ends included. Built from one ``range`` so no join is needed."""

    def axis(index: Column, ends: tuple[float, float], n: int) -> Column:
        return F.lit(ends[0]) + index * F.lit((ends[1] - ends[0]) / max(n - 1, 1))

    cell = spark.range(rows * cols).withColumnRenamed("id", "cell_id")
    row = F.floor(F.col("cell_id") / F.lit(cols)).cast("int")
    col = F.pmod(F.col("cell_id"), F.lit(cols)).cast("int")
    return cell.select(
        "cell_id", row.alias("row"), col.alias("col"),
        axis(row, lat_range, rows).alias("lat"), axis(col, lon_range, cols).alias("lon"),
    )

"""Cube readers: multi-file scans, box and period slices, forecast and sample tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drygrid.functions.values import declare_missing, sentinel_to_null
from drygrid.functions.vegetation import half_day_back, unpack_byte_ndvi, unpack_percent_ndvi
from drygrid.operators.common import Keys
from drygrid.operators.subset import between_times, corner_crop, in_box
from drygrid.sources.sinks import TILE_COLUMNS, TILE_DEGREES

KEY_NAMES = ("cell_id", "lat", "lon", "time", "longitude", "latitude", "x", "y", "X", "Y")


def read_files(
    spark: SparkSession, paths: str | Sequence[str], hook: Callable[[DataFrame], DataFrame] | None = None,
    kind: str = "parquet", skip_corrupt: bool = False, with_path: bool = False, schema=None, **options,
) -> DataFrame:
    """Scan one or many files with NaN as NULL; ``hook`` transforms the scan (per-file logic uses ``file_path``).

    ``skip_corrupt`` drops unreadable files and fails only when nothing is left. Give the ``schema`` then:
    without one, Parquet footers of all files are read to find it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files given")
    reader = spark.read.options(**options)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
        if schema is None and kind == "parquet":
            reader = reader.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(kind).load(paths)
    if with_path or hook is not None:
        df = df.select("*", F.col("_metadata.file_path").alias("file_path"))
    df = declare_missing(df)
    if hook is not None:
        df = hook(df)
        df = df if with_path else df.drop("file_path")
    if skip_corrupt and df.isEmpty():
        raise ValueError("every file was empty or corrupt")
    return df


def data_variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY_NAMES]


def dimensions(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in KEY_NAMES]


def load_arrays(
    spark: SparkSession, path: str, variables: Sequence[str], start=None, end=None,
    lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, tile: float = TILE_DEGREES,
) -> DataFrame:
    """Named variables inside an inclusive box and period; both filters and the column list reach the scan.

    Years of ``write_cube`` and tiles of ``write_tiles`` (of ``tile`` degrees) outside are not listed for the scan.
    """
    df = spark.read.parquet(path)
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise ValueError(f"variables {missing} not in {data_variables(df)}")
    if "year" in df.columns:
        df = df if start is None else df.where(F.col("year") >= int(str(start)[:4]))
        df = df if end is None else df.where(F.col("year") <= int(str(end)[:4]))
    df = between_times(df, start, end)
    if lon is not None and lat is not None:
        if set(TILE_COLUMNS) <= set(df.columns):
            for name, ends in zip(TILE_COLUMNS, (lat, lon)):
                df = df.where(F.col(name).between(*[math.floor(v / tile) for v in sorted(ends)]))
        df = in_box(df, lon, lat)
    return declare_missing(df.select(*[c for c in dimensions(df)], *variables))


def hourly_reanalysis(spark: SparkSession, path: str, variables: Sequence[str], start, end, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Hourly scan up to the first hour of the day after ``end``, so the last day is complete after the shift of accumulations."""
    last = str(date.fromisoformat(str(end)[:10]) + timedelta(days=1))
    return load_arrays(spark, path, variables, start, last, lon, lat)


def time_from_name(path: Column) -> Column:
    """14 digits (yyyyMMddHHmmss) or yyyy_MM_dd in the file name; otherwise NULL."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.regexp_extract(name, r"(\d{14})", 1)
    day = F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyy_MM_dd")),
    )


def sensing_time(attribute: Column, path: Column) -> Column:
    """Start time from the product attribute, else from the file name."""
    return F.coalesce(F.try_to_timestamp(attribute, F.lit("yyyyMMdd'T'HHmmss'Z'")), time_from_name(path))


def noon_from_name(path: Column) -> Column:
    """Day from the 12 to 14 digits of the file name, stamped at noon."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{12,14})", 1)
    day = F.try_to_timestamp(F.nullif(F.substring(digits, 1, 8), F.lit("")), F.lit("yyyyMMdd"))
    return day + F.expr("INTERVAL 12 HOURS")


# --- products ------------------------------------------------------------------------------------------


def resolve_products(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """``wanted`` (kind, product) with the stored ``path`` of each and, where its file name says so, ``product_name``, ``index_name`` and ``latency``.

    ``registry`` has one row per stored product: kind, product, path. What it does not list keeps NULLs.
    """
    stored = registry.groupBy("kind", "product").agg(F.min("path").alias("path"))
    product, index, latency = spi_name_parts(F.col("path"))
    found = wanted.join(stored, ["kind", "product"], "left")
    return found.withColumns({"product_name": product, "index_name": F.nullif(index, F.lit("")), "latency": latency})


def read_product(spark: SparkSession, registry: DataFrame, kind: str, product: str, **options) -> DataFrame:
    """Scan the files that the registry lists for one product."""
    rows = registry.where((F.col("kind") == kind) & (F.col("product") == product)).select("path").distinct().collect()
    if not rows:
        raise LookupError(f"the registry lists no {kind} product called {product}")
    return read_files(spark, [r.path for r in rows], **options)


def spi_name_parts(path: Column) -> tuple[Column, Column, Column]:
    """(product, index name, latency days) from ``<product>_spi_gamma_<days>.<suffix>``."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = r"^(.*?)_?(spi_gamma_(\d+))\.\w+$"
    latency = F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")).cast("int")
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2), latency


def read_spi(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    def label(df: DataFrame) -> DataFrame:
        product, index, latency = spi_name_parts(F.col("file_path"))
        return df.withColumn("product", product).withColumn("index_name", index).withColumn("latency", latency)

    return read_files(spark, paths, hook=label)


def packed_ndvi(df: DataFrame, packed: str = "packed", product: str = "byte", time: str = "time") -> DataFrame:
    """Add ``ndvi`` from the packed column: ``byte`` floors the time to the day, ``percent`` moves it back half a day."""
    if product == "byte":
        return df.withColumn("ndvi", unpack_byte_ndvi(F.col(packed))).withColumn(time, F.to_date(time))
    if product == "percent":
        return df.withColumn("ndvi", unpack_percent_ndvi(F.col(packed))).withColumn(time, half_day_back(F.col(time)))
    raise ValueError("product must be 'byte' or 'percent'")


# --- forecasts and samples -----------------------------------------------------------------------------


def forecasts(spark: SparkSession, path: str, model: str | None = None, horizons: Sequence[int] | None = None, mask: DataFrame | None = None, drop_last: int = 0, keys: Keys = ("cell_id",)) -> DataFrame:
    """Forecast table with -1 as NULL, an optional common mask, and the last dates of a model cut off."""
    df = declare_missing(spark.read.parquet(path))
    if model is not None:
        df = df.where(F.col("model") == model)
    if horizons is not None:
        df = df.where(F.col("horizon").isin(*horizons))
    for c in ("y", "y_pred"):
        df = df.withColumn(c, sentinel_to_null(F.col(c)))
    if mask is not None:
        df = df.join(mask.select(*keys, "mask"), list(keys), "left")
    if drop_last:
        last = df.agg(F.max("valid_date")).scalar()
        df = df.where(F.col("valid_date") <= F.date_sub(last, drop_last))
    return df


def samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def stored_subset(df: DataFrame, start, end, lookback: int, channels: Sequence[str], pixels: int | None = 64, keys: Sequence[str] = ("cell_id", "lat", "lon", "time"), fill: float | None = None) -> DataFrame:
    """Stored cube from ``lookback`` days before ``start`` to ``end``, channels in order, corner crop."""
    begin = F.date_sub(F.lit(start).cast("date"), lookback)
    out = df.where((F.col("time") >= begin) & (F.col("time") <= F.lit(end).cast("date"))).select(*keys, *channels)
    if fill is not None:
        out = out.fillna(fill, list(channels))
    return out if pixels is None else corner_crop(out, pixels)


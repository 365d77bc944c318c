"""Writers: result tables, partitioned cubes, samples, predictions and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A tile is 20 cells of a quarter-degree grid wide and high, a block is a year long.
TILE_DEGREES, BLOCK_DAYS = 5.0, 366
TILE_COLUMNS = ("tile_lat", "tile_lon")


def write_csv(df: DataFrame, folder: str, name: str, first_year: int | None = None, last_year: int | None = None, product: str | None = None) -> str:
    """CSV table with header, named by content, years and product."""
    parts = [name, *[str(p) for p in (first_year, last_year, product) if p is not None]]
    path = f"{folder.rstrip('/')}/{'_'.join(parts)}"
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_cube(df: DataFrame, path: str, time: str = "time", keys: Sequence[str] = ("cell_id",), mode: str = "overwrite", dynamic: bool = True) -> None:
    """Zstd Parquet by year, rows sorted by cell and time inside each file.

    Rows are rebalanced by year: adaptive execution splits a year that exceeds its advisory partition size and joins small ones, so
    the number of tasks and files follows the data. With ``dynamic`` only the years present are replaced.
    """
    out = df.withColumn("year", F.year(time)).hint("rebalance", "year").sortWithinPartitions("year", *keys, time)
    writer = out.write.mode(mode).option("compression", "zstd").partitionBy("year")
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_tiles(
    df: DataFrame, path: str, time: str = "time", keys: Sequence[str] = ("cell_id",), tile: float = TILE_DEGREES, days: int = BLOCK_DAYS,
    mode: str = "overwrite", row_group: int | None = None,
) -> None:
    """Zstd Parquet by tiles of ``tile`` x ``tile`` degrees (columns lat, lon); within a tile, blocks of ``days`` days, then cells.

    A box reads the folders of its tiles only (``load_arrays``), and a period skips row groups by their least and greatest time. Rows are
    rebalanced by tile, so a tile beyond the advisory partition size is written by several tasks. Only tiles present in ``df`` are
    replaced. ``row_group`` is the size of a row group in bytes. Rows without coordinates go to a folder of their own.
    """
    out = _with_tiles(df, tile).withColumn("_block", F.floor(F.unix_date(F.to_date(time)) / F.lit(days)))
    out = out.hint("rebalance", *TILE_COLUMNS).sortWithinPartitions(*TILE_COLUMNS, "_block", "lat", "lon", *keys, time).drop("_block")
    writer = out.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*TILE_COLUMNS)
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)


def write_region(df: DataFrame, path: str, time: str = "time", keys: Sequence[str] = ("cell_id",), tile: float = TILE_DEGREES, **options) -> None:
    """Replace the rows of ``df`` (by keys and time) in a table of ``write_tiles``; all other rows stay, tiles without new rows are not read.

    New files are staged and the touched tiles exchanged when the job commits, so a lost executor leaves the table as it was.
    ``df`` has one row per key and time and must not be read from ``path``. Columns that ``df`` lacks become NULL in its rows.
    """
    spark = df.sparkSession
    new = _with_tiles(df, tile)
    touched = new.select(*TILE_COLUMNS).distinct()
    stored = spark.read.parquet(path)
    same = [stored[c].eqNullSafe(touched[c]) for c in TILE_COLUMNS]
    near = stored.join(touched, same, "left_semi")
    kept = near.join(new.select(*keys, time), [*keys, time], "left_anti")
    write_tiles(kept.unionByName(new, allowMissingColumns=True).drop(*TILE_COLUMNS), path, time, keys, tile, **options)


def _with_tiles(df: DataFrame, tile: float) -> DataFrame:
    return df.withColumns({name: F.floor(F.col(axis) / F.lit(float(tile))).cast("int") for name, axis in zip(TILE_COLUMNS, ("lat", "lon"))})


def write_samples(samples: DataFrame, path: str, batch_size: int, sample: str = "sample_id") -> None:
    """Samples by split, with their batch number; the remainder is the last batch."""
    out = samples.withColumn("batch_id", F.floor(F.col(sample) / F.lit(batch_size)).cast("long"))
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def append_failures(failures: DataFrame, path: str) -> None:
    """Append (time, error) rows with the moment they were logged."""
    failures.select("time", "error", F.current_timestamp().alias("logged_at")).write.mode("append").parquet(path)


def with_axes(predictions: DataFrame, dates: DataFrame, cells: DataFrame, sample: str = "sample_id", keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Predictions with the valid date of their sample and the coordinates of their cell."""
    return predictions.join(dates.select(sample, "valid_date"), sample).join(cells.select(*keys, "lat", "lon"), list(keys))


def write_predictions(predictions: DataFrame, path: str, keys: Sequence[str] = ("cell_id",), mode: str = "overwrite") -> None:
    write_cube(predictions, path, time="valid_date", keys=keys, mode=mode)

"""Text sources: ASCII grids, point-service JSON, directory pages and file manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Layout of an ASCII grid.
ASCII_HEADER_LINES = 6


def parse_ascii_grid(texts: DataFrame, text: str = "value", layer: str | Column = "layer") -> DataFrame:
    """Sparse cells (layer, row, col, value, x_corner, y_corner, cellsize) of whole grid files.

    Six header lines (columns, rows, corners, cell size, no-data token) precede the rows; cells equal to
    the no-data token are left out, so an absent cell reads as 0 later.
    """
    name = F.col(layer) if isinstance(layer, str) else layer
    lines = texts.select(name.alias("layer"), F.split(F.trim(text), r"\r?\n").alias("_l"))
    body = F.slice("_l", F.lit(ASCII_HEADER_LINES + 1), F.size("_l") - ASCII_HEADER_LINES)
    return _cells(lines.select("layer", *_header(lambda i: F.col("_l")[i]), F.posexplode(body).alias("row", "_line")))


def _header(line: Callable[[int], Column]) -> list[Column]:
    def field(i: int) -> Column:
        return F.element_at(F.split(F.trim(line(i)), r"\s+"), 2)

    return [field(2).cast("double").alias("x_corner"), field(3).cast("double").alias("y_corner"), field(4).cast("double").alias("cellsize"), field(5).alias("_nodata")]


def _cells(rows: DataFrame) -> DataFrame:
    """Cells of grid lines (``row``, ``_line``) that carry their header."""
    cells = rows.select("layer", "row", "x_corner", "y_corner", "cellsize", "_nodata", F.posexplode(F.split(F.trim("_line"), r"\s+")).alias("col", "_t"))
    return cells.where((F.col("_t") != F.col("_nodata")) & (F.col("_t") != "")).select(
        "layer", "row", "col", F.col("_t").cast("double").alias("value"), "x_corner", "y_corner", "cellsize"
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each block of a file from 0; a task reads its blocks one after the other and each in order."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("_block").to_numpy()
        path = batch.column("_path").dictionary_encode()
        name = path.indices.to_numpy()
        new = np.concatenate(([True], (block[1:] != block[:-1]) | (name[1:] != name[:-1])))
        start = np.flatnonzero(new)
        number = np.arange(batch.num_rows) - np.repeat(start, np.diff(np.append(start, batch.num_rows)))
        if last == (path[0].as_py(), block[0]):
            number[: start[1] if len(start) > 1 else None] += seen
        last, seen = (path[-1].as_py(), block[-1]), int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=["_line", "_path", "_block", "_at"])


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their number in the file: (_path, _number, _line).

    Files are cut into blocks of ``spark.sql.files.maxPartitionBytes``. A line is numbered within its block, and the lines of all blocks
    before it, one row a block, are added by a join.
    """
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    rows = text.select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    lines = rows.mapInArrow(_numbered, "_line string, _path string, _block long, _at long")
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select("_path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(blocks, ["_path", "_block"]).select("_path", (F.col("_before") + F.col("_at")).alias("_number"), "_line")


def read_ascii_grids(spark: SparkSession, paths: str | Sequence[str], layer: Column | None = None) -> DataFrame:
    """Cells of grid files as ``parse_ascii_grid`` gives them; a file may be larger than a task.

    The layer is the file name without suffix, or ``layer`` of the address in ``_path``. Each file starts with its header.
    """
    lines = text_lines(spark, paths)
    name = F.regexp_extract(F.col("_path"), r"([^/]+)\.\w+$", 1) if layer is None else layer
    top = lines.where(F.col("_number") < ASCII_HEADER_LINES).groupBy("_path").agg(F.map_from_entries(F.collect_list(F.struct("_number", "_line"))).alias("_h"))
    top = top.select("_path", *_header(lambda i: F.col("_h")[F.lit(i).cast("long")]))
    rows = lines.where(F.col("_number") >= ASCII_HEADER_LINES).join(top, "_path")
    return _cells(rows.select(name.alias("layer"), (F.col("_number") - ASCII_HEADER_LINES).cast("int").alias("row"), "x_corner", "y_corner", "cellsize", "_nodata", "_line"))


POINT_SCHEMA = (
    "geometry struct<coordinates: array<double>>, "
    "properties struct<parameter: map<string, map<string, double>>>, "
    "parameters map<string, struct<units: string, longname: string>>"
)


def point_series(docs: DataFrame) -> DataFrame:
    """(lat, lon, elevation, parameter, time, value, units, long_name) from point-service documents.

    The coordinates are read in the order lat, lon, elevation.
    """
    at = F.col("geometry.coordinates")
    per = docs.select(at[0].alias("lat"), at[1].alias("lon"), at[2].alias("elevation"), "parameters",
                      F.explode("properties.parameter").alias("parameter", "_days"))
    rows = per.select("lat", "lon", "elevation", "parameters", "parameter", F.explode("_days").alias("_d", "value"))
    meta = F.try_element_at("parameters", F.col("parameter"))
    return rows.select("lat", "lon", "elevation", "parameter", F.to_date("_d", "yyyyMMdd").alias("time"), "value",
                       meta["units"].alias("units"), meta["longname"].alias("long_name"))


def read_point_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return point_series(spark.read.schema(POINT_SCHEMA).json(paths if isinstance(paths, str) else list(paths), multiLine=True))


def pivot_parameters(points: DataFrame, parameters: Sequence[str], units: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One column per parameter; ``units`` maps a parameter to (units, long name) kept as field metadata."""
    wide = points.groupBy("lat", "lon", "elevation", "time").pivot("parameter", list(parameters)).agg(F.first("value"))
    for name, (unit, title) in (units or {}).items():
        wide = wide.withMetadata(name, {"units": unit, "long_name": title})
    return wide


def json_numbers(text: Column, field: str) -> Column:
    return F.get_json_object(text, f"$.{field}").cast("double")


def page_links(pages: DataFrame, html: str = "html", url: str = "url", suffix: str | None = None) -> DataFrame:
    """Every href of stored directory pages with the address it resolves to."""
    out = pages.select("*", F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).drop(html)
    if suffix is not None:
        out = out.where(F.endswith("href", F.lit(suffix)))
    plain = F.regexp_replace(F.col(url), r"[?#].*$", "")
    root = F.regexp_extract(plain, r"^(\w+://[^/]+)", 1)
    folder = F.when(plain.rlike(r"^\w+://[^/]+$"), F.concat(plain, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    resolved = (
        F.when(F.col("href").rlike(r"^\w+://"), F.col("href"))
        .when(F.startswith("href", F.lit("/")), F.concat(root, F.col("href")))
        .otherwise(F.concat(folder, F.col("href")))
    )
    return out.withColumn("address", resolved)


# Days a ten-day product starts on, and the marks a file template may hold.
DEKAD_DAYS = (1, 11, 21)
TEMPLATE_MARKS = {"{year}": "yyyy", "{month}": "MM", "{day}": "dd", "{date}": "yyyyMMdd"}


def with_address(days: DataFrame, template: str, time: str = "time") -> DataFrame:
    """Add the file address of each date from a template with year, month, day and date marks."""
    out = F.lit(template)
    for mark, form in TEMPLATE_MARKS.items():
        out = F.replace(out, F.lit(mark), F.date_format(time, form))
    return days.withColumn("address", out)


def dekad_manifest(spark: SparkSession, first_year: int, last_year: int, template: str) -> DataFrame:
    """(time, address) for days 1, 11 and 21 of every month."""
    months = spark.range(1).select(
        F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-01").cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("_m")
    )
    return with_address(months.select(F.explode(F.array(*[F.date_add("_m", d - 1) for d in DEKAD_DAYS])).alias("time")), template)


def daily_manifest(spark: SparkSession, start, end, template: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("time"))
    return with_address(days, template)

"""Layouts of stored cubes and text files that are cut into blocks."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from drygrid.sources import sinks, tables as tb, text as tx


def grid_cube(spark, days=40):
    """24 x 24 cells a quarter degree apart around the equator and the prime meridian."""
    cells = spark.range(24 * 24).select(F.col("id").alias("cell_id"), ((F.floor(F.col("id") / 24) - 12) * 0.25 + 0.1).alias("lat"), ((F.col("id") % 24 - 12) * 0.25 + 0.1).alias("lon"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_d")
    return cells.select("*", steps).select("cell_id", "lat", "lon", F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("_d")).alias("time"), (F.col("cell_id") * 1000 + F.col("_d")).cast("double").alias("value"))


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_box_lists_its_tiles_and_a_period_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "tiles")
    cube = grid_cube(spark)
    sinks.write_tiles(cube, path, tile=1.0, days=10, row_group=2000)
    got = tb.load_arrays(spark, path, ["value"], "2020-01-12", "2020-01-18", lon=(-0.9, -0.4), lat=(0.2, 0.9), tile=1.0)
    want = cube.where("time BETWEEN '2020-01-12' AND '2020-01-18' AND lon BETWEEN -0.9 AND -0.4 AND lat BETWEEN 0.2 AND 0.9")
    assert plain(got, "cell_id", "time", "value") == plain(want, "cell_id", "time", "value")
    assert "PartitionFilters: [isnotnull(tile_lat" in got._jdf.queryExecution().executedPlan().toString()

    folders = list((tmp_path / "tiles").glob("tile_lat=*/tile_lon=*"))
    assert len(folders) == 36
    read = list((tmp_path / "tiles" / "tile_lat=0" / "tile_lon=-1").glob("*.parquet"))
    groups = opened = 0
    for file in read:
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("time")
        for g in range(meta.num_row_groups):
            ends = meta.row_group(g).column(at).statistics
            groups += 1
            opened += ends.max >= dt.date(2020, 1, 12) and ends.min <= dt.date(2020, 1, 18)
    assert groups >= 4 and opened <= groups // 2


def test_a_region_is_replaced_and_the_rest_stays(spark, tmp_path):
    path = str(tmp_path / "tiles")
    cube = grid_cube(spark, 5)
    sinks.write_tiles(cube, path, tile=1.0)
    before = {str(p) for p in (tmp_path / "tiles").rglob("*.parquet")}
    part = "lat BETWEEN 0.3 AND 1.4 AND lon BETWEEN 0.3 AND 0.7 AND day(time) = 3"
    # a row that was not there, in a tile that was not there
    extra = spark.createDataFrame([(9999, 40.0, 40.0, dt.date(2020, 1, 3), -5.0)], cube.schema)
    new = cube.where(part).withColumn("value", F.lit(-1.0)).unionByName(extra)
    assert new.count() == 11
    sinks.write_region(new, path, tile=1.0)
    want = cube.withColumn("value", F.when(F.expr(part), F.lit(-1.0)).otherwise(F.col("value"))).unionByName(extra)
    assert plain(spark.read.parquet(path), *cube.columns) == plain(want, *cube.columns)
    after = {str(p) for p in (tmp_path / "tiles").rglob("*.parquet")}
    gone = {p.rsplit("/", 1)[0].split("/tiles/")[1] for p in before - after}
    assert gone == {"tile_lat=0/tile_lon=0", "tile_lat=1/tile_lon=0"}


def test_rows_without_coordinates_and_an_empty_region(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = spark.createDataFrame([(1, None, 2.0, dt.date(2020, 1, 1), 1.0), (2, 3.0, 4.0, dt.date(2020, 1, 1), None)], "cell_id long, lat double, lon double, time date, value double")
    sinks.write_tiles(rows, path)
    sinks.write_region(rows.limit(0), path)
    assert [r.cell_id for r in spark.read.parquet(path).orderBy("cell_id").collect()] == [1, 2]
    sinks.write_region(rows.where("lat IS NULL").withColumn("value", F.lit(7.0)), path)
    assert [r.value for r in spark.read.parquet(path).orderBy("cell_id").collect()] == [7.0, None]


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_grid_file_makes_many_tasks(spark, tmp_path, small_blocks, end):
    for name, shift in (("wide", 0), ("deep", 3)):
        head = ["ncols 9", "nrows 150", f"xllcorner {shift}", "yllcorner -10", "cellsize 0.5", "NODATA_value -9"]
        body = [" ".join(str(-9 if (r * c) % 5 == 1 else r * 10 + c + shift) for c in range(9)) for r in range(150)]
        (tmp_path / f"{name}.asc").write_text(end.join(head + body) + end, newline="")
    names = ["layer", "row", "col", "value", "x_corner", "y_corner", "cellsize"]
    lines = tx.text_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    assert sorted((r._path[-8:], r._number) for r in lines.collect()) == [(n, i) for n in ("deep.asc", "wide.asc") for i in range(156)]
    whole = spark.read.text(str(tmp_path), wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"(\w+)\.asc$", 1).alias("layer"))
    got = plain(tx.read_ascii_grids(spark, str(tmp_path)), *names)
    assert got == plain(tx.parse_ascii_grid(whole), *names) and len(got) > 2000


def test_numbers_go_on_over_arrow_batches(spark, tmp_path, small_blocks):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1000)))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert all(int(r._line) == r._number for r in tx.text_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)

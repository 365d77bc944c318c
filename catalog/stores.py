"""Queries that write a table and read it back, and readers over the given files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from catalog.records import grid_texts
from catalog.registry import CUBE, FORECAST, query, r6
from drygrid.operators import align as al, samples as sa, spatial as sp
from drygrid.plans import datasets
from drygrid.sources import sinks, tables as tb, text as tx
from drygrid.streaming.incremental import days_to_retry, ingest_new_days, ingested

PLACE = "-5.25 + (cell_id // 10) * 0.2::DOUBLE AS lat, 32.25 + (cell_id % 10) * 0.25::DOUBLE AS lon"


def scratch(t, name: str) -> str:
    """A new folder all executors reach: below ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    folder = t.spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", t.spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="stores-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("cube_stored_and_sliced", f"""WITH {CUBE}, c AS (SELECT *, {PLACE} FROM cube) SELECT cell_id, time, value2 FROM c WHERE time BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' AND lon BETWEEN 32.5 AND 34 AND lat BETWEEN -5.3 AND -4""")
def cube_stored_and_sliced(t):
    path = scratch(t, "cube")
    sinks.write_cube(t.cube(coordinates=True), path)
    return tb.load_arrays(t.spark, path, ["value2"], "1996-03-01", "1998-02-28", lon=(32.5, 34.0), lat=(-5.3, -4.0)).select("cell_id", "time", "value2")


@query("cube_years_replaced", f"""WITH {CUBE} SELECT cell_id, time, CASE WHEN YEAR(time) = 1997 THEN -value ELSE value END AS value FROM cube""")
def cube_years_replaced(t):
    """The whole cube, then one year anew: the other years stay."""
    path, cube = scratch(t, "cube"), t.cube()
    sinks.write_cube(cube, path)
    sinks.write_cube(cube.where("year(time) = 1997").withColumn("value", -F.col("value")), path)
    return t.spark.read.parquet(path).select("cell_id", "time", "value")


@query("tiles_stored_and_sliced", f"""WITH {CUBE}, c AS (SELECT *, {PLACE} FROM cube) SELECT cell_id, time, value2 FROM c WHERE time BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' AND lon BETWEEN 32.5 AND 34 AND lat BETWEEN -5.3 AND -4""")
def tiles_stored_and_sliced(t):
    """The cube in tiles of half a degree; the box lists the folders of its tiles only."""
    path = scratch(t, "tiles")
    sinks.write_tiles(t.cube(coordinates=True), path, tile=0.5)
    return tb.load_arrays(t.spark, path, ["value2"], "1996-03-01", "1998-02-28", lon=(32.5, 34.0), lat=(-5.3, -4.0), tile=0.5).select("cell_id", "time", "value2")


@query("region_replaced", f"""WITH {CUBE}, c AS (SELECT *, {PLACE} FROM cube) SELECT cell_id, time, CASE WHEN YEAR(time) = 1997 AND lon BETWEEN 32.5 AND 33.6 AND lat > -5.3 THEN -value ELSE value END AS value FROM c""")
def region_replaced(t):
    """The whole cube, then one year of a box that cuts through tiles anew: all else stays."""
    path, cube = scratch(t, "tiles"), t.cube(coordinates=True)
    sinks.write_tiles(cube, path, tile=0.5)
    box = cube.where("year(time) = 1997 AND lon BETWEEN 32.5 AND 33.6 AND lat > -5.3")
    sinks.write_region(box.withColumn("value", -F.col("value")), path, tile=0.5)
    return t.spark.read.parquet(path).select("cell_id", "time", "value")


@query("ascii_grid_files", """SELECT CAST(p_partkey // 200 AS VARCHAR) AS layer, CAST(p_partkey % 200 // 10 AS INTEGER) AS row, CAST(p_partkey % 10 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value, 0.25::DOUBLE AS cellsize FROM part WHERE p_size <> 7""")
def ascii_grid_files(t):
    """Parts as files of 20 x 10 grids, read by blocks."""
    path = scratch(t, "grids")
    grid_texts(t).select("layer", "value").withColumnRenamed("layer", "g").write.partitionBy("g").text(path)
    return tx.read_ascii_grids(t.spark, path, F.regexp_extract("_path", r"/g=(\d+)/", 1)).select("layer", "row", "col", "value", "cellsize")


@query("events_as_csv", f"""WITH {CUBE} SELECT cell_id, time, value FROM cube""")
def events_as_csv(t):
    path = sinks.write_csv(t.cube().select("cell_id", "time", "value"), scratch(t, "tables"), "cube", 1995, 2001, "quantity")
    return tb.read_files(t.spark, path, kind="csv", schema="cell_id long, time date, value double", header="true")


@query("stored_training_samples", f"""WITH {CUBE}, d AS (SELECT time, ROW_NUMBER() OVER (ORDER BY time) AS r, COUNT(*) OVER () AS n FROM (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM cube)),
 t AS (SELECT time, CASE WHEN r <= ROUND_EVEN(0.7::DOUBLE * n, 0) THEN 'train' WHEN r <= ROUND_EVEN(0.7::DOUBLE * n, 0) + ROUND_EVEN((1 - 0.7::DOUBLE) * 0.333::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM d),
 w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY time) - 1 AS i, COUNT(*) OVER (PARTITION BY split) AS n FROM t)
SELECT cell_id, i - 5 AS sample_id, time AS origin, (i - 5) // 16 AS batch_id FROM w, (SELECT DISTINCT cell_id FROM cube) WHERE split = 'train' AND i >= 5 AND i + 3 < n""")
def stored_training_samples(t):
    path = scratch(t, "samples")
    out = datasets.training_tables(t.cube(), ["value2"], "value", 5, 3, tasks=t.tasks()).where("position = sample_id").drop("position", "batch_id")
    sinks.write_samples(out, path, 16)
    return tb.samples(t.spark, path, "train").select("cell_id", "sample_id", "origin", "batch_id")


@query("failures_logged_twice", f"""WITH {FORECAST}, f AS (SELECT valid_date::VARCHAR AS time, 'no prediction' AS error FROM fc WHERE y_pred IS NULL) SELECT time, error, COUNT(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM f) GROUP BY ALL""")
def failures_logged_twice(t):
    path = scratch(t, "log")
    lost = t.forecast().where("y_pred IS NULL").select(F.col("valid_date").cast("string").alias("time"), F.lit("no prediction").alias("error"))
    sinks.append_failures(lost, path)
    sinks.append_failures(lost, path)
    return t.spark.read.parquet(path).where("logged_at IS NOT NULL").groupBy("time", "error").agg(F.count(F.lit(1)).alias("n"))


@query("stored_forecasts", f"""WITH {FORECAST}, l AS (SELECT MAX(valid_date) AS d FROM fc WHERE model = 'last') SELECT cell_id, valid_date, ROUND(CASE WHEN y <> -1 THEN y END, 6) AS y, ROUND(CASE WHEN y_pred <> -1 THEN y_pred END, 6) AS y_pred, mask FROM fc, l WHERE model = 'last' AND horizon = 10 AND valid_date <= d - 30""")
def stored_forecasts(t):
    path, fc = scratch(t, "forecasts"), t.forecast()
    sinks.write_predictions(fc.drop("mask"), path)
    mask = fc.select("cell_id", "mask").distinct()
    return tb.forecasts(t.spark, path, "last", [10], mask=mask, drop_last=30).select("cell_id", "valid_date", r6("y"), r6("y_pred"), "mask")


@query("predictions_with_axes", f"""WITH {FORECAST}, c AS (SELECT s_suppkey AS cell_id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier) SELECT fc.cell_id, valid_date, ROUND(y_pred, 6) AS y_pred, ROUND(lat, 6) AS lat, lon FROM fc JOIN c USING (cell_id) WHERE model = 'last'""")
def predictions_with_axes(t):
    fc = t.forecast().where("model = 'last'").withColumn("sample_id", F.date_diff("valid_date", F.lit("1990-01-01").cast("date")))
    dates = fc.select("sample_id", "valid_date").distinct()
    path = scratch(t, "predictions")
    sinks.write_predictions(sinks.with_axes(fc.select("sample_id", "cell_id", "y_pred"), dates, t.cells()), path)
    return t.spark.read.parquet(path).select("cell_id", "valid_date", r6("y_pred"), r6("lat"), "lon")


@query("ingested_newest_rows", f"""WITH {CUBE} SELECT cell_id, time, CASE WHEN DAY(time) = 1 THEN value + 1000 ELSE value END AS value FROM cube""")
def ingested_newest_rows(t):
    """The cube arrives as files; later the first day of every month arrives again with other values."""
    inbox, cube, bad, progress = (scratch(t, n) for n in ("inbox", "cube", "bad", "progress"))
    rows = t.cube().select("cell_id", F.col("time").cast("timestamp").alias("time"), "value")
    for part in (rows, rows.where("day(time) = 1").withColumn("value", F.col("value") + 1000)):
        part.write.mode("append").parquet(inbox)
        ingest_new_days(t.spark, inbox, "cell_id long, time timestamp, value double", cube, bad, progress).awaitTermination()
    return ingested(t.spark, cube).select("cell_id", F.to_date("time").alias("time"), "value")


@query("days_to_retry", """SELECT time FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS time FROM orders) WHERE time NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def days_still_to_fetch(t):
    """Order days on which nothing was shipped."""
    expected = t.orders.select(F.to_date("o_orderdate").alias("time")).distinct()
    return days_to_retry(expected, t.cube().select(F.col("time").alias("day")))


@query("files_with_a_hook", """SELECT 'lineitem' AS name, l_orderkey, l_linenumber FROM lineitem""")
def files_with_a_hook(t):
    def named(df):
        return df.withColumn("name", F.regexp_extract("file_path", r"/(\w+)\.parquet", 1))

    return tb.read_files(t.spark, f"{t.folder}/lineitem.parquet", hook=named).select("name", "l_orderkey", "l_linenumber")


@query("hourly_slice_with_one_day_more", """SELECT user_id AS cell_id, ts AS time, value FROM events WHERE CAST(ts AS DATE) >= (SELECT MIN(CAST(ts AS DATE)) FROM events) AND ts <= (SELECT MIN(CAST(ts AS DATE)) + INTERVAL 3 DAY FROM events) AND user_id % 10 BETWEEN 2 AND 6""")
def hourly_slice_with_one_day_more(t):
    path = scratch(t, "hourly")
    rows = t.events.select(F.col("user_id").alias("cell_id"), (F.col("user_id") % 10).cast("double").alias("lon"), F.lit(1.0).alias("lat"), F.col("ts").alias("time"), "value")
    rows.write.parquet(path)
    first = rows.agg(F.to_date(F.min("time"))).first()[0]
    import datetime as dt

    out = tb.hourly_reanalysis(t.spark, path, ["value"], str(first), str(first + dt.timedelta(days=2)), lon=(2.0, 6.0), lat=(0.0, 2.0))
    return out.select("cell_id", "time", "value")


@query("products_resolved", """WITH r AS (SELECT DISTINCT 'P' || l_returnflag || l_linenumber AS product, '/data/P' || l_returnflag || '_spi_gamma_' || l_linenumber * 30 || '.nc' AS path, 'P' || l_returnflag AS name, l_linenumber * 30 AS latency FROM lineitem)
SELECT l_orderkey, l_linenumber, 'P' || l_returnflag || (l_linenumber + 1) AS product, path, name AS product_name, 'spi_gamma_' || latency AS index_name, latency FROM lineitem LEFT JOIN r ON r.product = 'P' || l_returnflag || (l_linenumber + 1)""")
def products_resolved(t):
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    registry = t.lineitem.select(F.lit("SPI").alias("kind"), F.concat(F.lit("P"), flag, number.cast("string")).alias("product"),
                                 F.concat(F.lit("/data/P"), flag, F.lit("_spi_gamma_"), (number * 30).cast("string"), F.lit(".nc")).alias("path"))
    wanted = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("SPI").alias("kind"), F.concat(F.lit("P"), flag, (number + 1).cast("string")).alias("product"))
    return tb.resolve_products(wanted, registry).select("l_orderkey", "l_linenumber", "product", "path", "product_name", "index_name", "latency")


@query("packed_index_readers", """SELECT l_orderkey, l_linenumber, 'byte' AS product, CASE WHEN l_partkey % 256 <> 255 THEN ROUND(-0.08 + 0.004::DOUBLE * (l_partkey % 256), 6) END AS ndvi, CAST(l_shipdate AS DATE) AS day FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 'percent', CASE WHEN l_partkey % 256 <> 255 THEN ROUND((l_partkey % 256) / 100.0::DOUBLE, 6) END, CAST(l_shipdate - INTERVAL 12 HOUR AS DATE) FROM lineitem""")
def packed_index_readers(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("packed"), F.col("l_shipdate").alias("time"))
    parts = [tb.packed_ndvi(rows, product=p).select("l_orderkey", "l_linenumber", F.lit(p).alias("product"), r6("ndvi"), F.to_date("time").alias("day")) for p in ("byte", "percent")]
    return parts[0].unionByName(parts[1])


@query("axes_swapped", """SELECT s_suppkey AS cell_id, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lat, ROUND(-5.25 + (s_suppkey // 10) * 0.2::DOUBLE, 6) AS lon, 'lon' AS axis FROM supplier""")
def axes_swapped(t):
    cells = t.cells().withColumn("lat", F.round("lat", 6))
    return al.swap_axes(cells).withColumn("axis", F.lit(al.axis_name(cells, "lon"))).select("cell_id", "lat", "lon", "axis")


@query("channels_in_order", f"""WITH {CUBE} SELECT cell_id, time, value || ',' || value2 || ',' || (value + value2) AS channels FROM (SELECT cell_id, time, CAST(value AS INTEGER) AS value, CAST(value2 AS INTEGER) AS value2 FROM cube)""")
def channels_in_order(t):
    whole = t.cube().select("cell_id", "time", (F.col("value") + F.col("value2")).cast("int").alias("sm_1"), F.col("value2").cast("int").alias("t2m"), F.col("value").cast("int").alias("total_precipitation"))
    out = sa.order_channels(whole)
    return out.select("cell_id", "time", F.concat_ws(",", *[F.col(c).cast("string") for c in out.columns[2:]]).alias("channels"))


@query("imputed_constant", f"""WITH {CUBE} SELECT cell_id, time, CASE WHEN value > 30 THEN value ELSE -9 END AS value FROM cube""")
def imputed_constant(t):
    return sp.impute(t.cube().select("cell_id", "time", F.when(F.col("value") > 30, F.col("value")).alias("value")), "constant", fill=-9.0)


@query("common_period_checked", f"""WITH {CUBE}, a AS (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM cube), b AS (SELECT CAST(UNNEST(generate_series(MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS time FROM orders)
SELECT a.time FROM a JOIN b USING (time)""")
def common_period_checked(t):
    ship = al.calendar_days(t.cube())
    order = al.calendar_days(t.orders.select(F.to_date("o_orderdate").alias("time")))
    one, other = al.common_period(ship, order, strict=True)
    return one.join(other, "time")

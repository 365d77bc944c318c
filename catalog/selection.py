"""Row subsetting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.columns import COVER_SQL, cover_codes
from catalog.registry import CUBE, FILLED, FORECAST, GRID, query, r6
from drygrid.operators import subset as sub
from drygrid.operators.common import head_by_time, to_long, to_wide, union_all, label_axis


@query("cells_in_box", f"""WITH {GRID} SELECT cell_id, time, value FROM grid WHERE lon BETWEEN 32.5 AND 33.75 AND lat BETWEEN -5 AND -4""")
def cells_in_box(t):
    return sub.in_box(t.cube(coordinates=True), (32.5, 33.75), (-5.0, -4.0)).select("cell_id", "time", "value")


@query("rows_in_period", f"""WITH {CUBE} SELECT cell_id, time, value FROM cube WHERE time BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""")
def rows_in_period(t):
    return sub.between_times(t.cube(), "1997-03-01", "1998-02-28").select("cell_id", "time", "value")


@query("rows_in_season", f"""WITH {CUBE} SELECT cell_id, time, value FROM cube WHERE YEAR(time) IN (1996, 1999) AND MONTH(time) IN (10, 11, 12)""")
def rows_in_season(t):
    return sub.in_season(t.cube(), [1996, 1999], [10, 11, 12]).select("cell_id", "time", "value")


@query("season_beside_climatology", f"""WITH {CUBE}, k AS (SELECT STRFTIME(time, '%m-%d') AS month_day, AVG(value) AS climate FROM cube GROUP BY 1)
SELECT cell_id, time, value, ROUND(climate, 6) AS climate FROM cube JOIN k ON STRFTIME(time, '%m-%d') = month_day WHERE YEAR(time) = 1996""")
def season_beside_climatology(t):
    cube = t.cube()
    climate = cube.groupBy(F.date_format("time", "MM-dd").alias("month_day")).agg(F.avg("value").alias("climate"))
    return sub.align_to_climatology(sub.in_season(cube, [1996]), climate).select("cell_id", "time", "value", r6("climate"))


@query("nearest_cell_series", f"""WITH {GRID}, b AS (SELECT (SELECT lat FROM grid ORDER BY ABS(lat + 4.6), lat LIMIT 1) AS la, (SELECT lon FROM grid ORDER BY ABS(lon - 33.1), lon LIMIT 1) AS lo)
SELECT cell_id, time, value FROM grid, b WHERE lat = la AND lon = lo""")
def nearest_cell_series(t):
    return sub.nearest_cell(t.cube(coordinates=True), -4.6, 33.1).select("cell_id", "time", "value")


@query("corner_crop_left", f"""WITH {GRID}, la AS (SELECT DISTINCT lat FROM grid ORDER BY lat DESC LIMIT 4), lo AS (SELECT DISTINCT lon FROM grid ORDER BY lon LIMIT 4)
SELECT cell_id, time, value FROM grid WHERE lat IN (SELECT lat FROM la) AND lon IN (SELECT lon FROM lo)""")
def corner_crop_left(t):
    return sub.corner_crop(t.cube(coordinates=True), 4).select("cell_id", "time", "value")


@query("corner_crop_right", f"""WITH {GRID}, la AS (SELECT DISTINCT lat FROM grid ORDER BY lat DESC LIMIT 4), lo AS (SELECT DISTINCT lon FROM grid ORDER BY lon DESC LIMIT 4)
SELECT cell_id, time, value FROM grid WHERE lat IN (SELECT lat FROM la) AND lon IN (SELECT lon FROM lo)""")
def corner_crop_right(t):
    return sub.corner_crop(t.cube(coordinates=True), 4, "right").select("cell_id", "time", "value")


@query("water_cells_nulled", f"""WITH {COVER_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN code IN (80, 200) THEN NULL ELSE l_quantity END AS value FROM lineitem JOIN codes ON p_partkey = l_partkey""")
def water_cells_nulled(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    return sub.drop_water(rows, cover_codes(t).withColumnRenamed("p_partkey", "cell_id")).drop("cell_id")


@query("water_cells_dropped", f"""WITH {COVER_SQL} SELECT l_orderkey, l_linenumber, l_quantity AS value FROM lineitem JOIN codes ON p_partkey = l_partkey WHERE code NOT IN (80, 200)""")
def water_cells_dropped(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    return sub.drop_water(rows, cover_codes(t).withColumnRenamed("p_partkey", "cell_id"), mode="drop").drop("cell_id")


@query("dry_share_cells_kept", """SELECT l_orderkey, l_linenumber, CASE WHEN p_size % 5 = 0 THEN l_quantity END AS value FROM lineitem JOIN part ON p_partkey = l_partkey""")
def dry_share_cells_kept(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("cell_id"), F.col("l_quantity").alias("value"))
    water = t.part.select(F.col("p_partkey").alias("cell_id"), (F.col("p_size") % 5).alias("water"))
    return sub.keep_dry_share(rows, water).drop("cell_id")


MASK = """mask AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, MAX(CASE WHEN l_linenumber <= 4 THEN l_linenumber % 3 END) AS m FROM lineitem GROUP BY 1, 2)"""


def cloud_mask(t):
    """A mask value for every line; from the fifth line of an order on it is missing."""
    mask = F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber") % 3)
    return t.lineitem.select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("time"), mask.alias("cloud_mask"))


@query("cloud_mask_inner", f"""WITH {CUBE}, {MASK} SELECT cube.cell_id, cube.time, CASE WHEN m IS NULL OR m <> 2 THEN value END AS value FROM cube JOIN mask ON cube.cell_id = mask.cell_id AND cube.time = mask.time""")
def cloud_mask_inner(t):
    return sub.apply_cloud_mask(t.cube().select("cell_id", "time", "value"), cloud_mask(t))


@query("cloud_mask_left", f"""WITH {CUBE}, {MASK} SELECT cube.cell_id, cube.time, CASE WHEN m IS NULL OR m <> 2 THEN value END AS value FROM cube LEFT JOIN mask ON cube.cell_id = mask.cell_id AND cube.time = mask.time""")
def cloud_mask_left(t):
    return sub.apply_cloud_mask(t.cube().select("cell_id", "time", "value"), cloud_mask(t), align=False)


@query("clear_sky_ndvi", f"""WITH {CUBE}, {MASK} SELECT cube.cell_id, cube.time, CASE WHEN m IN (0, 1) THEN ROUND((value2 - value) / NULLIF(value2 + value, 0), 6) END AS ndvi,
 ROUND(NULLIF((value2 - value) / NULLIF(value2 + value, 0), 0), 6) AS ndvi_zero_cleaned FROM cube LEFT JOIN mask ON cube.cell_id = mask.cell_id AND cube.time = mask.time""")
def clear_sky_ndvi(t):
    bands = t.cube().withColumnsRenamed({"value": "channel_1", "value2": "channel_2"})
    return sub.clear_sky_ndvi(bands, cloud_mask(t)).select("cell_id", "time", r6("ndvi"), r6("ndvi_zero_cleaned"))


@query("clear_land_ndvi_five_days", f"""WITH {CUBE}, {MASK}, o AS (SELECT MIN(time) AS a FROM cube), v AS (SELECT cube.cell_id, a + CAST((cube.time - a) // 5 * 5 AS INTEGER) AS time, (value2 - value) / NULLIF(value2 + value, 0) AS n, m
 FROM cube CROSS JOIN o LEFT JOIN mask ON cube.cell_id = mask.cell_id AND cube.time = mask.time)
SELECT cell_id, time, ROUND(AVG(CASE WHEN m = 1 THEN n END), 6) AS ndvi, ROUND(AVG(NULLIF(n, 0)), 6) AS ndvi_zero_cleaned FROM v GROUP BY 1, 2""")
def clear_land_ndvi_five_days(t):
    bands = t.cube().withColumnsRenamed({"value": "channel_1", "value2": "channel_2"})
    return sub.clear_sky_ndvi(bands, cloud_mask(t), include_water=False, every_days=5).select("cell_id", "time", r6("ndvi"), r6("ndvi_zero_cleaned"))


@query("valid_cells", f"""WITH {FILLED}, n AS (SELECT cell_id, time, CASE WHEN cell_id % 3 = 0 AND value IS NULL THEN NULL ELSE COALESCE(value, 0) END AS v, value2 FROM filled)
SELECT cell_id FROM n GROUP BY 1 HAVING COUNT(*) = COUNT(v) AND ARG_MIN(value2, time) IS NOT NULL AND cell_id % 11 <> 4""")
def valid_cells(t):
    holes = t.filled().withColumn("v", F.when((F.col("cell_id") % 3 == 0) & F.col("value").isNull(), None).otherwise(F.coalesce("value", F.lit(0.0))))
    water = t.cells().where("cell_id % 11 = 4")
    return sub.valid_cells(holes, "v", ["value2"], water=water)


@query("cells_scattered_back", f"""WITH {CUBE}, m AS (SELECT cell_id, AVG(value) AS mean FROM cube WHERE cell_id % 4 <> 0 GROUP BY 1) SELECT s_suppkey AS cell_id, ROUND(mean, 6) AS mean FROM supplier LEFT JOIN m ON cell_id = s_suppkey""")
def cells_scattered_back(t):
    kept = sub.keep_cells(t.cube(), t.cells().where("cell_id % 4 = 0"), invert=True)
    return sub.scatter_back(kept.groupBy("cell_id").agg(r6(F.avg("value"), "mean")), t.cells())


@query("empty_cells_dropped", f"""WITH {CUBE}, n AS (SELECT cell_id, time, CASE WHEN cell_id % 5 <> 2 THEN value END AS value FROM cube) SELECT cell_id, time, value FROM n WHERE cell_id IN (SELECT cell_id FROM n GROUP BY 1 HAVING COUNT(value) > 0)""")
def empty_cells_dropped(t):
    return sub.drop_empty_cells(t.cube().select("cell_id", "time", F.when(F.col("cell_id") % 5 != 2, F.col("value")).alias("value")))


@query("first_row_per_time", """SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, MIN(l_orderkey) AS arrival FROM lineitem GROUP BY 1, 2""")
def first_row_per_time(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("time"), F.col("l_orderkey").alias("arrival"))
    return sub.first_per_time(rows)


@query("random_cell_series", f"""WITH {CUBE} SELECT * FROM cube WHERE cell_id IN (SELECT cell_id FROM (SELECT DISTINCT cell_id FROM cube WHERE value IS NOT NULL) ORDER BY md5(cell_id || ':42'), cell_id LIMIT 10)""")
def random_cell_series(t):
    cube = t.cube()
    return sub.keep_cells(cube, sub.random_cells(cube, 10, value="value"))


@query("pairs_in_unit_range", f"""WITH {FORECAST} SELECT model, horizon, valid_date, cell_id, ROUND(y, 6) AS y, ROUND(y_pred, 6) AS y_pred FROM fc WHERE y BETWEEN 0 AND 1 AND y_pred BETWEEN 0 AND 1""")
def pairs_in_unit_range(t):
    return sub.both_in_unit_range(t.forecast(), "y", "y_pred").select("model", "horizon", "valid_date", "cell_id", r6("y"), r6("y_pred"))


@query("forecasts_on_date", f"""WITH {FORECAST} SELECT model, horizon, valid_date, cell_id, ROUND(y, 6) AS y, ROUND(y_pred, 6) AS y_pred FROM fc WHERE valid_date = DATE '1998-06-15' AND y >= 0""")
def forecasts_on_date(t):
    return sub.on_date(t.forecast(), "1998-06-15", positive="y", check=True).select("model", "horizon", "valid_date", "cell_id", r6("y"), r6("y_pred"))


@query("rows_without_missing", f"""WITH {FILLED}, n AS (SELECT cell_id, time, value, NULLIF(value2, 1) AS value2 FROM filled) SELECT * FROM n WHERE value IS NOT NULL AND value2 IS NOT NULL""")
def rows_without_missing(t):
    rows = t.filled().withColumn("value2", F.nullif(F.col("value2"), F.lit(1.0)))
    return sub.drop_missing(rows, "any", ["value", "value2"])


@query("rows_not_all_missing", f"""WITH {FILLED} SELECT cell_id, time, value, value2 FROM filled WHERE value IS NOT NULL OR value2 IS NOT NULL""")
def rows_not_all_missing(t):
    return sub.drop_missing(t.filled(), "all", ["value", "value2"])


@query("northmost_rows", f"""WITH {GRID} SELECT cell_id, time, value FROM grid WHERE lat IN (SELECT DISTINCT lat FROM grid ORDER BY lat DESC LIMIT 2)""")
def northmost_rows(t):
    return sub.top_by_axis(t.cube(coordinates=True), "lat", 2).select("cell_id", "time", "value")


@query("last_dates", f"""WITH {CUBE} SELECT cell_id, time, value FROM cube WHERE time IN (SELECT DISTINCT time FROM cube ORDER BY time DESC LIMIT 30)""")
def last_dates(t):
    return head_by_time(t.cube(), 30, last=True).select("cell_id", "time", "value")


@query("wide_by_flag", """SELECT CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) FILTER (l_returnflag = 'A') AS "A", SUM(l_quantity) FILTER (l_returnflag = 'N') AS "N", SUM(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def wide_by_flag(t):
    daily = t.lineitem.groupBy(F.to_date("l_shipdate").alias("time"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return to_wide(daily, ["time"], "l_returnflag", "q", ["A", "N", "R"])


@query("long_by_variable", f"""WITH {CUBE} SELECT cell_id, time, 'value' AS variable, value FROM cube UNION ALL SELECT cell_id, time, 'value2', value2 FROM cube""")
def long_by_variable(t):
    return to_long(t.cube(), ["cell_id", "time"], ["value", "value2"])


@query("products_concatenated", f"""WITH {CUBE} SELECT cell_id, time, value, CAST(NULL AS DOUBLE) AS price, 'quantity' AS product FROM cube UNION ALL
SELECT NULL, CAST(o_orderdate AS DATE), NULL, ROUND(SUM(o_totalprice), 2), 'orders' FROM orders GROUP BY 2""")
def products_concatenated(t):
    orders = t.orders.groupBy(F.to_date("o_orderdate").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    return label_axis({"quantity": t.cube().select("cell_id", "time", "value"), "orders": orders}, "product").select("cell_id", "time", "value", "price", "product")


@query("tables_united", """SELECT s_suppkey AS cell_id, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer""")
def tables_united(t):
    return union_all(t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("nation")),
                     t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("nation")))

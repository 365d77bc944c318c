"""Joins by key, regridding and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.columns import COVER_SQL, cover_codes
from catalog.registry import CUBE, FILLED, GRID, query, r6, with_coordinates
from drygrid.functions.grid import GridSpec
from drygrid.operators import align as al, regrid, spatial


def orders_cube(t):
    """Second product: order totals per customer cell and day."""
    return t.orders.groupBy((F.col("o_custkey") % 100).alias("cell_id"), F.to_date("o_orderdate").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("orders"))


ORDERS = """oc AS (SELECT o_custkey % 100 AS cell_id, CAST(o_orderdate AS DATE) AS time, CAST(COUNT(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2)"""


@query("two_cubes_aligned", f"""WITH {CUBE}, {ORDERS} SELECT cube.cell_id, cube.time, value, orders FROM cube JOIN oc ON cube.cell_id = oc.cell_id AND cube.time = oc.time""")
def two_cubes_aligned(t):
    return al.align(t.cube().select("cell_id", "time", "value"), orders_cube(t))


@query("raw_rows_aligned_by_first", """WITH a AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, MIN(l_orderkey) AS a FROM lineitem GROUP BY 1, 2),
 b AS (SELECT o_custkey % 100 AS cell_id, CAST(o_orderdate AS DATE) AS time, MIN(o_orderkey) AS b FROM orders GROUP BY 1, 2)
SELECT a.cell_id, a.time, a, b FROM a JOIN b ON a.cell_id = b.cell_id AND a.time = b.time""")
def raw_rows_aligned_by_first(t):
    a = t.lineitem.select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("time"), F.col("l_orderkey").alias("a"))
    b = t.orders.select((F.col("o_custkey") % 100).alias("cell_id"), F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("b"))
    return al.align(a, b)


@query("variables_merged_outer", f"""WITH {CUBE}, {ORDERS} SELECT COALESCE(cube.cell_id, oc.cell_id) AS cell_id, COALESCE(cube.time, oc.time) AS time, value, orders
 FROM cube FULL OUTER JOIN oc ON cube.cell_id = oc.cell_id AND cube.time = oc.time""")
def variables_merged_outer(t):
    return al.merge_variables(t.cube().select("cell_id", "time", "value"), orders_cube(t))


@query("common_period_rows", f"""WITH {CUBE}, {ORDERS}, e AS (SELECT GREATEST((SELECT MIN(time) FROM cube), (SELECT MIN(time) FROM oc)) AS a, LEAST((SELECT MAX(time) FROM cube), (SELECT MAX(time) FROM oc)) AS b)
SELECT cell_id, time, value FROM cube, e WHERE time BETWEEN a AND b""")
def common_period_rows(t):
    return al.common_period(t.cube().select("cell_id", "time", "value"), orders_cube(t), strict=False)[0]


@query("layer_repeated_over_time", f"""WITH {CUBE} SELECT cell_id, time, value, s_nationkey AS nation FROM cube LEFT JOIN supplier ON s_suppkey = cell_id""")
def layer_repeated_over_time(t):
    layer = t.cells().select("cell_id", F.col("s_nationkey").alias("nation"))
    return al.repeat_over_time(t.cube().select("cell_id", "time", "value"), layer)


@query("rows_with_partner", f"""WITH {CUBE}, {ORDERS} SELECT cell_id, time, value FROM cube WHERE EXISTS (SELECT 1 FROM oc WHERE oc.cell_id = cube.cell_id AND oc.time = cube.time)""")
def rows_with_partner(t):
    return al.members_only(t.cube().select("cell_id", "time", "value"), orders_cube(t), ["cell_id", "time"])


@query("rows_without_partner", f"""WITH {CUBE}, {ORDERS} SELECT cell_id, time, value FROM cube WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.cell_id = cube.cell_id AND oc.time = cube.time)""")
def rows_without_partner(t):
    return al.without(t.cube().select("cell_id", "time", "value"), orders_cube(t), ["cell_id", "time"])


@query("days_without_any_row", f"""WITH {CUBE}, s AS (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM (SELECT CASE WHEN value > 60 THEN time END AS time FROM cube)) SELECT time FROM s WHERE time NOT IN (SELECT time FROM cube WHERE value > 60)""")
def days_without_any_row(t):
    """Low values have no valid time."""
    return al.absent_days(t.cube().withColumn("time", F.when(F.col("value") > 60, F.col("time"))))


@query("series_on_calendar", f"""WITH {CUBE}, k AS (SELECT time, SUM(CASE WHEN value > 60 THEN value END) AS value FROM cube GROUP BY 1), s AS (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM k) SELECT s.time, value FROM s LEFT JOIN k ON k.time = s.time""")
def series_on_calendar(t):
    return al.on_calendar(t.cube().groupBy("time").agg(F.sum(F.when(F.col("value") > 60, F.col("value"))).alias("value")))


@query("bad_days_not_collected", f"""WITH {CUBE}, b AS (SELECT time FROM cube GROUP BY 1 HAVING COUNT(*) FILTER (value < 5) > 0) SELECT time FROM b WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END = time)""")
def bad_days_not_collected(t):
    from drygrid.operators.quality import negative_days

    bad = negative_days(t.cube().withColumn("value", F.col("value") - 5)).select("time")
    done = t.orders.select(F.when(F.col("o_orderstatus") == "P", F.to_date("o_orderdate")).alias("time"))
    return al.without(bad, done, ["time"])


@query("missing_copied_from_reference", f"""WITH {CUBE}, {ORDERS} SELECT cube.cell_id, cube.time, CASE WHEN orders IS NOT NULL THEN value END AS value FROM cube LEFT JOIN oc ON cube.cell_id = oc.cell_id AND cube.time = oc.time""")
def missing_copied_from_reference(t):
    return al.copy_missing(t.cube().select("cell_id", "time", "value"), orders_cube(t), reference_value="orders")


@query("day_mask_applied", f"""WITH {CUBE}, m AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, MAX(CAST(l_tax > 0.04 AS INTEGER)) AS m FROM lineitem GROUP BY 1, 2)
SELECT cube.cell_id, cube.time, CASE WHEN m = 1 THEN value END AS value FROM cube LEFT JOIN m ON cube.cell_id = m.cell_id AND cube.time = m.time""")
def day_mask_applied(t):
    mask = t.lineitem.select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("time"), (F.col("l_tax") > 0.04).cast("int").alias("mask"))
    return al.mask_by_table(t.cube().select("cell_id", "time", "value"), mask)


@query("axes_renamed", """SELECT s_suppkey AS lon, s_nationkey AS lat, s_name FROM supplier""")
def axes_renamed(t):
    return al.rename_axes(t.supplier.select(F.col("s_suppkey").alias("x"), F.col("s_nationkey").alias("y"), "s_name", F.lit(4326).alias("crs")))


@query("reanalysis_relabelled", f"""WITH {CUBE} SELECT cell_id, time + 1 AS time, value AS total_precipitation, value2 AS evaporation FROM cube""")
def reanalysis_relabelled(t):
    return al.reanalysis_names(t.cube().withColumnsRenamed({"value": "tp", "value2": "e"}))


# --- regridding ----------------------------------------------------------------------------------------

GRID_SPEC = GridSpec(-5.25, 32.25, 0.2, 0.25)
TARGET = """tgt AS (SELECT c_custkey AS cell_id, -5.25 + (c_custkey * 37 % 19) * 0.1::DOUBLE AS lat, 32.25 + (c_custkey * 11 % 23) * 0.1::DOUBLE AS lon FROM customer)"""


def targets(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("cell_id"), (F.lit(-5.25) + (k * 37 % 19) * F.lit(0.1)).alias("lat"), (F.lit(32.25) + (k * 11 % 23) * F.lit(0.1)).alias("lon"))


def yearly_grid(t):
    return with_coordinates(t.cube().groupBy("cell_id", F.trunc("time", "year").alias("time")).agg(F.avg("value").alias("value")))


YEARLY = f"""{GRID}, yg AS (SELECT cell_id // 10 AS r, cell_id % 10 AS c, CAST(DATE_TRUNC('year', time) AS DATE) AS time, AVG(value) AS value FROM grid GROUP BY ALL)"""


@query("regridded_nearest", f"""WITH {YEARLY}, {TARGET}, i AS (SELECT cell_id, CAST(ROUND((lat + 5.25) / 0.2::DOUBLE) AS BIGINT) AS r, CAST(ROUND((lon - 32.25) / 0.25::DOUBLE) AS BIGINT) AS c FROM tgt)
SELECT i.cell_id, time, ROUND(value, 6) AS value FROM i JOIN yg ON i.r = yg.r AND i.c = yg.c""")
def regridded_nearest(t):
    return regrid.regrid_nearest(yearly_grid(t), targets(t), GRID_SPEC).select("cell_id", "time", r6("value"))


BILINEAR = f"""{YEARLY}, {TARGET}, p AS (SELECT cell_id, (lat + 5.25) / 0.2::DOUBLE AS y0, (lon - 32.25) / 0.25::DOUBLE AS x0 FROM tgt),
 q AS (SELECT cell_id, CASE WHEN ABS(y0 - ROUND(y0)) < 1e-9 THEN ROUND(y0) ELSE y0 END AS y, CASE WHEN ABS(x0 - ROUND(x0)) < 1e-9 THEN ROUND(x0) ELSE x0 END AS x FROM p),
 w AS (SELECT cell_id, CAST(FLOOR(y) AS BIGINT) + dr AS r, CAST(FLOOR(x) AS BIGINT) + dc AS c, (CASE dr WHEN 1 THEN y - FLOOR(y) ELSE 1 - (y - FLOOR(y)) END) * (CASE dc WHEN 1 THEN x - FLOOR(x) ELSE 1 - (x - FLOOR(x)) END) AS w
  FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc))"""


@query("regridded_bilinear", f"""WITH {BILINEAR} SELECT w.cell_id, time, ROUND(SUM(w * value) / SUM(w), 6) AS value FROM w JOIN yg ON w.r = yg.r AND w.c = yg.c WHERE w > 0 GROUP BY 1, 2""")
def regridded_bilinear(t):
    return regrid.regrid_bilinear(yearly_grid(t), targets(t), GRID_SPEC).select("cell_id", "time", r6("value"))


@query("finer_onto_coarser", f"""WITH {YEARLY}, coarse AS (SELECT cell_id, -5.25 + (cell_id // 10) * 0.3::DOUBLE AS lat, 32.25 + (cell_id % 10) * 0.3::DOUBLE AS lon, time, value2 FROM
  (SELECT cell_id, CAST(DATE_TRUNC('year', time) AS DATE) AS time, AVG(value2) AS value2 FROM cube GROUP BY 1, 2)),
 p AS (SELECT DISTINCT cell_id, (lat + 5.25) / 0.2::DOUBLE AS y0, (lon - 32.25) / 0.25::DOUBLE AS x0 FROM coarse),
 q AS (SELECT cell_id, CASE WHEN ABS(y0 - ROUND(y0)) < 1e-9 THEN ROUND(y0) ELSE y0 END AS y, CASE WHEN ABS(x0 - ROUND(x0)) < 1e-9 THEN ROUND(x0) ELSE x0 END AS x FROM p),
 w AS (SELECT cell_id, CAST(FLOOR(y) AS BIGINT) + dr AS r, CAST(FLOOR(x) AS BIGINT) + dc AS c, (CASE dr WHEN 1 THEN y - FLOOR(y) ELSE 1 - (y - FLOOR(y)) END) * (CASE dc WHEN 1 THEN x - FLOOR(x) ELSE 1 - (x - FLOOR(x)) END) AS w
  FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc)),
 m AS (SELECT w.cell_id, time, SUM(w * value) / SUM(w) AS value FROM w JOIN yg ON w.r = yg.r AND w.c = yg.c WHERE w > 0 GROUP BY 1, 2)
SELECT coarse.cell_id, coarse.time, ROUND(value2, 6) AS value2, ROUND(value, 6) AS value FROM coarse JOIN m ON m.cell_id = coarse.cell_id AND m.time = coarse.time""")
def finer_onto_coarser(t):
    coarse = t.cube().groupBy("cell_id", F.trunc("time", "year").alias("time")).agg(F.avg("value2").alias("value2"))
    coarse = coarse.withColumn("lat", F.lit(-5.25) + F.floor(F.col("cell_id") / 10) * F.lit(0.3)).withColumn("lon", F.lit(32.25) + F.col("cell_id") % 10 * F.lit(0.3))
    fine = yearly_grid(t)
    out = regrid.onto_coarser(fine, coarse, GRID_SPEC, GridSpec(-5.25, 32.25, 0.3, 0.3), value_a="value", value_b="value2")
    return out.select("cell_id", "time", r6("value2"), r6("value"))


@query("majority_cover", f"""WITH {COVER_SQL}, k AS (SELECT p_partkey // 10 % 12 AS row, p_partkey % 7 AS col, code, COUNT(*) AS n FROM codes GROUP BY ALL)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, code FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY n DESC, code) = 1""")
def majority_cover(t):
    p = F.col("p_partkey")
    cover = cover_codes(t).withColumn("lat", (F.floor(p / 10) % 12).cast("double")).withColumn("lon", (p % 7).cast("double"))
    return regrid.regrid_majority(cover, GridSpec(0.0, 0.0, 1.0, 1.0))


RASTER = """ras AS (SELECT 'elevation' AS layer, p_partkey % 40 AS row, p_partkey % 50 AS col, MAX(p_size - 20)::DOUBLE AS value FROM part GROUP BY ALL
 UNION ALL SELECT 'slope1', p_partkey % 40, p_partkey % 50, MAX(p_size * 100)::DOUBLE FROM part GROUP BY ALL
 UNION ALL SELECT 'FOR_LAND', p_partkey % 40, p_partkey % 50, MAX(CASE WHEN p_size > 25 THEN p_retailprice END) FROM part GROUP BY ALL)"""


@query("soil_layers_looked_up", f"""WITH {RASTER}, c AS (SELECT s_suppkey AS cell_id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier),
 i AS (SELECT cell_id, ABS(ROUND_EVEN((lat + 0) / 0.25::DOUBLE, 0)::INTEGER) AS r, ROUND_EVEN((lon - 30) / 0.25::DOUBLE, 0)::INTEGER AS k FROM c),
 w AS (SELECT row, col, MAX(value) FILTER (layer = 'elevation') AS elevation, MAX(value) FILTER (layer = 'slope1') AS slope1, MAX(value) FILTER (layer = 'FOR_LAND') AS forest FROM ras GROUP BY ALL)
SELECT cell_id, CASE WHEN COALESCE(elevation, 0) >= 0 THEN COALESCE(elevation, 0) END AS elevation, ROUND(COALESCE(slope1, 0) / 10000, 6) AS slope1, ROUND(COALESCE(forest, 0), 6) AS "FOR_LAND" FROM i LEFT JOIN w ON row = r AND col = k""")
def soil_layers_looked_up(t):
    at = [(F.col("p_partkey") % 40).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col")]
    layers = [
        t.part.groupBy(*at).agg(F.max(F.col("p_size") - 20).cast("double").alias("value")).withColumn("layer", F.lit("elevation")),
        t.part.groupBy(*at).agg(F.max(F.col("p_size") * 100).cast("double").alias("value")).withColumn("layer", F.lit("slope1")),
        t.part.groupBy(*at).agg(F.max(F.when(F.col("p_size") > 25, F.col("p_retailprice"))).alias("value")).withColumn("layer", F.lit("FOR_LAND")),
    ]
    rasters = layers[0].unionByName(layers[1]).unionByName(layers[2])
    out = regrid.lookup_layers(t.cells(), rasters, 30, 0, 0.25, ["elevation", "slope1", "FOR_LAND"])
    return out.select("cell_id", "elevation", r6("slope1"), r6("FOR_LAND"))


# --- polygons ------------------------------------------------------------------------------------------

POLYGONS = """poly AS (SELECT n_nationkey AS region, n_regionkey AS country, 32.2 + n_nationkey % 5 * 0.45::DOUBLE AS x, -5.3 + n_nationkey // 5 * 0.37::DOUBLE AS y, 0.3 + n_regionkey * 0.1::DOUBLE AS s FROM nation),
cell AS (SELECT s_suppkey AS cell_id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier),
inside AS (SELECT cell_id, region, country FROM cell, poly WHERE lat > y AND lat <= y + s AND lon < x + s - 0.5 * (lat - y) AND lon >= x + 0.3 * (lat - y))"""


def polygons(t):
    """One quadrilateral per nation with slanted sides."""
    k, s = F.col("n_nationkey"), F.lit(0.3) + F.col("n_regionkey") * F.lit(0.1)
    x, y = F.lit(32.2) + k % 5 * F.lit(0.45), F.lit(-5.3) + F.floor(k / 5) * F.lit(0.37)

    def corner(lon, lat):
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = F.array(corner(x, y), corner(x + s, y), corner(x + s - s * 0.5, y + s), corner(x + s * 0.3, y + s))
    rings = t.nation.select(k.alias("region"), F.col("n_regionkey").alias("country"), F.lit(0).alias("ring_id"), ring.alias("points"))
    return spatial.polygon_edges(rings).join(t.nation.select(k.alias("region"), F.col("n_regionkey").alias("country")), "region")


@query("cells_in_regions", f"""WITH {POLYGONS} SELECT cell_id, region FROM inside""")
def cells_in_regions(t):
    return spatial.assign_region(t.cells(), polygons(t), band=0.5)


@query("rows_clipped_to_countries", f"""WITH {CUBE}, {POLYGONS} SELECT cell_id, time, value FROM cube WHERE cell_id IN (SELECT cell_id FROM inside WHERE country IN (1, 3))""")
def rows_clipped_to_countries(t):
    return spatial.clip_to_regions(t.cube(coordinates=True), polygons(t), countries=[1, 3]).select("cell_id", "time", "value")


@query("rows_outside_regions", f"""WITH {CUBE}, {POLYGONS} SELECT cell_id, time, value FROM cube WHERE cell_id NOT IN (SELECT cell_id FROM inside WHERE region IN (0, 7, 12))""")
def rows_outside_regions(t):
    return spatial.clip_to_regions(t.cube(coordinates=True), polygons(t), regions=[0, 7, 12], outside=True).select("cell_id", "time", "value")


ZONAL = f"""{FILLED}, zr AS (SELECT filled.*, s_nationkey AS region, -5.25 + (cell_id // 10) * 0.2::DOUBLE AS lat FROM filled JOIN supplier ON s_suppkey = cell_id)"""


def zones(t):
    return t.filled().join(t.cells().select("cell_id", "lat", F.col("s_nationkey").alias("region")), "cell_id")


@query("zonal_mean", f"""WITH {ZONAL} SELECT region, time, ROUND(AVG(value), 6) AS mean FROM zr GROUP BY 1, 2""")
def zonal_mean(t):
    return spatial.zonal_mean(zones(t)).withColumn("mean", r6("mean"))


@query("zonal_mean_weighted", f"""WITH {ZONAL} SELECT region, time, ROUND(SUM(value * COS(RADIANS(lat))) / SUM(CASE WHEN value IS NOT NULL THEN COS(RADIANS(lat)) END), 6) AS mean FROM zr GROUP BY 1, 2""")
def zonal_mean_weighted(t):
    return spatial.zonal_mean(zones(t), weighted=True).withColumn("mean", r6("mean"))


@query("zonal_mean_counting_missing", f"""WITH {ZONAL} SELECT region, time, ROUND(COALESCE(SUM(value), 0) / COUNT(*), 6) AS mean FROM zr GROUP BY 1, 2""")
def zonal_mean_counting_missing(t):
    return spatial.zonal_mean(zones(t), strict=True).withColumn("mean", r6("mean"))


@query("regional_mean_on_cells", f"""WITH {ZONAL} SELECT cell_id, time, ROUND(AVG(value) OVER (PARTITION BY region, time), 6) AS region_mean FROM zr""")
def regional_mean_on_cells(t):
    return spatial.regional_mean_on_cells(zones(t)).select("cell_id", "time", r6("region_mean"))


@query("nearest_in_space", f"""WITH {GRID}, al AS (SELECT d.time, c.cell_id, c.lat, c.lon, g.value FROM (SELECT DISTINCT time FROM grid) d CROSS JOIN (SELECT DISTINCT cell_id, lat, lon FROM grid) c LEFT JOIN grid g ON g.cell_id = c.cell_id AND g.time = d.time),
 n AS (SELECT h.cell_id, h.time, ARG_MIN(k.value, {{'d': ROUND(POW(h.lat - k.lat, 2) + POW(h.lon - k.lon, 2), 9), 'y': k.lat, 'x': k.lon}}) AS value FROM al h JOIN al k ON h.time = k.time WHERE h.value IS NULL AND k.value IS NOT NULL GROUP BY 1, 2)
SELECT al.cell_id, al.time, COALESCE(al.value, n.value) AS value FROM al LEFT JOIN n ON n.cell_id = al.cell_id AND n.time = al.time""")
def nearest_in_space(t):
    cube = t.cube()
    days = cube.select("time").distinct()
    cells = cube.select("cell_id").distinct()
    # Every cell of every day: the calendar expands per cell through its own first and last day.
    from drygrid.operators.temporal import fill_calendar

    ends = days.agg(F.struct(F.min("time").alias("a"), F.max("time").alias("b"))).scalar()
    full = fill_calendar(cube.select("cell_id", "time", "value"), start=ends["a"], end=ends["b"]).join(days, "time", "left_semi").join(cells, "cell_id", "left_semi")
    return spatial.fill_nearest_in_space(with_coordinates(full)).select("cell_id", "time", "value")

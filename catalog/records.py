"""Text, JSON, page and file-name sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUBE, query, r6
from drygrid.sources import tables as tb, text as tx


@query("page_links", r"""WITH l AS (SELECT page_id, url, UNNEST(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages), p AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS plain FROM l)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^\w+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(plain, '^(\w+://[^/]+)', 1) || href
 ELSE CASE WHEN regexp_full_match(plain, '\w+://[^/]+') THEN plain || '/' ELSE regexp_replace(plain, '[^/]*$', '') END || href END AS address FROM p""")
def page_links(t):
    return tx.page_links(t.pages).select("page_id", "href", "address")


@query("page_links_with_suffix", r"""SELECT page_id, href FROM (SELECT page_id, UNNEST(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) WHERE ends_with(href, 'n')""")
def page_links_with_suffix(t):
    return tx.page_links(t.pages, suffix="n").select("page_id", "href")


@query("json_scalars", """SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS k, COUNT(*) AS n FROM events GROUP BY 1""")
def json_scalars(t):
    return t.events.groupBy("event_type").agg(F.sum(tx.json_numbers(F.col("props"), "k")).alias("k"), F.count(F.lit(1)).alias("n"))


POINTS = """pt AS (SELECT user_id, event_type, CAST(ts AS DATE) AS time, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM events GROUP BY 1, 2, 3)"""


def point_documents(t):
    """One nested document per user: parameter -> day -> value, as a point service returns it."""
    daily = t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("time")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("value"))
    days = daily.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("time", "yyyyMMdd"), "value"))).alias("days"))
    meta = F.struct(F.lit("mm").alias("units"), F.col("event_type").alias("longname"))
    docs = days.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "days"))).alias("parameter"),
                                       F.map_from_entries(F.collect_list(F.struct(F.col("event_type"), meta))).alias("parameters"))
    body = F.to_json(F.struct(
        F.struct(F.array(F.col("user_id").cast("double"), F.lit(35.5), F.lit(100.0)).alias("coordinates")).alias("geometry"),
        F.struct("parameter").alias("properties"), "parameters"))
    return docs.select(F.from_json(body, tx.POINT_SCHEMA).alias("d")).select("d.*")


@query("point_service_series", f"""WITH {POINTS} SELECT CAST(user_id AS DOUBLE) AS lat, 35.5::DOUBLE AS lon, 100.0::DOUBLE AS elevation, event_type AS parameter, time, ROUND(value, 6) AS value, 'mm' AS units, event_type AS long_name FROM pt""")
def point_service_series(t):
    return tx.point_series(point_documents(t)).withColumn("value", r6("value"))


EVENT_TYPES = ('click', 'error', 'purchase', 'signup', 'view')
WIDE = ", ".join(f"ROUND(MAX(value) FILTER (event_type = '{n}'), 6) AS {n}" for n in EVENT_TYPES)


@query("point_service_wide", f"""WITH {POINTS} SELECT CAST(user_id AS DOUBLE) AS lat, time, {WIDE} FROM pt GROUP BY 1, 2""")
def point_service_wide(t):
    wide = tx.pivot_parameters(tx.point_series(point_documents(t)), EVENT_TYPES, {"click": ("1", "clicks")})
    return wide.select("lat", "time", *[r6(n) for n in EVENT_TYPES])


def grid_texts(t):
    """Parts as texts of 20 x 10 ASCII grids, 200 parts each; 7 is the no-data token."""
    k = F.col("p_partkey")
    lines = t.part.groupBy(F.floor(k / 200).alias("g"), F.floor(k % 200 / 10).alias("r")).agg(F.array_sort(F.collect_list(F.struct((k % 10).alias("c"), "p_size"))).alias("v"))
    lines = lines.select("g", "r", F.array_join(F.transform("v", lambda x: x["p_size"].cast("string")), " ").alias("line"))
    grids = lines.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"))
    head = F.lit("ncols 10\nnrows 20\nxllcorner -180\nyllcorner -90\ncellsize 0.25\nNODATA_value 7\n")
    return grids.select(F.col("g").cast("string").alias("layer"), F.concat(head, F.array_join(F.col("l.line"), "\n")).alias("value"))


@query("ascii_grid_cells", """SELECT CAST(p_partkey // 200 AS VARCHAR) AS layer, CAST(p_partkey % 200 // 10 AS INTEGER) AS row, CAST(p_partkey % 10 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 7""")
def ascii_grid_cells(t):
    return tx.parse_ascii_grid(grid_texts(t)).select("layer", "row", "col", "value")


@query("times_from_file_names", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 6 HOUR WHEN 1 THEN o_orderdate END AS time, CAST(o_orderdate AS DATE) AS noon_day FROM orders""")
def times_from_file_names(t):
    stamp, day = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyy_MM_dd")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/in/MSG4-"), stamp, F.lit("060000.nc"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/in/"), day, F.lit(".tif"))).otherwise(F.lit("/in/readme.txt"))
    noon = tb.noon_from_name(F.concat(F.lit("/in/NDVImax_"), stamp, F.lit("1200.nc")))
    return t.orders.select("o_orderkey", tb.time_from_name(name).cast("timestamp_ntz").alias("time"), noon.cast("date").alias("noon_day"))


@query("product_and_latency_from_names", """SELECT l_orderkey, l_linenumber, 'P' || l_returnflag AS product, 'spi_gamma_' || CAST(l_linenumber * 30 AS VARCHAR) AS index_name, l_linenumber * 30 AS latency FROM lineitem""")
def product_and_latency_from_names(t):
    path = F.concat(F.lit("/data/P"), F.col("l_returnflag"), F.lit("_spi_gamma_"), (F.col("l_linenumber") * 30).cast("string"), F.lit(".nc"))
    product, index, latency = tb.spi_name_parts(path)
    return t.lineitem.select("l_orderkey", "l_linenumber", product.alias("product"), index.alias("index_name"), latency.alias("latency"))


@query("ten_day_product_addresses", f"""WITH {CUBE} SELECT DISTINCT MAKE_DATE(YEAR(time), MONTH(time), CASE WHEN DAY(time) <= 10 THEN 1 WHEN DAY(time) <= 20 THEN 11 ELSE 21 END) AS time,
 'https://data.example.org/' || STRFTIME(MAKE_DATE(YEAR(time), MONTH(time), CASE WHEN DAY(time) <= 10 THEN 1 WHEN DAY(time) <= 20 THEN 11 ELSE 21 END), '%Y/%m/%d/S10_%Y%m%d') || '.zip' AS address FROM cube""")
def ten_day_product_addresses(t):
    from drygrid.functions.calendar import dekad

    return tx.with_address(t.cube().select(dekad(F.col("time")).alias("time")).distinct(), "https://data.example.org/{year}/{month}/{day}/S10_{date}.zip")


@query("scan_in_box_and_period", """SELECT l_orderkey, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
def scan_in_box_and_period(t):
    from drygrid.operators.subset import between_times

    rows = tb.read_files(t.spark, f"{t.folder}/lineitem.parquet")
    days = rows.where("l_shipdate >= timestamp_ntz'1998-01-01' AND l_shipdate < timestamp_ntz'1999-01-01'").withColumn("time", F.to_date("l_shipdate"))
    return between_times(days, "1998-01-01", "1998-12-31").select("l_orderkey", "l_quantity")


@query("stored_subset", f"""WITH {CUBE}, g AS (SELECT cell_id, time, COALESCE(value2, -1) AS value2, COALESCE(value, -1) AS value, -5.25 + (cell_id // 10) * 0.2::DOUBLE AS lat, 32.25 + (cell_id % 10) * 0.25::DOUBLE AS lon FROM cube WHERE time BETWEEN DATE '1997-07-05' AND DATE '1998-12-31')
SELECT cell_id, time, value2, value FROM g WHERE lat IN (SELECT DISTINCT lat FROM g ORDER BY lat DESC LIMIT 8) AND lon IN (SELECT DISTINCT lon FROM g ORDER BY lon LIMIT 8)""")
def stored_subset(t):
    return tb.stored_subset(t.cube(coordinates=True), "1998-01-01", "1998-12-31", 180, ["value2", "value"], pixels=8, fill=-1.0).drop("lat", "lon")

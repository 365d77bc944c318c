"""End-to-end compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.alignment import GRID_SPEC, RASTER, targets
from catalog.columns import COVER_SQL, cover_codes
from catalog.drought import SCORED, scored
from catalog.formulas import smoother
from catalog.registry import CUBE, FILLED, FORECAST, query, r6, with_coordinates
from catalog.resampling import GAP_LENGTHS, hourly
from catalog.selection import MASK, cloud_mask
from catalog.verification import BLUR
from drygrid.operators import climatology as clim, temporal as tm
from drygrid.plans import datasets, hydrology, vegetation, verification


@query("daily_hydrology_on_grid", """WITH h AS (SELECT user_id AS cell_id, DATE_TRUNC('hour', ts) AS time, SUM(CAST(ROUND(value * 100) AS BIGINT)) / 100000.0::DOUBLE AS tp, MAX(value) AS t2m FROM events GROUP BY 1, 2),
 s AS (SELECT cell_id, time, LAG(tp) OVER w AS tp, LAG(t2m) OVER w AS t2m FROM h WINDOW w AS (PARTITION BY cell_id ORDER BY time)),
 d AS (SELECT cell_id // 10 AS r, cell_id % 10 AS c, CAST(time AS DATE) AS time, COALESCE(SUM(tp), 0) AS tp, MIN(t2m) AS lo, MAX(t2m) AS hi FROM s GROUP BY ALL),
 tgt AS (SELECT c_custkey AS cell_id, (c_custkey * 37 % 19) * 0.1::DOUBLE / 0.2::DOUBLE AS y0, (c_custkey * 11 % 23) * 0.1::DOUBLE / 0.25::DOUBLE AS x0 FROM customer),
 q AS (SELECT cell_id, CASE WHEN ABS(y0 - ROUND(y0)) < 1e-9 THEN ROUND(y0) ELSE y0 END AS y, CASE WHEN ABS(x0 - ROUND(x0)) < 1e-9 THEN ROUND(x0) ELSE x0 END AS x FROM tgt),
 w AS (SELECT cell_id, CAST(FLOOR(y) AS BIGINT) + dr AS r, CAST(FLOOR(x) AS BIGINT) + dc AS c, (CASE dr WHEN 1 THEN y - FLOOR(y) ELSE 1 - (y - FLOOR(y)) END) * (CASE dc WHEN 1 THEN x - FLOOR(x) ELSE 1 - (x - FLOOR(x)) END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc))
SELECT w.cell_id, time, ROUND(SUM(w * tp) / SUM(w), 9) AS tp, ROUND(SUM(w * lo) / SUM(w) FILTER (lo IS NOT NULL), 6) AS t2m_min, ROUND(SUM(w * hi) / SUM(w) FILTER (hi IS NOT NULL), 6) AS t2m_max FROM w JOIN d ON d.r = w.r AND d.c = w.c WHERE w > 0 GROUP BY 1, 2""")
def daily_hydrology_on_grid(t):
    out = hydrology.hydro_variables(with_coordinates(hourly(t)), targets(t), GRID_SPEC, ["tp"], ["t2m"])
    return out.select("cell_id", "time", F.round("tp", 9).alias("tp"), r6("t2m_min"), r6("t2m_max"))


@query("prepared_inputs", f"""WITH {CUBE}, c AS (SELECT * FROM cube WHERE time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND 32.25 + (cell_id % 10) * 0.25::DOUBLE BETWEEN 32 AND 34.1 AND -5.25 + (cell_id // 10) * 0.2::DOUBLE BETWEEN -6 AND -3.9),
 dy AS (SELECT cell_id, CAST(g.d AS DATE) AS time FROM (SELECT DISTINCT cell_id FROM c), generate_series(DATE '1996-01-01', DATE '1999-12-31', INTERVAL 1 DAY) g(d)), f AS (SELECT dy.cell_id, dy.time, value FROM dy LEFT JOIN c ON c.cell_id = dy.cell_id AND c.time = dy.time),
 g AS (SELECT *, COUNT(value) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS k, COUNT(value) OVER (PARTITION BY cell_id ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS m FROM f),
 p AS (SELECT *, MAX(value) OVER (PARTITION BY cell_id, k) AS pv, MIN(time) OVER (PARTITION BY cell_id, k) AS pt, MAX(value) OVER (PARTITION BY cell_id, m) AS nv, MAX(time) OVER (PARTITION BY cell_id, m) AS nt FROM g),
 i AS (SELECT cell_id, time, CASE WHEN value IS NOT NULL THEN value ELSE pv + (nv - pv) * (time - pt) / (nt - pt) END AS value FROM p), e AS (SELECT MIN(value) AS a, MAX(value) AS b FROM i)
SELECT cell_id, time, ROUND(COALESCE((value - a) / (b - a), -1), 6) AS value FROM i, e WHERE cell_id // 10 IN (SELECT DISTINCT cell_id // 10 AS r FROM i ORDER BY r DESC LIMIT 5) AND cell_id % 10 IN (SELECT DISTINCT cell_id % 10 AS k FROM i ORDER BY k LIMIT 5)""")
def prepared_inputs(t):
    out = hydrology.prepare_inputs(t.cube(coordinates=True), ["value"], "1996-01-01", "1999-12-31", lon=(32.0, 34.1), lat=(-6.0, -3.9), crop=5)
    return out.select("cell_id", "time", r6("value"))


@query("features_with_dry_target", f"""WITH {CUBE}, {COVER_SQL} SELECT cube.cell_id, time, value, CASE WHEN code IN (80, 200) THEN NULL ELSE value2 END AS ndvi FROM cube LEFT JOIN codes ON p_partkey = cell_id""")
def features_with_dry_target(t):
    cube = t.cube()
    cover = cover_codes(t).withColumnRenamed("p_partkey", "cell_id")
    return hydrology.features_and_target(cube.select("cell_id", "time", "value"), cube.withColumnRenamed("value2", "ndvi"), cover)


PAIR = f"""{FILLED}, ro AS (SELECT cell_id, time, CASE WHEN COUNT(*) OVER w = 30 THEN SUM(COALESCE(value, 0)) OVER w END AS a, CASE WHEN COUNT(*) OVER w = 30 THEN SUM(COALESCE(value2, 0)) OVER w END AS b FROM filled WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
zz AS (SELECT cell_id, time, (a - AVG(a) OVER m) / NULLIF(STDDEV_POP(a) OVER m, 0) AS ref, (b - AVG(b) OVER m) / NULLIF(STDDEV_POP(b) OVER m, 0) AS prod FROM ro WINDOW m AS (PARTITION BY cell_id, MONTH(time)))"""


def two_indices(t):
    filled = t.filled(fill=0.0)

    def index(column):
        rolled = filled.withColumn("value", tm.rolling(column, 30))
        return with_coordinates(clim.standardised(rolled, by="month", out="spi").select("cell_id", "time", "spi"))

    return index("value"), index("value2")


@query("products_matched", f"""WITH {PAIR}, f AS (SELECT cell_id, CAST(COALESCE(CASE WHEN ref IS NOT NULL THEN prod END <= -1, FALSE) AS INTEGER) AS tg, CAST(COALESCE(ref <= -1, FALSE) AS INTEGER) AS rf FROM zz),
 e AS (SELECT cell_id, CAST(tg = rf AS DOUBLE) AS a, CAST(tg = 1 AND tg <> rf AS DOUBLE) AS b, CAST(rf = 1 AND tg <> rf AS DOUBLE) AS c FROM f)
SELECT cell_id, ROUND(AVG(a / NULLIF(a + c, 0)), 6) AS pod, ROUND(AVG(b / NULLIF(b + a, 0)), 6) AS far, ROUND(AVG(2 * a / NULLIF(2 * a + b + c, 0)), 6) AS accuracy FROM e GROUP BY 1""")
def products_matched(t):
    reference, product = two_indices(t)
    out = verification.match_products(product, reference, GRID_SPEC, 30, dry_limit=-1.0, tasks=t.tasks())
    return out.select("cell_id", r6("pod"), r6("far"), r6("accuracy"))


@query("scores_by_cover", f"""WITH {SCORED}, {COVER_SQL}, v AS (SELECT cell_id, time, 100 * (value - MIN(value) OVER w) / NULLIF(MAX(value) OVER w - MIN(value) OVER w, 0) AS vci FROM cube WINDOW w AS (PARTITION BY cell_id, DAYOFYEAR(time))),
 b AS (SELECT v.cell_id, v.time, CASE WHEN vci IS NOT NULL THEN CAST(vci < 10 AS INTEGER) END AS obs, CASE WHEN spi IS NOT NULL THEN CAST(spi <= -1 AS INTEGER) END AS fc FROM v JOIN z ON z.cell_id = v.cell_id AND z.time = v.time),
 l AS (SELECT p_partkey, CASE WHEN code BETWEEN 111 AND 116 THEN 11 WHEN code BETWEEN 121 AND 126 THEN 12 ELSE code END AS level1 FROM codes),
 k AS (SELECT level1, time, COUNT(*) FILTER (obs = 1 AND fc = 1) AS h, COUNT(*) FILTER (obs = 1 AND fc = 0) AS m, COUNT(*) FILTER (obs = 0 AND fc = 1) AS fa, COUNT(*) FILTER (obs = 0 AND fc = 0) AS cn, AVG(POW(fc - obs, 2)) AS mse FROM b JOIN l ON p_partkey = cell_id WHERE level1 NOT IN (0, 70, 80, 200) GROUP BY 1, 2)
SELECT level1, ROUND(AVG((h + cn) / NULLIF(h + m + fa + cn, 0)), 6) AS accuracy_m, ROUND(AVG(fa / NULLIF(cn + fa, 0)), 6) AS far_m, ROUND(AVG(h / NULLIF(h + m, 0)), 6) AS pod_m, ROUND(AVG(SQRT(mse)), 6) AS rmse_m, ROUND(AVG(mse), 6) AS mse_m, ROUND(AVG((h + fa) / NULLIF(h + m, 0)), 6) AS bias_m FROM k GROUP BY 1""")
def scores_by_cover(t):
    vci = clim.condition_index(t.cube()).select("cell_id", "time", "vci")
    cover = cover_codes(t).withColumnRenamed("p_partkey", "cell_id")
    out = verification.scores_by_cover(vci, scored(t), cover, forecast_limit=-1.0)
    return out.select("level1", *[r6(c) for c in out.columns if c != "level1"])


@query("day_distribution_by_cover", f"""WITH {CUBE}, {COVER_SQL}, l AS (SELECT p_partkey, CASE WHEN code BETWEEN 111 AND 116 THEN 11 WHEN code BETWEEN 121 AND 126 THEN 12 ELSE code END AS level1 FROM codes)
SELECT level1, STRFTIME(time, '%m-%d') AS month_day, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25, ROUND(MEDIAN(value), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75
FROM cube JOIN l ON p_partkey = cell_id WHERE level1 NOT IN (0, 70, 80, 200) GROUP BY 1, 2""")
def day_distribution_by_cover(t):
    from drygrid.functions.cover import NOT_LAND, level_1

    classes = cover_codes(t).select(F.col("p_partkey").alias("cell_id"), level_1(F.col("code")).alias("level1")).where(~F.col("level1").isin(*NOT_LAND))
    out = clim.day_of_year_distribution(t.cube().join(classes, "cell_id"), by=["level1"], key="month_day")
    return out.select("level1", "month_day", "n", r6("mean"), r6("q25"), r6("median"), r6("q75"))


@query("index_soil_dataset", f"""WITH {CUBE}, {RASTER}, c AS (SELECT DISTINCT cell_id, -5.25 + (cell_id // 10) * 0.2::DOUBLE AS lat, 32.25 + (cell_id % 10) * 0.25::DOUBLE AS lon FROM cube),
 wk AS (SELECT cell_id, CAST(time + INTERVAL (CASE WHEN DAYOFWEEK(time) = 0 THEN 0 ELSE 7 - DAYOFWEEK(time) END) DAY AS DATE) AS time, AVG(value) AS ndvi, AVG(value2) AS spi FROM cube WHERE time BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1, 2),
 i AS (SELECT cell_id, ABS(ROUND_EVEN((lat + 0) / 0.25::DOUBLE, 0)::INTEGER) AS r, ROUND_EVEN((lon - 30) / 0.25::DOUBLE, 0)::INTEGER AS k FROM c),
 w AS (SELECT row, col, MAX(value) FILTER (layer = 'elevation') AS elevation, MAX(value) FILTER (layer = 'slope1') AS slope1 FROM ras GROUP BY ALL)
SELECT wk.cell_id, time, ROUND(ndvi, 6) AS ndvi, ROUND(spi, 6) AS spi, CASE WHEN COALESCE(elevation, 0) >= 0 THEN COALESCE(elevation, 0) END AS elevation, ROUND(COALESCE(slope1, 0) / 10000, 6) AS slope1 FROM wk JOIN i ON i.cell_id = wk.cell_id LEFT JOIN w ON row = r AND col = k""")
def index_soil_dataset(t):
    cube = t.cube(coordinates=True)
    at = [(F.col("p_partkey") % 40).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col")]
    rasters = t.part.groupBy(*at).agg(F.max(F.col("p_size") - 20).cast("double").alias("value")).withColumn("layer", F.lit("elevation")).unionByName(
        t.part.groupBy(*at).agg(F.max(F.col("p_size") * 100).cast("double").alias("value")).withColumn("layer", F.lit("slope1")))
    out = datasets.index_soil_dataset(
        cube.withColumnRenamed("value", "ndvi"), {"spi": (cube.withColumnRenamed("value2", "spi"), GRID_SPEC)}, rasters, (30, 0, 0.25), ["elevation", "slope1"], "1996-01-01", "1997-12-31")
    return out.select("cell_id", "time", r6("ndvi"), r6("spi"), "elevation", r6("slope1"))


@query("events_per_product", """WITH d AS (SELECT l_returnflag AS product, 30 AS latency, l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
 z AS (SELECT *, (v - AVG(v) OVER w) / NULLIF(STDDEV_POP(v) OVER w, 0) AS spi FROM d WINDOW w AS (PARTITION BY product, cell_id)), f AS (SELECT *, CASE WHEN spi >= -0.9 THEN 1 ELSE 0 END AS calm FROM z WHERE time BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'),
 i AS (SELECT *, SUM(calm) OVER (PARTITION BY product, cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM f), e AS (SELECT product, latency, cell_id, run, MIN(time) AS time, ABS(SUM(spi)) AS severity, COUNT(*) AS duration FROM i WHERE calm = 0 AND spi IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT product, latency, cell_id, time, ROUND(severity, 6) AS severity, duration FROM e""")
def events_per_product(t):
    from pyspark.sql import Window

    daily = t.lineitem.groupBy(F.col("l_returnflag").alias("product"), F.lit(30).alias("latency"), F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("v"))
    w = Window.partitionBy("product", "latency", "cell_id")
    index = daily.withColumn("spi", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)))
    return datasets.events_per_product(index, start="1995-06-01", end="2000-12-31", threshold=-0.9).select("product", "latency", "cell_id", "time", r6("severity"), "duration")


DATES = """v AS (SELECT * FROM cube WHERE {valid}), d AS (SELECT time, ROW_NUMBER() OVER (ORDER BY time) AS r, COUNT(*) OVER () AS n FROM (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM v))"""


@query("training_tables", f"""WITH {CUBE}, {DATES.format(valid="cell_id % 11 <> 4")},
 t AS (SELECT time, CASE WHEN r <= ROUND_EVEN(0.7::DOUBLE * n, 0) THEN 'train' WHEN r <= ROUND_EVEN(0.7::DOUBLE * n, 0) + ROUND_EVEN((1 - 0.7::DOUBLE) * 0.333::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM d),
 w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY time) - 1 AS i, COUNT(*) OVER (PARTITION BY split) AS n FROM t),
 l AS (SELECT cell_id, split, i - 10 AS sample_id, time AS origin, MAX(i - 10) OVER (PARTITION BY split) AS last FROM w, (SELECT DISTINCT cell_id FROM v) WHERE i >= 10 AND i + 5 < n),
 y AS (SELECT l.*, COALESCE(v.value, -1) AS y FROM l LEFT JOIN v ON v.cell_id = l.cell_id AND v.time = l.origin + 5),
 p AS (SELECT *, sample_id AS position FROM y UNION ALL SELECT y.*, sample_id + k FROM y, range(1, 32) g(k) WHERE sample_id = last AND k <= (32 - (last + 1) % 32) % 32)
SELECT cell_id, split, sample_id, origin, position, position // 32 AS batch_id, ROUND(y, 6) AS y FROM p""")
def training_tables(t):
    water = t.cells().where("cell_id % 11 = 4")
    out = datasets.training_tables(t.cube(), ["value2"], "value", 10, 5, water=water, tasks=t.tasks())
    return out.select("cell_id", "split", "sample_id", "origin", "position", "batch_id", r6(F.col("y")[0].cast("double"), "y"))


@query("training_tables_by_fold", f"""WITH {CUBE}, {DATES.format(valid="true")}, f AS (SELECT s // 365 AS fold, s FROM (SELECT MAX(n) AS n FROM d), range(0, n - 1095 + 1, 365) r(s)),
 t AS (SELECT d.time, CAST(fold AS INTEGER) AS fold, CASE WHEN r - 1 < s + 730 THEN 'train' ELSE 'test' END AS part FROM d JOIN f ON r - 1 >= s AND r - 1 < s + 1095),
 w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, part ORDER BY time) - 1 AS i, COUNT(*) OVER (PARTITION BY fold, part) AS n FROM t),
 l AS (SELECT cell_id, fold, part, i - 10 AS sample_id, time AS origin, MAX(i - 10) OVER (PARTITION BY fold, part) AS last FROM w, (SELECT DISTINCT cell_id FROM v) WHERE i >= 10 AND i + 5 < n),
 p AS (SELECT *, sample_id AS position FROM l UNION ALL SELECT l.*, sample_id + k FROM l, range(1, 32) g(k) WHERE sample_id = last AND k <= (32 - (last + 1) % 32) % 32)
SELECT cell_id, fold, part, sample_id, origin, position, position // 32 AS batch_id FROM p""")
def training_tables_by_fold(t):
    out = datasets.training_tables(t.cube(), ["value2"], "value", 10, 5, folds=(730, 365, 365), tasks=t.tasks())
    return out.select("cell_id", "fold", "part", "sample_id", "origin", "position", "batch_id")


def scenes(t):
    """One scene row per supplier, day and slot with the satellite and time in its file name."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("cell_id"), "l_linenumber", F.concat(F.lit("MSG"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("product_name"),
        F.concat(F.lit("/in/"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("120000.nc")).alias("file_path"),
        (F.col("l_discount") + 1).alias("channel_1"), (F.col("l_tax") + 1).alias("channel_2"))
    return rows.groupBy("cell_id", "file_path").agg(*[F.min_by(c, F.struct("l_linenumber", "channel_1", "channel_2")).alias(c) for c in ("product_name", "channel_1", "channel_2")])


SCENES = """r AS (SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, 'MSG' || CAST(ln % 4 + 1 AS VARCHAR) AS sat, d, x FROM (SELECT l_suppkey, l_shipdate, UNNEST(MIN({'l': l_linenumber, 'd': l_discount + 1, 'x': l_tax + 1})) FROM lineitem GROUP BY 1, 2) q(l_suppkey, l_shipdate, ln, d, x)),
 irr AS (SELECT * FROM (VALUES ('MSG1', 65.2296::DOUBLE, 73.1869::DOUBLE), ('MSG2', 65.2065, 73.0127), ('MSG3', 65.5148, 73.1807), ('MSG4', 65.2656, 73.1692)) v(sat, i6, i8)),
 ndvi AS (SELECT cell_id, time, (x / i8 - d / i6) / (x / i8 + d / i6) AS ndvi FROM r JOIN irr ON irr.sat = r.sat)"""


@query("ndvi_from_scenes", f"""WITH {SCENES} SELECT cell_id, time, ROUND(ndvi, 6) AS ndvi FROM ndvi""")
def ndvi_from_scenes(t):
    return vegetation.ndvi_from_reflectance(scenes(t)).select("cell_id", F.to_date("time").alias("time"), r6("ndvi"))


def calendar_of(source: str) -> str:
    """A daily calendar ``filled`` of ``value`` from the first to the last row of each cell in ``source``."""
    return f"""days AS (SELECT cell_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time FROM (SELECT cell_id, MIN(time) AS a, MAX(time) AS b FROM {source} GROUP BY 1)),
 filled AS (SELECT d.cell_id, d.time, c.value FROM days d LEFT JOIN {source} c ON c.cell_id = d.cell_id AND c.time = d.time)"""


@query("smoothed_ndvi", f"""WITH RECURSIVE {SCENES}, {MASK}, clear AS (SELECT ndvi.cell_id, ndvi.time, CASE WHEN m IS NULL OR m <> 2 THEN ndvi END AS value FROM ndvi JOIN mask ON mask.cell_id = ndvi.cell_id AND mask.time = ndvi.time),
 {calendar_of('clear')}, {GAP_LENGTHS}, {smoother('filled', 'value', 10.0)}
SELECT cell_id, time, CASE WHEN value IS NOT NULL THEN COALESCE(ended, 0) WHEN last THEN len END AS streaks, CASE WHEN value IS NULL THEN len ELSE 0 END AS quality_flag,
 CASE WHEN value IS NOT NULL OR len <= 45 THEN ROUND(smoothed, 6) END AS smoothed FROM s JOIN curve USING (cell_id, time)""")
def smoothed_ndvi(t):
    out = vegetation.smoothed_ndvi(scenes(t), cloud_mask(t), lam=10.0, max_gap=45, tasks=t.tasks())
    return out.select("cell_id", "time", "streaks", "quality_flag", r6("smoothed"))


@query("vegetation_condition", f"""WITH RECURSIVE {CUBE}, {MASK}, {COVER_SQL}, raw AS (SELECT cube.cell_id, cube.time, CASE WHEN m IN (0, 1) AND (code IS NULL OR code NOT IN (80, 200)) THEN (value2 - value) / NULLIF(value2 + value, 0) END AS x
  FROM cube LEFT JOIN mask ON cube.cell_id = mask.cell_id AND cube.time = mask.time LEFT JOIN codes ON p_partkey = cube.cell_id),
 clear AS (SELECT cell_id, time, CASE WHEN x BETWEEN -1 AND 1 THEN x END AS value FROM raw), {calendar_of('clear')}, {smoother('filled', 'value', 1.0)},
 c AS (SELECT cell_id, time, CASE WHEN smoothed BETWEEN -1 AND 1 THEN smoothed END AS x FROM curve),
 v AS (SELECT *, 100::DOUBLE * ((x - MIN(x) OVER w) / NULLIF(MAX(x) OVER w - MIN(x) OVER w, 0)) AS vci FROM c WINDOW w AS (PARTITION BY cell_id, DAYOFYEAR(time)))
SELECT cell_id, time, ROUND(x, 6) AS smoothed, ROUND(vci, 6) AS vci, CASE WHEN vci IS NOT NULL THEN CAST(vci < 10 AS INTEGER) END AS low_condition FROM v""")
def vegetation_condition(t):
    bands = t.cube().withColumnsRenamed({"value": "channel_1", "value2": "channel_2"})
    cover = cover_codes(t).withColumnRenamed("p_partkey", "cell_id")
    out = vegetation.vegetation_condition(bands, cloud_mask(t), cover, tasks=t.tasks())
    return out.select("cell_id", "time", r6("smoothed"), r6("vci"), "low_condition")


REPORT = f"""{FORECAST}, line AS (SELECT horizon, REGR_SLOPE(y, y_pred) AS slope, REGR_INTERCEPT(y, y_pred) AS base FROM fc GROUP BY 1),
 c AS (SELECT fc.horizon, valid_date, cell_id, y, y_pred * slope + base AS p, mask FROM fc JOIN line ON line.horizon = fc.horizon),
 single AS (SELECT horizon, SQRT(SUM(COALESCE((p - y) * (p - y), 0) * mask) / SUM(mask)) AS rmse, 1 - SUM((y - p) * (y - p)) / (VAR_POP(y) FILTER (y IS NOT NULL AND p IS NOT NULL) * COUNT(y) FILTER (y IS NOT NULL AND p IS NOT NULL)) AS nse FROM c GROUP BY 1),
 im AS (SELECT {{'h': horizon, 'd': valid_date}} AS image, cell_id // 10 AS row, cell_id % 10 AS col, COALESCE(p, 0) AS a, COALESCE(y, 0) AS b FROM c), {BLUR},
 per AS (SELECT image.h AS horizon, AVG(s) AS s FROM sm GROUP BY image), alike AS (SELECT horizon, AVG(s) AS ssim FROM per GROUP BY 1),
 ranks AS (SELECT horizon, QUANTILE_CONT(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM c GROUP BY 1),
 placed AS (SELECT c.horizon, y, p, b, LEAST(len(list_filter(b, lambda x: x <= y)) - 1, 9) AS band FROM c JOIN ranks ON ranks.horizon = c.horizon WHERE y IS NOT NULL),
 bands AS (SELECT horizon, band / 10 AS percentile, ANY_VALUE(b)[ANY_VALUE(band) + 1] AS lower, SQRT(AVG((y - p) * (y - p))) AS rmse, 1 / (2 - (1 - SUM((y - p) * (y - p)) / NULLIF(VAR_POP(y) * COUNT(y), 0))) AS nse, AVG(y - p) AS bias FROM placed GROUP BY horizon, band)"""


@query("forecast_report", f"""WITH {REPORT}, o AS (SELECT horizon, 'rmse' AS metric, NULL::DOUBLE AS percentile, NULL::DOUBLE AS lower, rmse AS value FROM single UNION ALL SELECT horizon, 'nse', NULL, NULL, nse FROM single UNION ALL SELECT horizon, 'ssim', NULL, NULL, ssim FROM alike
 UNION ALL SELECT horizon, 'rmse', percentile, lower, rmse FROM bands UNION ALL SELECT horizon, 'nse', percentile, lower, nse FROM bands UNION ALL SELECT horizon, 'bias', percentile, lower, bias FROM bands)
SELECT horizon, metric, ROUND(percentile, 6) AS percentile, ROUND(lower, 6) AS lower, ROUND(value, 6) AS value FROM o""")
def forecast_report(t):
    fc = t.forecast().withColumn("row", F.floor(F.col("cell_id") / 10)).withColumn("col", F.col("cell_id") % 10)
    out = verification.forecast_report(fc, [10, 15])
    return out.select("horizon", "metric", "percentile", r6("lower"), r6("value"))

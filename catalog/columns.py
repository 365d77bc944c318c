"""Column rules on the line items and the daily cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import BANDS, CUBE, FILLED, GRID, query, r6
from drygrid.functions import calendar as cal, cover, grid, special, values as val, vegetation as veg
from drygrid.operators import samples


@query("ndvi_from_bands", f"""WITH {BANDS}
SELECT l_orderkey, l_linenumber, ROUND((channel_2 - channel_1) / NULLIF(channel_2 + channel_1, 0), 6) AS ndvi FROM bands""")
def ndvi_from_bands(t):
    return t.bands().select("l_orderkey", "l_linenumber", r6(veg.ndvi(F.col("channel_1"), F.col("channel_2")), "ndvi"))


SAT = """irr AS (SELECT * FROM (VALUES ('MSG1', 65.2296, 73.1869), ('MSG2', 65.2065, 73.0127), ('MSG3', 65.5148, 73.1807), ('MSG4', 65.2656, 73.1692)) v(sat, i6, i8))"""


@query("radiance_by_satellite", f"""WITH {BANDS}, {SAT}
SELECT l_orderkey, l_linenumber, substr(product_name, 1, 4) AS satellite,
       ROUND(channel_1 / COALESCE(i6, 1)::DOUBLE, 6) AS radiance_1, ROUND(channel_2 / COALESCE(i8, 1)::DOUBLE, 6) AS radiance_2
FROM bands LEFT JOIN irr ON substr(product_name, 1, 4) = sat""")
def radiance_by_satellite(t):
    name = F.col("product_name")
    return t.bands().select(
        "l_orderkey", "l_linenumber", F.substring(name, 1, 4).alias("satellite"),
        r6(veg.radiance(F.col("channel_1"), name, 0), "radiance_1"), r6(veg.radiance(F.col("channel_2"), name, 1), "radiance_2"),
    )


@query("ndvi_irradiance_weighted", f"""WITH {BANDS}, {SAT}
SELECT l_orderkey, l_linenumber,
       ROUND((channel_2 * i6 - channel_1 * i8)::DOUBLE / NULLIF((channel_2 * i6 + channel_1 * i8)::DOUBLE, 0), 6) AS ndvi
FROM bands LEFT JOIN irr ON substr(product_name, 1, 4) = sat""")
def ndvi_irradiance_weighted(t):
    sat = F.substring("product_name", 1, 4)
    i6, i8 = veg.irradiance(sat, 0), veg.irradiance(sat, 1)
    index = veg.ndvi_irradiance_weighted(F.col("channel_1"), F.col("channel_2"), i6, i8)
    return t.bands().select("l_orderkey", "l_linenumber", r6(index, "ndvi"))


@query("packed_ndvi_byte", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 256 <> 255 THEN ROUND(-0.08 + 0.004::DOUBLE * (l_partkey % 256), 6) END AS ndvi FROM lineitem""")
def packed_ndvi_byte(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(veg.unpack_byte_ndvi(F.col("l_partkey") % 256), "ndvi"))


@query("packed_ndvi_percent", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 256 <> 255 THEN ROUND((l_partkey % 256) / 100.0::DOUBLE, 6) END AS ndvi,
 l_shipdate - INTERVAL 12 HOUR AS time FROM lineitem""")
def packed_ndvi_percent(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(veg.unpack_percent_ndvi(F.col("l_partkey") % 256), "ndvi"),
                             veg.half_day_back(F.col("l_shipdate")).alias("time"))


@query("packed_scaling", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <> 7 THEN ROUND((l_suppkey - 5) * 0.25::DOUBLE, 6) END AS value FROM lineitem""")
def packed_scaling(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(val.unpack(F.col("l_suppkey"), 7, 5.0, 0.25), "value"))


@query("quality_bits", """SELECT l_orderkey, l_linenumber, CAST((l_partkey & 6) = 0 AS INTEGER) AS cloudy,
 CAST((l_partkey & 192) IN (0, 64) AS INTEGER) AS water, (l_partkey >> 2) & 7 AS field FROM lineitem""")
def quality_bits(t):
    q = F.col("l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", veg.qa_cloudy(q).alias("cloudy"), veg.qa_water(q).alias("water"), veg.bit_field(q, 2, 4).alias("field"))


@query("ndvi_under_quality", f"""SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey & 6) <> 0 THEN
 ROUND((l_extendedprice * l_tax - l_extendedprice * l_discount) / NULLIF(l_extendedprice * l_tax + l_extendedprice * l_discount, 0), 6) END AS ndvi FROM lineitem""")
def ndvi_under_quality(t):
    red, nir = F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(veg.ndvi(red, nir, veg.qa_cloudy(F.col("l_partkey")) == 0), "ndvi"))


@query("ndvi_bias_and_outliers", f"""WITH {BANDS}, n AS (
 SELECT l_orderkey, l_linenumber, 0.015705526::DOUBLE + 1.256689::DOUBLE * ((channel_2 - channel_1) / NULLIF(channel_2 + channel_1, 0)) AS v FROM bands)
SELECT l_orderkey, l_linenumber, ROUND(v, 6) AS corrected, CASE WHEN v IS NOT NULL THEN ROUND(LEAST(GREATEST(v, -1), 1), 6) END AS clamped,
 CASE WHEN v BETWEEN -1 AND 1 THEN ROUND(v, 6) END AS kept FROM n""")
def ndvi_bias_and_outliers(t):
    v = veg.correct_bias(veg.ndvi(F.col("channel_1"), F.col("channel_2")))
    return t.bands().select("l_orderkey", "l_linenumber", r6(v, "corrected"), r6(veg.remove_outliers(v, impute=True), "clamped"), r6(veg.remove_outliers(v), "kept"))


@query("floor_and_flags", f"""WITH {FILLED}, v AS (SELECT cell_id, time, value - 25 AS v FROM filled)
SELECT cell_id, time, CASE WHEN v < 0 THEN 0 ELSE v END AS floored, CASE WHEN v > 0 THEN v ELSE 0 END AS floored_null_zero,
 CASE WHEN v IS NOT NULL THEN CAST(v <= -2 AS INTEGER) END AS drought, CASE WHEN v IS NOT NULL THEN CAST(v < 10 AS INTEGER) END AS low,
 CASE WHEN v > 1 THEN 1 ELSE 0 END AS rain, COALESCE(v, -1) AS filled, NULLIF(v, 0) AS nonzero,
 CASE WHEN v >= 2 THEN 1 ELSE 0 END AS wet, CASE WHEN v <= -2 THEN 1 ELSE 0 END AS dry FROM v""")
def floor_and_flags(t):
    v = F.col("value") - 25
    return t.filled().select(
        "cell_id", "time", val.floor_at_zero(v).alias("floored"), val.floor_at_zero(v, null_as_zero=True).alias("floored_null_zero"),
        val.drought_flag(v).alias("drought"), val.low_flag(v).alias("low"), val.rain_flag(v).alias("rain"),
        val.fill_missing(v).alias("filled"), val.zero_to_null(v).alias("nonzero"), val.wet_flag(v).alias("wet"), val.dry_flag(v).alias("dry"),
    )


@query("nan_hygiene", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE ROUND(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def nan_hygiene(t):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("l_tax"), F.col("l_discount")))
    return val.declare_missing(t.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("ratio"))).withColumn("ratio", r6("ratio"))


@query("min_max_scaling", f"""WITH {CUBE}, s AS (SELECT MIN(value) AS a, MAX(value) AS b, MIN(value2) AS a2, MAX(value2) AS b2 FROM cube)
SELECT cell_id, time, ROUND((value - a) / (b - a), 6) AS value, ROUND((value2 - a2) / (b2 - a2), 6) AS value2 FROM cube, s""")
def min_max_scaling(t):
    return samples.min_max_normalise(t.cube(), ["value", "value2"]).select("cell_id", "time", r6("value"), r6("value2"))


@query("min_max_round_trip", f"""WITH {CUBE} SELECT cell_id, time, ROUND(value, 6) AS value FROM cube""")
def min_max_round_trip(t):
    cube = t.cube().select("cell_id", "time", "value")
    scaled = samples.min_max_normalise(cube, ["value"])
    return samples.min_max_normalise(scaled, ["value"], inverse_of=cube).select("cell_id", "time", r6("value"))


@query("z_scaling_on_train", f"""WITH {CUBE}, d AS (SELECT time, ROW_NUMBER() OVER (ORDER BY time) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT time FROM cube)),
 l AS (SELECT time, CASE WHEN r <= ROUND_EVEN(0.7 * n, 0) THEN 'train' WHEN r <= ROUND_EVEN(0.7 * n, 0) + ROUND_EVEN(0.15 * n, 0) THEN 'val' ELSE 'test' END AS split FROM d),
 s AS (SELECT AVG(value) AS m, STDDEV_POP(value) AS sd FROM cube JOIN l USING (time) WHERE split = 'train')
SELECT cell_id, time, split, ROUND((value - m) / sd, 6) AS value FROM cube JOIN l USING (time), s""")
def z_scaling_on_train(t):
    split = samples.chronological_split(t.cube(), 0.7, 0.5)
    return samples.standardise(split, ["value"]).select("cell_id", "time", "split", r6("value"))


@query("l1_row_normalisation", """WITH e AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(len(embedding))) AS pos FROM embeddings)
SELECT vec_id, pos, ROUND(x / SUM(ABS(x)) OVER (PARTITION BY vec_id), 6) AS value FROM e""")
def l1_row_normalisation(t):
    rows = t.embeddings.select("vec_id", F.posexplode(val.l1_normalise(F.col("embedding"))).alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("value"))


@query("date_sinusoids", f"""WITH {CUBE} SELECT cell_id, time,
 ROUND(SIN(2 * PI() * (MONTH(time) - 1) / 11.0::DOUBLE), 6) + 0 AS month_sin, ROUND(COS(2 * PI() * (MONTH(time) - 1) / 11.0::DOUBLE), 6) + 0 AS month_cos,
 ROUND(SIN(2 * PI() * (DAY(time) - 1) / 30.0::DOUBLE), 6) + 0 AS day_sin, ROUND(COS(2 * PI() * (DAY(time) - 1) / 30.0::DOUBLE), 6) + 0 AS day_cos,
 ROUND(CASE cell_id % 4 WHEN 0 THEN SIN(2 * PI() * (MONTH(time) - 1) / 11.0::DOUBLE) WHEN 1 THEN COS(2 * PI() * (MONTH(time) - 1) / 11.0::DOUBLE)
  WHEN 2 THEN SIN(2 * PI() * (DAY(time) - 1) / 30.0::DOUBLE) ELSE COS(2 * PI() * (DAY(time) - 1) / 30.0::DOUBLE) END, 6) + 0 AS tile FROM cube""")
def date_sinusoids(t):
    parts = cal.sinusoid(F.col("time"))
    names = ("month_sin", "month_cos", "day_sin", "day_cos")
    plain = [(F.round(p, 6) + 0).alias(n) for p, n in zip(parts, names)]
    tile = F.round(cal.sinusoid_at(F.col("time"), F.col("cell_id")), 6) + 0
    return t.cube().select("cell_id", "time", *plain, tile.alias("tile"))


COVER_SQL = """codes AS (SELECT p_partkey, ([0, 20, 30, 40, 50, 60, 70, 80, 90, 100, 111, 112, 113, 114, 115, 116, 121, 122, 123, 124, 125, 126, 200])[(p_partkey % 23 + 1)::INTEGER] AS code FROM part)"""


def cover_codes(t):
    codes = F.array(*[F.lit(c) for c in sorted(cover.COVER)])
    return t.part.select("p_partkey", F.element_at(codes, (F.col("p_partkey") % 23 + 1).cast("int")).alias("code"))


@query("cover_first_level", f"""WITH {COVER_SQL} SELECT p_partkey, code, CASE WHEN code BETWEEN 111 AND 116 THEN 11 WHEN code BETWEEN 121 AND 126 THEN 12 ELSE code END AS level1,
 CASE WHEN code IN (80, 200) THEN 1 ELSE 0 END AS water FROM codes""")
def cover_first_level(t):
    level = cover.level_1(F.col("code"))
    return cover_codes(t).select("p_partkey", "code", level.alias("level1"), cover.is_water(level).cast("int").alias("water"))


@query("cover_level_list", f"""WITH {COVER_SQL}, d AS (SELECT DISTINCT CASE WHEN code BETWEEN 111 AND 116 THEN 11 WHEN code BETWEEN 121 AND 126 THEN 12 ELSE code END AS level FROM codes)
SELECT level, CASE level WHEN 0 THEN 'Unknown' WHEN 11 THEN 'Closed forest' WHEN 12 THEN 'Open forest,' WHEN 20 THEN 'Shrubland' WHEN 30 THEN 'Herbaceous vegetation'
 WHEN 40 THEN 'Cropland' WHEN 50 THEN 'Built-up' WHEN 60 THEN 'Bare sparse vegetation' WHEN 70 THEN 'Snow and ice' WHEN 80 THEN 'Permanent water bodies'
 WHEN 90 THEN 'Herbaceous wetland' WHEN 100 THEN 'Moss and lichen' WHEN 200 THEN 'Oceans, seas' END AS description,
 CASE level WHEN 0 THEN '#282828' WHEN 11 THEN '#58481F' WHEN 12 THEN '#666000' WHEN 20 THEN '#FFBB22' WHEN 30 THEN '#FFFF4C' WHEN 40 THEN '#F096FF' WHEN 50 THEN '#FA0000'
 WHEN 60 THEN '#B4B4B4' WHEN 70 THEN '#F0F0F0' WHEN 80 THEN '#0032C8' WHEN 90 THEN '#0096A0' WHEN 100 THEN '#FAE6A0' WHEN 200 THEN '#000080' END AS colour FROM d""")
def cover_level_list(t):
    return cover.levels(cover_codes(t))


@query("cover_description_counts", f"""WITH {COVER_SQL}, n AS (SELECT code, CASE WHEN code BETWEEN 111 AND 116 THEN 'closed' WHEN code BETWEEN 121 AND 126 THEN 'open' ELSE 'other' END AS kind FROM codes)
SELECT code, kind, COUNT(*) AS n FROM n GROUP BY 1, 2""")
def cover_description_counts(t):
    name = cover.description(F.col("code"))
    kind = F.when(name.startswith("Closed forest"), "closed").when(name.startswith("Open forest"), "open").otherwise("other")
    return cover_codes(t).groupBy("code", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("longitude_rolls", """SELECT s_suppkey, ROUND(((s_suppkey * 3.5::DOUBLE + 180) % 360) - 180, 6) AS rolled, ROUND((s_suppkey * 3.5::DOUBLE + 180) % 360, 6) AS reanalysis_lon,
 ROUND((s_suppkey % 180 - 90 + 90.0::DOUBLE) % 180 - 90, 6) AS reanalysis_lat FROM supplier""")
def longitude_rolls(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", r6(grid.roll_longitude(k * 3.5), "rolled"), r6(grid.reanalysis_lon(k * 3.5), "reanalysis_lon"),
                             r6(grid.reanalysis_lat(k % 180 - 90), "reanalysis_lat"))


@query("ascii_grid_index", """WITH c AS (SELECT s_suppkey AS cell_id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier),
 i AS (SELECT cell_id, ABS(ROUND_EVEN((lat - 90.0) / 0.0625::DOUBLE, 0)::INTEGER) AS arc_row, ROUND_EVEN((lon + 180.0) / 0.0625::DOUBLE, 0)::INTEGER AS arc_col FROM c)
SELECT cell_id, arc_row, arc_col, ROUND(-180.0 + arc_col * 0.0625::DOUBLE, 6) AS arc_lon, ROUND(90.0 - arc_row * 0.0625::DOUBLE, 6) AS arc_lat FROM i""")
def ascii_grid_index(t):
    placed = t.cells().select("cell_id", grid.arc_row(F.col("lat"), -90, 0.0625).alias("arc_row"), grid.arc_col(F.col("lon"), -180, 0.0625).alias("arc_col"))
    return placed.select("cell_id", "arc_row", "arc_col", r6(grid.arc_lon(F.col("arc_col"), -180, 0.0625), "arc_lon"), r6(grid.arc_lat(F.col("arc_row"), -90, 0.0625), "arc_lat"))


@query("distance_from_origin", f"""WITH {GRID}, c AS (SELECT DISTINCT cell_id, lat, lon FROM grid)
SELECT cell_id, ROUND(2 * 6371.0088::DOUBLE * ASIN(LEAST(SQRT(POW(SIN(RADIANS(lat + 5.25) / 2), 2) + COS(RADIANS(-5.25::DOUBLE)) * COS(RADIANS(lat)) * POW(SIN(RADIANS(lon - 32.25) / 2), 2)), 1)), 6) AS km FROM c""")
def distance_from_origin(t):
    cells = t.cube(coordinates=True).select("cell_id", "lat", "lon").distinct()
    return cells.select("cell_id", r6(grid.haversine_km(F.lit(-5.25), F.lit(32.25), F.col("lat"), F.col("lon")), "km"))


@query("calendar_labels", f"""WITH {CUBE}, d AS (SELECT DISTINCT time FROM cube) SELECT time, STRFTIME(time, '%d-%b') AS day_label, STRFTIME(time, '%m-%d') AS month_day, STRFTIME(time, '%m') AS month,
 STRFTIME(time, '%B') AS month_name, (['DJF', 'MAM', 'JJA', 'SON'])[MONTH(time) % 12 // 3 + 1] AS season,
 CAST(time + INTERVAL (CASE WHEN DAYOFWEEK(time) = 0 THEN 0 ELSE 7 - DAYOFWEEK(time) END) DAY AS DATE) AS week_end,
 MAKE_DATE(YEAR(time), MONTH(time), CASE WHEN DAY(time) <= 10 THEN 1 WHEN DAY(time) <= 20 THEN 11 ELSE 21 END) AS dekad,
 CAST(DATE_TRUNC('quarter', DATE_TRUNC('month', time) - INTERVAL 2 MONTH) + INTERVAL 2 MONTH AS DATE) AS quarter FROM d""")
def calendar_labels(t):
    d = F.col("time")
    return t.cube().select("time").distinct().select(
        d, cal.day_label(d).alias("day_label"), cal.month_day(d).alias("month_day"), cal.padded_month(F.month(d)).alias("month"), cal.month_name(d).alias("month_name"),
        cal.season(d).alias("season"), cal.week_end(d).alias("week_end"), cal.dekad(d).alias("dekad"), cal.march_quarter(d).alias("quarter"),
    )


@query("confidence_bounds", f"""WITH {CUBE}, s AS (SELECT cell_id, YEAR(time) AS year, AVG(value) AS m, STDDEV_SAMP(value) AS sd, COUNT(*) AS n FROM cube GROUP BY 1, 2)
SELECT cell_id, year, ROUND(m - c * sd / SQRT(n), 6) AS lower, ROUND(m + c * sd / SQRT(n), 6) AS upper FROM (SELECT *, CASE WHEN n >= 30 THEN 1.96::DOUBLE WHEN n >= 2 THEN
 ([12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045])[n - 1]::DOUBLE END AS c FROM s)""")
def confidence_bounds(t):
    stats = t.cube().groupBy("cell_id", F.year("time").alias("year")).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    low, high = val.confidence_bounds(F.col("m"), F.col("sd"), F.col("n"), special.t_critical(F.col("n")))
    return stats.select("cell_id", "year", r6(low, "lower"), r6(high, "upper"))


@query("log_gamma_of_quantity", """SELECT l_orderkey, l_linenumber, ROUND(LGAMMA(l_quantity / 7), 6) AS log_gamma FROM lineitem""")
def log_gamma_of_quantity(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(special.log_gamma(F.col("l_quantity") / 7), "log_gamma"))

"""Scores of forecasts and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUBE, FILLED, FORECAST, query, r6
from drygrid.functions.values import rain_flag
from drygrid.operators import aggregates as ag, climatology as clim, series as ser, ssim as sm, verify as vf


def flags(t):
    """Domain totals per date of two products as 0/1 flags against each median."""
    from drygrid.operators.quantiles import exact_quantiles

    ship = t.lineitem.groupBy(F.to_date("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("o"))
    order = t.orders.groupBy(F.to_date("o_orderdate").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("f"))
    both = ship.join(order, "time")
    mo, mf = exact_quantiles(both, "o", [0.5], bounded=True).scalar(), exact_quantiles(both, "f", [0.5], bounded=True).scalar()
    return both.withColumn("_o", mo).withColumn("_f", mf).select(
        "time", (F.col("o") > F.col("_o")[0]).cast("int").alias("obs"), (F.col("f") > F.col("_f")[0]).cast("int").alias("fc"))


FLAGS = """s AS (SELECT CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) AS o FROM lineitem GROUP BY 1), r AS (SELECT CAST(o_orderdate AS DATE) AS time, CAST(COUNT(*) AS DOUBLE) AS f FROM orders GROUP BY 1),
b AS (SELECT s.time, o, f FROM s JOIN r ON s.time = r.time), fl AS (SELECT time, CAST(o > (SELECT MEDIAN(o) FROM b) AS INTEGER) AS obs, CAST(f > (SELECT MEDIAN(f) FROM b) AS INTEGER) AS fc FROM b)"""
TABLE = """COUNT(*) FILTER (obs = 1 AND fc = 1) AS h, COUNT(*) FILTER (obs = 1 AND fc = 0) AS m, COUNT(*) FILTER (obs = 0 AND fc = 1) AS fa, COUNT(*) FILTER (obs = 0 AND fc = 0) AS cn, AVG(POW(fc - obs, 2)) AS mse"""


@query("contingency_by_month", f"""WITH {FLAGS}, k AS (SELECT CAST(DATE_TRUNC('month', time) AS DATE) AS month, {TABLE} FROM fl GROUP BY 1)
SELECT month, h AS hits, m AS misses, fa AS false_alarms, cn AS correct_negatives, ROUND((h + cn) / (h + m + fa + cn), 6) AS accuracy, ROUND(fa / NULLIF(cn + fa, 0), 6) AS false_alarm_rate,
 ROUND(h / NULLIF(h + m, 0), 6) AS hit_rate, ROUND((h + fa) / NULLIF(h + m, 0), 6) AS bias_score, ROUND(mse, 6) AS mse, ROUND(SQRT(mse), 6) AS rmse FROM k""")
def contingency_by_month(t):
    out = vf.contingency(flags(t).withColumn("month", F.trunc("time", "MM")), "obs", "fc", by=["month"])
    return out.select("month", "hits", "misses", "false_alarms", "correct_negatives", *[r6(c) for c in ("accuracy", "false_alarm_rate", "hit_rate", "bias_score", "mse", "rmse")])


@query("mean_categorical_scores", f"""WITH {CUBE}, w AS (SELECT time, CAST(value > 25 AS INTEGER) AS obs, CAST(value2 > 4 AS INTEGER) AS fc FROM cube), k AS (SELECT time, {TABLE} FROM w GROUP BY 1)
SELECT ROUND(AVG((h + cn) / (h + m + fa + cn)), 6) AS accuracy_m, ROUND(AVG(fa / NULLIF(cn + fa, 0)), 6) AS far_m, ROUND(AVG(h / NULLIF(h + m, 0)), 6) AS pod_m, ROUND(AVG(SQRT(mse)), 6) AS rmse_m, ROUND(AVG(mse), 6) AS mse_m,
 ROUND(AVG((h + fa) / NULLIF(h + m, 0)), 6) AS bias_m FROM k""")
def mean_categorical_scores(t):
    rows = t.cube().select("time", (F.col("value") > 25).cast("int").alias("obs"), (F.col("value2") > 4).cast("int").alias("fc"))
    out = vf.mean_scores(vf.contingency(rows, "obs", "fc"))
    return out.select(*[r6(c) for c in out.columns])


@query("products_against_reference", f"""WITH p AS (SELECT l_returnflag AS product, l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) / 10 AS v FROM lineitem GROUP BY 1, 2, 3), {CUBE},
 w AS (SELECT p.product, p.time, CAST(value / 10 > 1 AS INTEGER) AS obs, CAST(v > 1 AS INTEGER) AS fc FROM p JOIN cube ON cube.cell_id = p.cell_id AND cube.time = p.time), k AS (SELECT product, time, {TABLE} FROM w GROUP BY 1, 2)
SELECT product, ROUND(AVG((h + cn) / (h + m + fa + cn)), 6) AS accuracy_m, ROUND(AVG(fa / NULLIF(cn + fa, 0)), 6) AS far_m, ROUND(AVG(h / NULLIF(h + m, 0)), 6) AS pod_m, ROUND(AVG(SQRT(mse)), 6) AS rmse_m, ROUND(AVG(mse), 6) AS mse_m,
 ROUND(AVG((h + fa) / NULLIF(h + m, 0)), 6) AS bias_m FROM k GROUP BY 1""")
def products_against_reference(t):
    product = t.lineitem.groupBy(F.col("l_returnflag").alias("product"), F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("time")).agg((F.sum("l_quantity") / 10).alias("v"))
    both = product.join(t.cube(), ["cell_id", "time"]).select("product", "time", rain_flag(F.col("value") / 10).alias("obs"), rain_flag(F.col("v")).alias("fc"))
    out = vf.mean_scores(vf.contingency(both, "obs", "fc", by=["product", "time"]), by=["product"])
    return out.select("product", *[r6(c) for c in out.columns if c != "product"])


@query("cellwise_agreement", f"""WITH {FILLED}, w AS (SELECT cell_id, CASE WHEN value IS NOT NULL THEN CAST(value > 25 AS INTEGER) END AS tg, CASE WHEN cell_id % 2 = 0 OR value2 IS NOT NULL THEN CAST(COALESCE(value2, 0) > 4 AS INTEGER) END AS rf FROM filled),
 e AS (SELECT cell_id, CAST(COALESCE(tg = rf, FALSE) AS DOUBLE) AS a, CAST(COALESCE(tg = 1, FALSE) AND NOT COALESCE(tg = rf, FALSE) AS DOUBLE) AS b, CAST(COALESCE(rf = 1, FALSE) AND NOT COALESCE(tg = rf, FALSE) AS DOUBLE) AS c FROM w)
SELECT cell_id, ROUND(AVG(a / NULLIF(a + c, 0)), 6) AS pod, ROUND(AVG(b / NULLIF(b + a, 0)), 6) AS far, ROUND(AVG(2 * a / NULLIF(2 * a + b + c, 0)), 6) AS accuracy FROM e GROUP BY 1""")
def cellwise_agreement(t):
    ref = F.when((F.col("cell_id") % 2 == 0) | F.col("value2").isNotNull(), (F.coalesce("value2", F.lit(0.0)) > 4).cast("int"))
    rows = t.filled().select("cell_id", (F.col("value") > 25).cast("int").alias("tg"), ref.alias("rf"))
    return vf.agreement(rows, "tg", "rf").select("cell_id", r6("pod"), r6("far"), r6("accuracy"))


# --- losses --------------------------------------------------------------------------------------------


@query("losses_over_known_labels", f"""WITH {FORECAST}, n AS (SELECT *, NULLIF(y, 0.5) AS l FROM fc)
SELECT model, ROUND(SUM(COALESCE(POW(y_pred - l, 2), 0)) / COUNT(l), 6) AS mse, ROUND(SQRT(SUM(COALESCE(POW(y_pred - l, 2), 0)) / COUNT(l)), 6) AS rmse, ROUND(SUM(COALESCE(ABS(y_pred - l), 0)) / COUNT(l), 6) AS mae,
 ROUND(SUM(COALESCE(ABS(y_pred - l) / (l + 1e-10), 0)) / COUNT(l), 6) AS mape, ROUND(SUM(CASE WHEN l <> 1 THEN COALESCE(ABS(y_pred - l), 0) END) / COUNT(NULLIF(l, 1)), 6) AS mae_not_one FROM n GROUP BY 1""")
def losses_over_known_labels(t):
    p, label = F.col("y_pred"), F.col("l")
    rows = t.forecast().withColumn("l", F.nullif(F.col("y"), F.lit(0.5)))
    return rows.groupBy("model").agg(r6(vf.masked_mse(p, label), "mse"), r6(vf.masked_rmse(p, label), "rmse"), r6(vf.masked_mae(p, label), "mae"),
                                     r6(vf.masked_mape(p, label), "mape"), r6(vf.masked_mae(p, label, 1.0), "mae_not_one"))


@query("losses_under_mask", f"""WITH {FORECAST} SELECT model, horizon, ROUND(SUM(COALESCE(ABS(y_pred - y), 0) * mask) / SUM(mask), 6) AS mae, ROUND(SUM(COALESCE(POW(y_pred - y, 2), 0) * mask) / SUM(mask), 6) AS mse,
 ROUND(SQRT(SUM(COALESCE(POW(y_pred - y, 2), 0) * mask) / SUM(mask)), 6) AS rmse, ROUND(SUM(COALESCE(ABS((y_pred - y) / NULLIF(y, 0)), 0) * mask) / SUM(mask), 6) AS mape, ROUND(SUM(COALESCE(y_pred - y, 0) * mask) / SUM(mask), 6) AS mbe,
 ROUND(SUM(COALESCE(POW(y_pred - y, 4), 0) * mask) / SUM(mask), 6) AS quartic FROM fc GROUP BY 1, 2""")
def losses_under_mask(t):
    p, y, m = F.col("y_pred"), F.col("y"), F.col("mask")
    return t.forecast().groupBy("model", "horizon").agg(
        r6(vf.mask_mae(p, y, m), "mae"), r6(vf.mask_mse(p, y, m), "mse"), r6(vf.mask_rmse(p, y, m), "rmse"), r6(vf.mask_mape(p, y, m), "mape"), r6(vf.mask_mbe(p, y, m), "mbe"),
        r6(vf.masked_custom(lambda a, b: F.pow(a - b, 4), p, y, m), "quartic"),
    )


@query("error_map", f"""WITH {FORECAST} SELECT cell_id, ROUND(AVG(POW(y_pred - y, 2)), 6) AS mse FROM fc GROUP BY 1""")
def error_map(t):
    return vf.error_map(t.forecast(), "mse").withColumn("mse", r6("mse"))


@query("metric_table", f"""WITH {FORECAST} SELECT model, horizon, ROUND(SQRT(SUM(COALESCE(POW(y_pred - y, 2), 0) * mask) / SUM(mask)), 6) AS rmse, ROUND(SUM(COALESCE(ABS(y_pred - y), 0) * mask) / SUM(mask), 6) AS rmse_elementwise,
 ROUND(SUM(COALESCE(y_pred - y, 0) * mask) / SUM(mask), 6) AS bias, ROUND(1 - AVG(mask), 6) AS masked_share FROM fc GROUP BY 1, 2""")
def metric_table(t):
    out = vf.metric_table(t.forecast(), ["rmse", "rmse_elementwise", "bias"], ["model", "horizon"], mask="mask")
    return out.select("model", "horizon", *[r6(c) for c in ("rmse", "rmse_elementwise", "bias", "masked_share")])


@query("results_by_horizon", f"""WITH {FORECAST}, k AS (SELECT model, horizon, SUM(COALESCE(ABS(y_pred - y), 0)) / COUNT(*) AS mae, SUM(COALESCE(POW(y_pred - y, 2), 0)) / COUNT(*) AS mse FROM fc WHERE valid_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY 1, 2)
SELECT model, horizon, 'mae' AS metric, ROUND(mae, 6) AS value FROM k UNION ALL SELECT model, horizon, 'mse', ROUND(mse, 6) FROM k""")
def results_by_horizon(t):
    return vf.results_by_horizon(t.forecast(), ["mae", "mse"], "1997-01-01", "1999-12-31", horizons=[10, 15]).withColumn("value", r6("value"))


DAILY = f"""{FORECAST}, de AS (SELECT model, horizon, valid_date, AVG(ABS(y_pred - y)) AS e, SQRT(AVG(POW(y_pred - y, 2))) AS re FROM fc GROUP BY 1, 2, 3)"""


@query("error_by_day_of_year", f"""WITH {DAILY} SELECT model, STRFTIME(valid_date, '%m-%d') AS time_key, ROUND(AVG(e), 6) AS error FROM de GROUP BY 1, 2""")
def error_by_day_of_year(t):
    return vf.error_by_calendar(t.forecast(), "day", ["model"]).withColumn("error", r6("error"))


@query("error_by_month", f"""WITH {FORECAST}, d AS (SELECT model, valid_date, AVG(ABS(y_pred - y)) AS e FROM fc WHERE mask = 1 AND valid_date BETWEEN DATE '1996-01-01' AND DATE '1996-10-31' GROUP BY 1, 2),
 m AS (SELECT model, MONTH(valid_date) AS month, AVG(e) AS e FROM d GROUP BY 1, 2), k AS (SELECT model, k AS month FROM (SELECT DISTINCT model FROM m), range(1, 13) r(k))
SELECT k.model, STRFTIME(MAKE_DATE(2000, k.month, 1), '%B') AS time_key, k.month, ROUND(e, 6) AS error FROM k LEFT JOIN m ON m.model = k.model AND m.month = k.month""")
def error_by_month(t):
    return vf.error_by_calendar(t.forecast(), "month", ["model"], start="1996-01-01", end="1996-10-31", mask="mask").withColumn("error", r6("error"))


@query("error_by_year", f"""WITH {DAILY} SELECT model, horizon, YEAR(valid_date) AS year, ROUND(AVG(e), 6) AS error, ROUND(AVG(re), 6) AS rmse FROM de GROUP BY 1, 2, 3""")
def error_by_year(t):
    fc = t.forecast()
    mae = vf.error_by_year(fc).withColumn("error", r6("error"))
    return mae.join(vf.error_by_year(fc, metric="rmse").withColumnRenamed("error", "rmse").withColumn("rmse", r6("rmse")), ["model", "horizon", "year"])


@query("forecast_spread_by_day", f"""WITH {FORECAST} SELECT model, valid_date, ROUND(QUANTILE_CONT(y_pred, 0.25), 6) AS q25, ROUND(MEDIAN(y_pred), 6) AS median, ROUND(QUANTILE_CONT(y_pred, 0.75), 6) AS q75 FROM fc WHERE mask = 1 AND y_pred IS NOT NULL GROUP BY 1, 2""")
def forecast_spread_by_day(t):
    return clim.forecast_spread(t.forecast(), ["model", "valid_date"], "y_pred", keep="mask").select("model", "valid_date", r6("q25"), r6("median"), r6("q75"))


@query("histogram_2d", f"""WITH {FORECAST}, d AS (SELECT y AS x, y_pred AS p FROM fc WHERE y IS NOT NULL AND y_pred IS NOT NULL), e AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(p) AS p0, MAX(p) AS p1 FROM d)
SELECT CAST(LEAST(FLOOR((x - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS bin_x, CAST(LEAST(FLOOR((p - p0) / ((p1 - p0) / 20)), 19) AS INTEGER) AS bin_y, COUNT(*) AS n FROM d, e GROUP BY 1, 2""")
def histogram_2d(t):
    return vf.histogram_2d(t.forecast(), "y", "y_pred", 20)


@query("hexagon_counts", f"""WITH {FORECAST}, d AS (SELECT y AS x, y_pred AS p FROM fc WHERE y BETWEEN 0 AND 1 AND y_pred BETWEEN 0 AND 1), e AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(p) AS p0, MAX(p) AS p1 FROM d)
SELECT CAST(LEAST(FLOOR((x - x0) / ((x1 - x0) / 50)), 49) AS INTEGER) AS bin_x, CAST(LEAST(FLOOR((p - p0) / ((p1 - p0) / 50)), 49) AS INTEGER) AS bin_y, COUNT(*) AS n FROM d, e GROUP BY 1, 2 HAVING COUNT(*) >= 10""")
def hexagon_counts(t):
    from drygrid.operators.subset import both_in_unit_range

    return vf.histogram_2d(both_in_unit_range(t.forecast(), "y", "y_pred"), "y", "y_pred", 50, min_count=10)


BANDS_SQL = f"""{FORECAST}, q AS (SELECT QUANTILE_CONT(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM fc),
 k AS (SELECT y, y_pred, LEAST(len(list_filter(b, lambda v: v <= y)) - 1, 9) AS band, b FROM fc, q WHERE y IS NOT NULL)"""


@query("error_by_percentile", f"""WITH {BANDS_SQL} SELECT ROUND(band / 10, 6) AS percentile, ROUND(ANY_VALUE(b)[ANY_VALUE(band) + 1], 6) AS lower, ROUND(SQRT(AVG(POW(y - y_pred, 2))), 6) AS rmse FROM k GROUP BY band""")
def error_by_percentile(t):
    return vf.error_by_percentile(t.forecast(), "rmse").select("percentile", r6("lower"), r6("rmse"))


@query("efficiency_by_percentile", f"""WITH {BANDS_SQL}, s AS (SELECT band, ANY_VALUE(b)[ANY_VALUE(band) + 1] AS lower, 1 - SUM(POW(y - y_pred, 2)) / NULLIF(VAR_POP(y) * COUNT(y), 0) AS n FROM k GROUP BY band)
SELECT ROUND(band / 10, 6) AS percentile, ROUND(lower, 6) AS lower, ROUND(1 / (2 - n), 6) AS nse FROM s""")
def efficiency_by_percentile(t):
    return vf.error_by_percentile(t.forecast(), "nse").select("percentile", r6("lower"), r6("nse"))


@query("huber_error_by_model", f"""WITH {FORECAST}, e AS (SELECT model, horizon, ABS(y_pred - y) AS e FROM fc), l AS (SELECT model, horizon, CASE WHEN e <= 0.2::DOUBLE THEN e * e / 2 ELSE 0.2::DOUBLE * (e - 0.1::DOUBLE) END AS l FROM e)
SELECT model, horizon, ROUND(AVG(l), 6) AS huber, ROUND(MAX(l), 6) AS worst, COUNT(l) AS pairs FROM l GROUP BY 1, 2""")
def huber_error_by_model(t):
    return ag.huber_error(t.forecast(), ["model", "horizon"]).select("model", "horizon", r6("huber"), r6("worst"), "pairs")


# --- ensembles -----------------------------------------------------------------------------------------

ENSEMBLE = f"""{CUBE}, en AS (SELECT l_linenumber AS member, CAST(l_shipdate AS DATE) AS init_date, l_suppkey AS cell_id, SUM(l_quantity) / 50 AS y_pred FROM lineitem GROUP BY 1, 2, 3),
ej AS (SELECT en.*, value / 100 AS y, CAST(en.cell_id % 7 <> 3 AS INTEGER) AS mask, CAST(en.cell_id % 3 * 15 + 15 AS INTEGER) AS horizon FROM en JOIN cube ON cube.cell_id = en.cell_id AND cube.time = init_date)"""


def ensemble(t):
    members = t.lineitem.groupBy(F.col("l_linenumber").alias("member"), F.to_date("l_shipdate").alias("init_date"), F.col("l_suppkey").alias("cell_id")).agg((F.sum("l_quantity") / 50).alias("y_pred"))
    truth = t.cube().select("cell_id", F.col("time").alias("init_date"), (F.col("value") / 100).alias("y"))
    return members.join(truth, ["cell_id", "init_date"]).withColumn("mask", (F.col("cell_id") % 7 != 3).cast("int")).withColumn("horizon", (F.col("cell_id") % 3 * 15 + 15).cast("int"))


@query("ensemble_scores", f"""WITH {ENSEMBLE}, c AS (SELECT init_date, cell_id, AVG(y_pred) AS m, VAR_SAMP(y_pred) AS v, ANY_VALUE(y) AS y FROM ej WHERE mask = 1 GROUP BY 1, 2),
 s AS (SELECT init_date, SQRT(AVG(POW(y - m, 2))) AS r, SQRT(AVG(v)) AS sp FROM c GROUP BY 1) SELECT ROUND(AVG(r), 6) AS rmse, ROUND(AVG(sp), 6) AS spread, ROUND(AVG(sp) / AVG(r), 6) AS ssr FROM s""")
def ensemble_scores(t):
    return vf.ensemble_scores(ensemble(t), mask="mask").select(r6("rmse"), r6("spread"), r6("ssr"))


@query("ensemble_by_horizon", f"""WITH {ENSEMBLE}, r AS (SELECT horizon, init_date, cell_id, y, LEAST(GREATEST(y_pred * 0.9::DOUBLE + 0.05::DOUBLE, -1), 1) AS p FROM ej),
 c AS (SELECT horizon, init_date, cell_id, AVG(p) AS m, VAR_SAMP(p) AS v, ANY_VALUE(y) AS y FROM r GROUP BY 1, 2, 3), s AS (SELECT horizon, init_date, SQRT(AVG(POW(y - m, 2))) AS r, SQRT(AVG(v)) AS sp FROM c GROUP BY 1, 2)
SELECT horizon, ROUND(AVG(r), 4) AS rmse, ROUND(AVG(sp), 4) AS spread, ROUND(AVG(sp) / AVG(r), 4) AS ssr FROM s GROUP BY 1""")
def ensemble_by_horizon(t):
    return vf.ensemble_by_horizon(ensemble(t), scale=(0.05, 0.95))


@query("ensemble_interval", f"""WITH {ENSEMBLE}, m AS (SELECT init_date, member, AVG(y_pred) AS a FROM ej GROUP BY 1, 2), s AS (SELECT init_date, AVG(a) AS mean, STDDEV_SAMP(a) AS std, COUNT(a) AS n FROM m GROUP BY 1)
SELECT init_date, ROUND(mean, 9) AS mean, n, ROUND(mean - ([12.706, 4.303, 3.182, 2.776, 2.571, 2.447])[n - 1]::DOUBLE * std / SQRT(n), 9) AS lower, ROUND(mean + ([12.706, 4.303, 3.182, 2.776, 2.571, 2.447])[n - 1]::DOUBLE * std / SQRT(n), 9) AS upper FROM s""")
def ensemble_interval(t):
    # nine digits: means of fiftieths over powers of two end at the seventh digit, halfway between two six-digit numbers
    return vf.ensemble_interval(ensemble(t)).select("init_date", "n", *[F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")])


# --- structure and correlation -------------------------------------------------------------------------

IMAGES = f"""{CUBE}, im AS (SELECT CAST(DATE_TRUNC('month', time) AS DATE) AS image, cell_id // 10 AS row, cell_id % 10 AS col, AVG(value) / 50 - 1 AS a, AVG(value2) / 10 - 1 AS b FROM cube GROUP BY ALL)"""
BLUR = """k AS (SELECT o - 5 AS o, EXP(-POW(o - 5, 2) / 4.5) / (SELECT SUM(EXP(-POW(i - 5, 2) / 4.5)) FROM range(11) r(i)) AS w FROM range(11) r(o)),
q AS (SELECT image, row, col, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM im),
v AS (SELECT p.image, p.row, p.col, SUM(w * n.a) AS a, SUM(w * n.b) AS b, SUM(w * n.aa) AS aa, SUM(w * n.bb) AS bb, SUM(w * n.ab) AS ab FROM q p JOIN q n ON n.image = p.image AND n.col = p.col JOIN k ON k.o = n.row - p.row GROUP BY 1, 2, 3),
h AS (SELECT p.image, p.row, p.col, SUM(w * n.a) AS a, SUM(w * n.b) AS b, SUM(w * n.aa) AS aa, SUM(w * n.bb) AS bb, SUM(w * n.ab) AS ab FROM v p JOIN v n ON n.image = p.image AND n.row = p.row JOIN k ON k.o = n.col - p.col GROUP BY 1, 2, 3),
sm AS (SELECT image, row, col, (2 * a * b + 0.0004) * (2 * (ab - a * b) + 0.0036) / ((a * a + b * b + 0.0004) * ((aa - a * a) + (bb - b * b) + 0.0036)) AS s FROM h)"""
BLURRED = f"{IMAGES}, {BLUR}"


def images(t):
    cube = t.cube().groupBy(F.trunc("time", "MM").alias("image"), "cell_id").agg((F.avg("value") / 50 - 1).alias("a"), (F.avg("value2") / 10 - 1).alias("b"))
    return cube.select("image", F.floor(F.col("cell_id") / 10).alias("row"), (F.col("cell_id") % 10).alias("col"), "a", "b")


@query("structural_similarity_map", f"""WITH {BLURRED} SELECT image, row, col, ROUND(s, 6) AS ssim FROM sm""")
def structural_similarity_map(t):
    return sm.ssim_map(images(t)).select("image", "row", "col", r6("ssim"))


@query("structural_similarity_by_year", f"""WITH {BLURRED}, i AS (SELECT image, AVG(s) AS s FROM sm GROUP BY 1) SELECT YEAR(image) AS year, ROUND(AVG(s), 6) AS ssim FROM i GROUP BY 1""")
def structural_similarity_by_year(t):
    per = images(t).withColumn("year", F.year("image"))
    return sm.ssim(per, image=("year", "image"), by=("year",)).select("year", r6("ssim"))


@query("efficiency_and_correlation", f"""WITH {FORECAST}, p AS (SELECT model, y, y_pred FROM fc WHERE y IS NOT NULL AND y_pred IS NOT NULL) SELECT model, ROUND(1 - SUM(POW(y - y_pred, 2)) / (VAR_POP(y) * COUNT(*)), 6) AS nse, ROUND(CORR(y, y_pred), 6) AS r FROM p GROUP BY 1""")
def efficiency_and_correlation(t):
    rows = t.forecast()
    return rows.groupBy("model").agg(r6(vf.nse(F.col("y_pred"), F.col("y")), "nse"), r6(F.corr("y", "y_pred"), "r"))


@query("bias_corrected_forecast", f"""WITH {FORECAST}, l AS (SELECT model, REGR_SLOPE(y, y_pred) AS s, REGR_INTERCEPT(y, y_pred) AS i FROM fc GROUP BY 1) SELECT fc.model, valid_date, cell_id, ROUND(y_pred * s + i, 6) AS y_corrected FROM fc JOIN l ON l.model = fc.model""")
def bias_corrected_forecast(t):
    return vf.bias_corrected(t.forecast(), by=["model"]).select("model", "valid_date", "cell_id", r6("y_corrected"))


@query("bias_corrected_together", f"""WITH {FORECAST}, l AS (SELECT REGR_SLOPE(y, y_pred) AS s, REGR_INTERCEPT(y, y_pred) AS i FROM fc) SELECT model, valid_date, cell_id, ROUND(y_pred * (SELECT s FROM l) + (SELECT i FROM l), 6) AS y_corrected FROM fc""")
def bias_corrected_together(t):
    return vf.bias_corrected(t.forecast()).select("model", "valid_date", "cell_id", r6("y_corrected"))


@query("correlation_matrix", f"""WITH c AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x FROM lineitem), m AS (SELECT CORR(q, p) AS qp, CORR(q, d) AS qd, CORR(q, x) AS qx, CORR(p, d) AS pd, CORR(p, x) AS px, CORR(d, x) AS dx FROM c)
SELECT x, y, ROUND(r, 6) AS r FROM m, LATERAL (VALUES ('l_quantity', 'l_quantity', 1.0::DOUBLE), ('l_extendedprice', 'l_extendedprice', 1.0), ('l_discount', 'l_discount', 1.0), ('l_tax', 'l_tax', 1.0),
 ('l_quantity', 'l_extendedprice', qp), ('l_extendedprice', 'l_quantity', qp), ('l_quantity', 'l_discount', qd), ('l_discount', 'l_quantity', qd), ('l_quantity', 'l_tax', qx), ('l_tax', 'l_quantity', qx),
 ('l_extendedprice', 'l_discount', pd), ('l_discount', 'l_extendedprice', pd), ('l_extendedprice', 'l_tax', px), ('l_tax', 'l_extendedprice', px), ('l_discount', 'l_tax', dx), ('l_tax', 'l_discount', dx)) v(x, y, r)""")
def correlation_matrix(t):
    return vf.correlation_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", r6("r"))


@query("lag_correlation", f"""WITH {CUBE}, p AS (SELECT cell_id, value AS x, LEAD(value2, 5) OVER (PARTITION BY cell_id ORDER BY time) AS y FROM cube) SELECT cell_id, ROUND(CORR(x, y), 6) AS r, COUNT(y) AS n FROM p WHERE y IS NOT NULL GROUP BY 1""")
def lag_correlation(t):
    return vf.lag_correlation(t.cube(), "value", "value2", 5).select("cell_id", r6("r"), "n")


@query("lag_correlation_backwards", f"""WITH {CUBE}, p AS (SELECT cell_id, value2 AS x, LEAD(value, 3) OVER (PARTITION BY cell_id ORDER BY time) AS y FROM cube) SELECT cell_id, ROUND(CORR(x, y), 6) AS r, COUNT(y) AS n FROM p WHERE y IS NOT NULL GROUP BY 1""")
def lag_correlation_backwards(t):
    return vf.lag_correlation(t.cube(), "value", "value2", -3).select("cell_id", r6("r"), "n")


# Student's t by its finite sum over cos^2 = 1 - r^2: odd degrees of freedom start from the angle, even ones from 1.
P_VALUE = """WITH {cube}, p AS (SELECT cell_id, value AS x, LEAD(value2, 1) OVER (PARTITION BY cell_id ORDER BY time) AS y FROM cube),
 c AS (SELECT cell_id, CORR(x, y) AS r, COUNT(y) AS n FROM p WHERE y IS NOT NULL GROUP BY 1), d AS (SELECT *, n - 2 AS v, LN(SQRT(1 - r * r)) AS lc FROM c),
 a AS (SELECT *, CASE WHEN v % 2 = 1
   THEN 2 / PI() * (ASIN(ABS(r)) + ABS(r) * COALESCE(list_sum(list_transform(range(0, (v - 1) // 2), lambda k: EXP(LGAMMA(k + 1) - LGAMMA(k + 1.5::DOUBLE) + LN(SQRT(PI()) / 2) + (2 * k + 1) * lc))), 0))
   ELSE ABS(r) * list_sum(list_transform(range(0, v // 2), lambda k: EXP(LGAMMA(k + 0.5::DOUBLE) - LGAMMA(k + 1) - LN(SQRT(PI())) + 2 * k * lc))) END AS inside FROM d)
SELECT cell_id, ROUND(r, 6) AS r, n, ROUND(1 - inside, 6) AS p_value FROM a"""


@query("lag_correlation_significance", P_VALUE.format(cube=CUBE))
def lag_correlation_significance(t):
    return vf.lag_correlation(t.cube(), "value", "value2", 1, return_p=True).select("cell_id", r6("r"), "n", r6("p_value"))


ACF = f"""{CUBE}, nb AS (SELECT cell_id, value, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time) AS i FROM cube)"""


@query("autocorrelation_ten_lags", f"""WITH {ACF} SELECT a.cell_id, CAST(k AS INTEGER) AS lead, ROUND(CORR(a.value, b.value), 6) AS r FROM nb a CROSS JOIN range(1, 11) g(k) JOIN nb b ON b.cell_id = a.cell_id AND b.i = a.i + k GROUP BY 1, 2""")
def autocorrelation_ten_lags(t):
    return vf.autocorrelation(t.cube(), 10).select("cell_id", "lead", r6("r"))


@query("autocorrelation_all_lags", f"""WITH {ACF}, n AS (SELECT cell_id, MAX(i) AS n FROM nb GROUP BY 1) SELECT a.cell_id, CAST(b.i - a.i AS INTEGER) AS lead, ROUND(CASE WHEN MIN(a.value) < MAX(a.value) AND MIN(b.value) < MAX(b.value) THEN CORR(a.value, b.value) END, 6) AS r
 FROM nb a JOIN nb b ON b.cell_id = a.cell_id AND b.i > a.i JOIN n ON n.cell_id = a.cell_id AND b.i - a.i <= n - 2 GROUP BY 1, 2""")
def autocorrelation_all_lags(t):
    return ser.full_autocorrelation(t.cube()).select("cell_id", "lead", r6("r"))


@query("persistence_error", f"""WITH {CUBE}, d AS (SELECT time, LEAD(value) OVER (PARTITION BY cell_id ORDER BY time) - value AS d FROM cube), s AS (SELECT time, SQRT(AVG(d * d)) AS r FROM d GROUP BY 1) SELECT ROUND(AVG(r), 6) AS rmse FROM s""")
def persistence_error(t):
    return vf.persistence_rmse(t.cube()).select(r6("rmse"))

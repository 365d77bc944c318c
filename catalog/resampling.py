"""Time axis: calendars, gaps, rolling, resampling, climatology."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUBE, FILLED, query, r6
from drygrid.operators import climatology as clim, quality, temporal as tm


@query("calendar_fill", f"""WITH {FILLED} SELECT cell_id, time, COALESCE(value, 0) AS value FROM filled""")
def calendar_fill(t):
    return t.filled(fill=0.0).select("cell_id", "time", "value")


@query("missing_days_per_cell", f"""WITH {FILLED} SELECT cell_id, time FROM filled WHERE value IS NULL""")
def missing_days_per_cell(t):
    return tm.missing_days(t.cube())


@query("rolling_sum_and_mean", f"""WITH {FILLED} SELECT cell_id, time,
 CASE WHEN COUNT(value) OVER w = 3 THEN SUM(value) OVER w END AS sum_3, CASE WHEN COUNT(value) OVER w = 3 THEN ROUND(AVG(value) OVER w, 6) END AS mean_3
 FROM filled WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_sum_and_mean(t):
    return t.filled().select("cell_id", "time", tm.rolling("value", 3).alias("sum_3"), r6(tm.rolling("value", 3, "mean"), "mean_3"))


@query("running_total", f"""WITH {CUBE} SELECT cell_id, time, SUM(value) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS total FROM cube""")
def running_total(t):
    return t.cube().select("cell_id", "time", tm.running_sum(F.col("value")).alias("total"))


@query("forward_filled", f"""WITH {FILLED}, g AS (SELECT *, COUNT(value) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS k FROM filled)
SELECT cell_id, time, MAX(value) OVER (PARTITION BY cell_id, k) AS value FROM g""")
def forward_filled(t):
    return t.filled().select("cell_id", "time", tm.forward_fill("value").alias("value"))


KNOWN = f"""{FILLED}, g AS (SELECT *, COUNT(value) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS k,
  COUNT(value) OVER (PARTITION BY cell_id ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS m FROM filled),
p AS (SELECT *, MAX(value) OVER (PARTITION BY cell_id, k) AS pv, MIN(time) OVER (PARTITION BY cell_id, k) AS pt,
  MAX(value) OVER (PARTITION BY cell_id, m) AS nv, MAX(time) OVER (PARTITION BY cell_id, m) AS nt FROM g)"""


@query("interpolated_linear", f"""WITH {KNOWN} SELECT cell_id, time, ROUND(CASE WHEN value IS NOT NULL THEN value ELSE pv + (nv - pv) * (time - pt) / (nt - pt) END, 6) AS value FROM p""")
def interpolated_linear(t):
    return tm.interpolate(t.filled()).select("cell_id", "time", r6("value"))


@query("interpolated_nearest", f"""WITH {KNOWN} SELECT cell_id, time, CASE WHEN value IS NOT NULL THEN value WHEN 2 * (time - pt) <= nt - pt THEN pv ELSE nv END AS value FROM p""")
def interpolated_nearest(t):
    return tm.interpolate(t.filled(), method="nearest").select("cell_id", "time", "value")


GAP_LENGTHS = """g AS (SELECT *, COUNT(value) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS k FROM filled),
l AS (SELECT *, COUNT(*) FILTER (value IS NULL) OVER (PARTITION BY cell_id, k) AS len FROM g),
s AS (SELECT *, LAG(CASE WHEN value IS NULL THEN len END) OVER (PARTITION BY cell_id ORDER BY time) AS ended, LEAD(time) OVER (PARTITION BY cell_id ORDER BY time) IS NULL AS last FROM l)"""
GAPS = f"{FILLED}, {GAP_LENGTHS}"


@query("gap_quality_flags", f"""WITH {GAPS} SELECT cell_id, time, CASE WHEN value IS NOT NULL THEN COALESCE(ended, 0) WHEN last THEN len END AS streaks,
 CASE WHEN value IS NULL THEN len ELSE 0 END AS quality_flag FROM s""")
def gap_quality_flags(t):
    return tm.gap_streaks(t.filled()).select("cell_id", "time", "streaks", "quality_flag")


@query("values_after_short_gaps", f"""WITH {GAPS} SELECT cell_id, time, CASE WHEN COALESCE(ended, 0) <= 5 THEN value END AS value FROM s WHERE value IS NOT NULL""")
def values_after_short_gaps(t):
    flagged = tm.gap_streaks(t.filled()).where("value IS NOT NULL")
    return flagged.select("cell_id", "time", tm.drop_long_gaps(F.col("value"), F.col("streaks"), 5).alias("value"))


@query("second_order_difference", f"""WITH {CUBE}, a AS (SELECT *, value - LAG(value) OVER w AS d, ROW_NUMBER() OVER w AS i FROM cube WINDOW w AS (PARTITION BY cell_id ORDER BY time)),
 b AS (SELECT *, d - LAG(d) OVER (PARTITION BY cell_id ORDER BY time) AS dd FROM a) SELECT cell_id, time, ABS(dd) AS difference, ROUND(ABS(dd / NULLIF(value, 0)), 6) AS relative FROM b WHERE i > 2""")
def second_order_difference(t):
    plain = tm.nth_difference(t.cube(), 2).withColumn("relative", r6(F.abs(F.try_divide(F.col("difference"), F.col("value")))))
    return plain.select("cell_id", "time", "difference", "relative")


@query("lagged_difference", f"""WITH {CUBE} SELECT cell_id, time, value - LAG(value, 7) OVER (PARTITION BY cell_id ORDER BY time) AS change FROM cube""")
def lagged_difference(t):
    return t.cube().select("cell_id", "time", tm.lag_difference("value", 7).alias("change"))


@query("warm_up_dropped", f"""WITH {CUBE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time) AS i FROM cube) SELECT cell_id, time, value FROM r WHERE i > 91""")
def warm_up_dropped(t):
    return tm.drop_warm_up(t.cube(), 90).select("cell_id", "time", "value")


@query("last_rows_per_cell", f"""WITH {CUBE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time DESC) AS i FROM cube) SELECT cell_id, time, value FROM r WHERE i <= 30""")
def last_rows_per_cell(t):
    return tm.keep_tail(t.cube(), 30).select("cell_id", "time", "value")


@query("savitzky_golay_5_2", f"""WITH {CUBE}, r AS (SELECT *, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY cell_id) AS n,
 LAG(value, 4) OVER w AS b4, LAG(value, 3) OVER w AS b3, LAG(value, 2) OVER w AS b2, LAG(value, 1) OVER w AS b1, LEAD(value, 1) OVER w AS a1, LEAD(value, 2) OVER w AS a2,
 LEAD(value, 3) OVER w AS a3, LEAD(value, 4) OVER w AS a4 FROM cube WINDOW w AS (PARTITION BY cell_id ORDER BY time))
SELECT cell_id, time, ROUND(CASE WHEN i = 1 THEN 31 * value + 9 * a1 - 3 * a2 - 5 * a3 + 3 * a4 WHEN i = 2 THEN 9 * b1 + 13 * value + 12 * a1 + 6 * a2 - 5 * a3
 WHEN i = n THEN 31 * value + 9 * b1 - 3 * b2 - 5 * b3 + 3 * b4 WHEN i = n - 1 THEN 9 * a1 + 13 * value + 12 * b1 + 6 * b2 - 5 * b3
 ELSE -3 * b2 + 12 * b1 + 17 * value + 12 * a1 - 3 * a2 END / 35.0::DOUBLE, 6) AS filled FROM r""")
def savitzky_golay_5_2(t):
    return tm.savitzky_golay(t.cube().select("cell_id", "time", "value"), 5, 2).select("cell_id", "time", r6("filled"))


# --- resampling ----------------------------------------------------------------------------------------


@query("five_day_mean", f"""WITH {CUBE}, o AS (SELECT MIN(time) AS a FROM cube) SELECT cell_id, a + CAST((time - a) // 5 * 5 AS INTEGER) AS time, ROUND(AVG(value), 6) AS value FROM cube, o GROUP BY 1, 2""")
def five_day_mean(t):
    return tm.n_day_mean(t.cube(), 5).select("cell_id", "time", r6("value"))


@query("weekly_mean", f"""WITH {CUBE} SELECT cell_id, CAST(time + INTERVAL (CASE WHEN DAYOFWEEK(time) = 0 THEN 0 ELSE 7 - DAYOFWEEK(time) END) DAY AS DATE) AS time,
 ROUND(AVG(value), 6) AS value, ROUND(AVG(value2), 6) AS value2 FROM cube GROUP BY 1, 2""")
def weekly_mean(t):
    return tm.weekly_mean(t.cube(), values=["value", "value2"]).select("cell_id", "time", r6("value"), r6("value2"))


@query("monthly_mean", f"""WITH {CUBE} SELECT cell_id, CAST(DATE_TRUNC('month', time) AS DATE) AS time, ROUND(AVG(value), 6) AS value FROM cube GROUP BY 1, 2""")
def monthly_mean(t):
    return tm.monthly_mean(t.cube()).select("cell_id", "time", r6("value"))


@query("dekad_maximum", f"""WITH {CUBE} SELECT cell_id, MAKE_DATE(YEAR(time), MONTH(time), CASE WHEN DAY(time) <= 10 THEN 1 WHEN DAY(time) <= 20 THEN 11 ELSE 21 END) AS time, MAX(value) AS value FROM cube GROUP BY 1, 2""")
def dekad_maximum(t):
    return tm.dekad_max(t.cube()).select("cell_id", "time", "value")


@query("quarter_extremes", f"""WITH {CUBE}, q AS (SELECT *, DATE_TRUNC('quarter', DATE_TRUNC('month', time) - INTERVAL 2 MONTH) AS k FROM cube)
SELECT cell_id, time, MAX(value) OVER w AS wet_max, MIN(value) OVER w AS dry_min, MAX(value) OVER w - value AS diff_max, value - MIN(value) OVER w AS diff_min FROM q WINDOW w AS (PARTITION BY cell_id, k)""")
def quarter_extremes(t):
    return tm.quarter_extremes(t.cube()).select("cell_id", "time", "wet_max", "dry_min", "diff_max", "diff_min")


@query("slot_composite", """SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, MAX(l_quantity) AS value FROM lineitem GROUP BY 1, 2""")
def slot_composite(t):
    """The slot (line number) is a column: one scan holds all slots of a day."""
    return tm.composite_max(t.lineitem.select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("time"), "l_linenumber", F.col("l_quantity").alias("value")))


HOURLY = """hourly AS (SELECT user_id AS cell_id, DATE_TRUNC('hour', ts) AS time, SUM(CAST(ROUND(value * 100) AS BIGINT)) / 100000.0::DOUBLE AS tp, MAX(value) AS t2m FROM events GROUP BY 1, 2)"""


def hourly(t):
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return t.events.groupBy(F.col("user_id").alias("cell_id"), F.date_trunc("hour", F.col("ts")).alias("time")).agg((cents / 100000.0).alias("tp"), F.max("value").alias("t2m"))


@query("daily_rain_from_hourly", f"""WITH {HOURLY}, s AS (SELECT cell_id, time, LAG(tp) OVER (PARTITION BY cell_id ORDER BY time) AS tp FROM hourly)
SELECT cell_id, CAST(time AS DATE) AS time, ROUND(GREATEST(COALESCE(SUM(tp * 1000), 0), 0), 6) AS tp FROM s GROUP BY 1, 2""")
def daily_rain_from_hourly(t):
    return tm.daily_precipitation(hourly(t), "tp").select("cell_id", "time", r6("tp"))


@query("daily_temperature_range", f"""WITH {HOURLY} SELECT cell_id, CAST(time AS DATE) AS time, ROUND(MIN(t2m) - 273.15::DOUBLE, 6) AS t_min, ROUND(MAX(t2m) - 273.15::DOUBLE, 6) AS t_max FROM hourly GROUP BY 1, 2""")
def daily_temperature_range(t):
    return tm.daily_temperature(hourly(t), "t2m").select("cell_id", "time", r6("t_min"), r6("t_max"))


@query("daily_from_hourly_all", f"""WITH {HOURLY}, s AS (SELECT cell_id, time, LAG(tp) OVER w AS tp, LAG(t2m) OVER w AS t2m FROM hourly WINDOW w AS (PARTITION BY cell_id ORDER BY time))
SELECT cell_id, CAST(time AS DATE) AS time, ROUND(COALESCE(SUM(tp), 0), 6) AS tp, MIN(t2m) AS t2m_min, MAX(t2m) AS t2m_max FROM s GROUP BY 1, 2""")
def daily_from_hourly_all(t):
    return tm.hourly_to_daily(hourly(t), ["tp"], ["t2m"]).withColumn("tp", r6("tp"))


@query("dates_shifted", f"""WITH {CUBE}, m AS (SELECT MAX(time) AS last FROM cube) SELECT cell_id, time - 1 AS time, value FROM cube UNION ALL SELECT cell_id, time, value FROM cube, m WHERE time = last""")
def dates_shifted(t):
    return tm.shift_days(t.cube().select("cell_id", "time", "value"), -1, add_last_day=True)


@query("amount_as_rate", f"""WITH {CUBE}, s AS (SELECT *, COALESCE(LEAD(time) OVER w - time, time - LAG(time) OVER w) * 86400 AS step FROM cube WINDOW w AS (PARTITION BY cell_id ORDER BY time))
SELECT cell_id, time, ROUND(value / NULLIF(step, 0), 9) AS rate FROM s""")
def amount_as_rate(t):
    return t.cube().select("cell_id", "time", F.round(tm.amount_to_rate("value"), 9).alias("rate"))


@query("smallest_step_hours", f"""WITH {CUBE}, s AS (SELECT LEAD(time) OVER (PARTITION BY cell_id ORDER BY time) - time AS d FROM cube) SELECT MIN(d) * 24.0::DOUBLE AS hours FROM s""")
def smallest_step_hours(t):
    return tm.temporal_resolution_hours(t.cube())


@query("every_tenth_day", f"""WITH {CUBE}, o AS (SELECT MIN(time) AS a FROM cube) SELECT cell_id, time, value FROM cube, o WHERE (time - a) % 10 = 0""")
def every_tenth_day(t):
    return tm.every_nth_day(t.cube(), 10).select("cell_id", "time", "value")


# --- climatology ---------------------------------------------------------------------------------------


@query("monthly_anomaly", f"""WITH {CUBE} SELECT cell_id, time, ROUND(value - AVG(value) OVER (PARTITION BY cell_id, MONTH(time)), 6) AS anomaly FROM cube""")
def monthly_anomaly(t):
    return clim.monthly_anomaly(t.cube()).select("cell_id", "time", r6("anomaly"))


@query("anomaly_from_monthly_maximum", f"""WITH {CUBE} SELECT cell_id, time, value - MAX(value) OVER (PARTITION BY cell_id, MONTH(time)) AS anomaly FROM cube""")
def anomaly_from_monthly_maximum(t):
    return clim.monthly_anomaly(t.cube(), against="max").select("cell_id", "time", "anomaly")


@query("anomaly_within_month", f"""WITH {CUBE} SELECT cell_id, time, ROUND(value - AVG(value) OVER (PARTITION BY cell_id, DATE_TRUNC('month', time)), 6) AS anomaly FROM cube""")
def anomaly_within_month(t):
    return clim.within_month_anomaly(t.cube()).select("cell_id", "time", r6("anomaly"))


@query("relative_monthly_anomaly", f"""WITH {CUBE}, m AS (SELECT cell_id, CAST(DATE_TRUNC('month', time) AS DATE) AS time, AVG(value) AS v FROM cube GROUP BY 1, 2)
SELECT cell_id, time, ROUND((v - AVG(v) OVER w) / AVG(v) OVER w, 6) AS against_mean, ROUND((v - MAX(v) OVER w) / MAX(v) OVER w, 6) AS against_max FROM m WINDOW w AS (PARTITION BY cell_id, MONTH(time))""")
def relative_monthly_anomaly(t):
    mean = clim.relative_monthly_anomaly(t.cube()).select("cell_id", "time", r6("anomaly", "against_mean"))
    top = clim.relative_monthly_anomaly(t.cube(), against="max").select("cell_id", "time", r6("anomaly", "against_max"))
    return mean.join(top, ["cell_id", "time"])


@query("standardised_by_day_of_year", f"""WITH {CUBE} SELECT cell_id, time, ROUND((value - AVG(value) OVER w) / NULLIF(STDDEV_POP(value) OVER w, 0), 6) AS svi FROM cube WINDOW w AS (PARTITION BY cell_id, DAYOFYEAR(time))""")
def standardised_by_day_of_year(t):
    return clim.standardised(t.cube()).select("cell_id", "time", r6("svi"))


@query("condition_index", f"""WITH {CUBE} SELECT cell_id, time, ROUND(100 * (value - MIN(value) OVER w) / NULLIF(MAX(value) OVER w - MIN(value) OVER w, 0), 6) AS vci FROM cube WINDOW w AS (PARTITION BY cell_id, DAYOFYEAR(time))""")
def condition_index(t):
    return clim.condition_index(t.cube()).select("cell_id", "time", r6("vci"))


@query("domain_mean_and_median", f"""WITH {CUBE} SELECT time, ROUND(AVG(value), 6) AS mean, ROUND(MEDIAN(value), 6) AS median FROM cube GROUP BY 1""")
def domain_mean_and_median(t):
    return clim.domain_series(t.cube()).select("time", r6("mean"), r6("median"))


@query("cell_mean_and_median", f"""WITH {CUBE} SELECT cell_id, ROUND(AVG(value), 6) AS mean, ROUND(MEDIAN(value), 6) AS median FROM cube GROUP BY 1""")
def cell_mean_and_median(t):
    return clim.domain_series(t.cube(), by=("cell_id",), bounded=True).select("cell_id", r6("mean"), r6("median"))


@query("day_of_year_distribution", f"""WITH {CUBE} SELECT CAST(DAYOFYEAR(time) AS INTEGER) AS doy, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25,
 ROUND(MEDIAN(value), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75 FROM cube GROUP BY 1""")
def day_of_year_distribution(t):
    return clim.day_of_year_distribution(t.cube()).select("doy", "n", r6("mean"), r6("q25"), r6("median"), r6("q75"))


@query("day_distribution_in_season", f"""WITH {CUBE} SELECT STRFTIME(time, '%m-%d') AS month_day, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25,
 ROUND(MEDIAN(value), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75 FROM cube WHERE YEAR(time) IN (1996, 1997) AND MONTH(time) IN (3, 4, 5) GROUP BY 1""")
def day_distribution_in_season(t):
    out = clim.day_of_year_distribution(t.cube(), years=[1996, 1997], months=[3, 4, 5], key="month_day")
    return out.select("month_day", "n", r6("mean"), r6("q25"), r6("median"), r6("q75"))


@query("one_year_against_all", f"""WITH {CUBE} SELECT STRFTIME(time, '%m-%d') AS month_day, ROUND(AVG(value) FILTER (YEAR(time) = 1998), 6) AS year_mean, ROUND(AVG(value), 6) AS all_mean,
 ROUND(MEDIAN(value) FILTER (YEAR(time) = 1998), 6) AS year_median, ROUND(MEDIAN(value), 6) AS all_median FROM cube GROUP BY 1 HAVING COUNT(*) FILTER (YEAR(time) = 1998) > 0 AND STRFTIME(time, '%m-%d') <> '12-31'""")
def one_year_against_all(t):
    out = clim.year_against_all(t.cube(), 1998, drop_last_day=True)
    return out.select("month_day", r6("year_mean"), r6("all_mean"), r6("year_median"), r6("all_median"))


@query("dry_share_by_product", """WITH d AS (SELECT l_returnflag AS product, l_linenumber AS latency, l_suppkey, CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT product, latency, CAST(DAYOFYEAR(time) AS INTEGER) AS doy, ROUND(AVG(CAST(v <= 10 AS INTEGER)), 6) AS share FROM d GROUP BY 1, 2, 3""")
def dry_share_by_product(t):
    daily = t.lineitem.groupBy(F.col("l_returnflag").alias("product"), F.col("l_linenumber").alias("latency"), "l_suppkey", F.to_date("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("v"))
    from drygrid.functions.values import drought_flag

    return clim.flag_share(daily.withColumn("flag", drought_flag(F.col("v"), 10.0)), "flag").withColumn("share", r6("share"))


# --- audits --------------------------------------------------------------------------------------------


@query("negative_value_days", f"""WITH {CUBE} SELECT time, COUNT(*) FILTER (value - 5 < 0) AS negatives FROM cube GROUP BY 1 HAVING COUNT(*) FILTER (value - 5 < 0) > 0""")
def negative_value_days(t):
    return quality.negative_days(t.cube().withColumn("value", F.col("value") - 5))


@query("null_share_by_day", f"""WITH {FILLED}, d AS (SELECT time, COUNT(value) AS valid FROM filled GROUP BY 1), m AS (SELECT MAX(valid) AS points FROM d)
SELECT time, valid, ROUND(1 - valid / points, 6) AS null_share FROM d, m""")
def null_share_by_day(t):
    return quality.null_share_by_day(t.filled()).withColumn("null_share", r6("null_share"))


@query("coverage_summary", f"""WITH {FILLED}, d AS (SELECT time, COUNT(value) AS n FROM filled GROUP BY 1) SELECT MAX(n) AS points, ROUND(FLOOR(AVG(n)) / MAX(n), 2) AS valid_share FROM d""")
def coverage_summary(t):
    return quality.coverage(t.filled())


@query("null_audit", f"""WITH {FILLED}, a AS (SELECT COUNT(*) AS r, COUNT(DISTINCT cell_id) AS c, COUNT(value) AS k1, COUNT(NULLIF(value2, 1)) AS k2 FROM filled)
SELECT 'value' AS variable, r AS rows, r - k1 AS nulls, k1 AS known, ROUND((r - k1) / c, 6) AS nulls_per_cell FROM a UNION ALL SELECT 'value2', r, r - k2, k2, ROUND((r - k2) / c, 6) FROM a""")
def null_audit(t):
    return quality.null_audit(t.filled().withColumn("value2", F.nullif(F.col("value2"), F.lit(1.0))), ["value", "value2"]).withColumn("nulls_per_cell", r6("nulls_per_cell"))


@query("extreme_value_times", f"""WITH {CUBE} SELECT (SELECT time FROM cube ORDER BY value DESC, time DESC LIMIT 1) AS time_max, (SELECT MAX(value) FROM cube) AS value_max,
 (SELECT time FROM cube ORDER BY value, time LIMIT 1) AS time_min, (SELECT MIN(value) FROM cube) AS value_min""")
def extreme_value_times(t):
    return quality.extreme_times(t.cube())


@query("distinct_cells", """SELECT DISTINCT l_suppkey AS cell_id FROM lineitem""")
def distinct_cells(t):
    return quality.distinct_values(t.cube(), "cell_id")

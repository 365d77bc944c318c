"""Drought indices, events, transitions and smoothers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.formulas import digamma, gamma_ratio, normal_quantile, smoother, trigamma
from catalog.registry import CUBE, FILLED, query, r6
from drygrid.operators import climatology as clim, events, series as ser, spi as sp, temporal as tm

SCORED = f"""{FILLED}, rolled AS (SELECT cell_id, time, CASE WHEN COUNT(*) OVER w = 30 THEN SUM(COALESCE(value, 0)) OVER w END AS total
  FROM filled WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
z AS (SELECT cell_id, time, (total - AVG(total) OVER m) / NULLIF(STDDEV_POP(total) OVER m, 0) AS spi FROM rolled WINDOW m AS (PARTITION BY cell_id, MONTH(time)))"""


def scored(t):
    """30-day sums on a zero-filled calendar, standardised within cell and calendar month."""
    rolled = t.filled(fill=0.0).withColumn("value", tm.rolling("value", 30))
    return clim.standardised(rolled, by="month", out="spi").select("cell_id", "time", "spi")


RUNS = f"""{SCORED}, f AS (SELECT *, CASE WHEN spi >= -1 THEN 1 ELSE 0 END AS calm FROM z),
i AS (SELECT *, SUM(calm) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM f)"""


@query("drought_events", f"""WITH {RUNS}, e AS (SELECT cell_id, run, MIN(time) AS time, ABS(SUM(spi)) AS severity, COUNT(*) AS duration FROM i WHERE calm = 0 AND spi IS NOT NULL GROUP BY 1, 2)
SELECT cell_id, time, ROUND(severity, 6) AS severity, duration, ROUND(severity / duration, 6) AS intensity, YEAR(time) AS year, MONTH(time) AS month FROM e""")
def drought_events(t):
    return events.drought_runs(scored(t)).select("cell_id", "time", r6("severity"), "duration", r6("intensity"), "year", "month")


@query("drought_events_day_before_onset", f"""WITH {RUNS}, e AS (SELECT cell_id, run, MIN(time) AS time, ABS(SUM(spi) FILTER (calm = 0 AND spi IS NOT NULL)) AS severity, COUNT(*) FILTER (calm = 0 AND spi IS NOT NULL) AS duration FROM i GROUP BY 1, 2)
SELECT cell_id, time, ROUND(severity, 6) AS severity, duration FROM e WHERE duration > 0""")
def drought_events_day_before_onset(t):
    return events.drought_runs(scored(t), strict=True).select("cell_id", "time", r6("severity"), "duration")


@query("drought_events_after_warm_up", f"""WITH {SCORED}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time) AS pos FROM z), f AS (SELECT *, CASE WHEN spi >= -1 THEN 1 ELSE 0 END AS calm FROM k WHERE pos > 91),
i AS (SELECT *, SUM(calm) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM f), e AS (SELECT cell_id, run, MIN(time) AS time, COUNT(*) AS duration FROM i WHERE calm = 0 AND spi IS NOT NULL GROUP BY 1, 2)
SELECT cell_id, time, duration FROM e""")
def drought_events_after_warm_up(t):
    return events.drought_runs(scored(t), warm_up=90).select("cell_id", "time", "duration")


FLAGS = f"""{SCORED}, fl AS (SELECT *, CASE WHEN spi >= 1 THEN 1 ELSE 0 END AS wet, CASE WHEN spi <= -1 THEN 1 ELSE 0 END AS dry FROM z),
c AS (SELECT *, CASE WHEN COUNT(*) OVER w = 60 THEN SUM(wet) OVER w END AS wet_cond, CASE WHEN COUNT(*) OVER w = 60 THEN SUM(dry) OVER w END AS dry_cond
  FROM fl WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
tr AS (SELECT *, CASE WHEN wet_cond >= 1 AND dry = 1 THEN 1 ELSE 0 END AS dw, CASE WHEN dry_cond >= 1 AND wet = 1 THEN 1 ELSE 0 END AS wd FROM c)"""


def flagged(t):
    return events.transitions(scored(t), 60, dry_limit=-1.0, wet_limit=1.0)


@query("wet_dry_transitions", f"""WITH {FLAGS} SELECT cell_id, time, wet, dry, CAST(wet_cond AS BIGINT) AS wet_cond, CAST(dry_cond AS BIGINT) AS dry_cond, dw, wd FROM tr""")
def wet_dry_transitions(t):
    return flagged(t).select("cell_id", "time", "wet", "dry", "wet_cond", "dry_cond", "dw", "wd")


@query("dry_wet_by_season", f"""WITH {FLAGS}, s AS (SELECT tr.cell_id, n_name AS region, YEAR(time) AS year, (['DJF', 'MAM', 'JJA', 'SON'])[MONTH(time) % 12 // 3 + 1] AS season, AVG(dw) AS dw, AVG(wd) AS wd
 FROM tr JOIN supplier ON s_suppkey = tr.cell_id JOIN nation ON n_nationkey = s_nationkey WHERE YEAR(time) >= 1996 AND YEAR(time) < 2000 GROUP BY ALL)
SELECT region, year, season, ROUND(AVG(dw), 6) AS dw, ROUND(AVG(wd), 6) AS wd FROM s GROUP BY ALL""")
def dry_wet_by_season(t):
    places = t.cells().join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("cell_id", F.col("n_name").alias("region"))
    rows = flagged(t).join(places, "cell_id")
    return events.dry_wet_by_season(rows, year_start=1996, year_end=2000).select("region", "year", "season", r6("dw"), r6("wd"))


GAMMA = f"""{FILLED}, p AS (SELECT cell_id, time, DAYOFYEAR(time) AS doy, CASE WHEN COUNT(*) OVER w = 30 THEN AVG(COALESCE(value, 0)) OVER w END AS pr
  FROM filled WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
g AS (SELECT cell_id, time, pr, AVG(CAST(pr = 0 AS DOUBLE)) OVER d AS prob_zero, AVG(CASE WHEN pr > 0 THEN pr END) OVER d AS m, AVG(CASE WHEN pr > 0 THEN LN(pr) END) OVER d AS l
  FROM p WINDOW d AS (PARTITION BY cell_id, doy)),
a AS (SELECT *, CASE WHEN LN(m) - l > 1e-12 THEN LN(m) - l END AS a FROM g),
fit AS (SELECT *, (1 + SQRT(1 + 4 * a / 3)) / (4 * a) AS shape FROM a)"""


@query("spi_gamma_fit", f"""WITH {GAMMA} SELECT cell_id, time, ROUND(pr, 6) AS pr, ROUND(prob_zero, 6) AS prob_zero, ROUND(1 / shape, 6) AS inverse_shape, ROUND(m / shape, 6) AS scale FROM fit""")
def spi_gamma_fit(t):
    fit = sp.gamma_parameters(t.filled(fill=0.0), 30, method="APP")
    return fit.select("cell_id", "time", r6("pr"), r6("prob_zero"), r6(1 / F.col("shape"), "inverse_shape"), r6("scale"))


# The closed form and four Newton steps to the maximum likelihood shape.
LIKELY = GAMMA + "".join(f""",
fit{i + 1} AS (SELECT * EXCLUDE (shape), 1 / (1 / shape + (LN(shape) - {digamma('shape')} - a) / (shape * shape * (1 / shape - {trigamma('shape')}))) AS shape FROM fit{i or ''})""" for i in range(4))


def index_sql(fit: str) -> str:
    """Tables that end in ``s`` (cell_id, time, pr, spi) from a table of fits."""
    p = "(prob_zero + (1 - prob_zero) * CASE WHEN pr <= 0 THEN 0 ELSE g END)"
    return f""", c AS ({gamma_ratio(f"(SELECT *, pr / (m / shape) AS x FROM {fit})")}),
q AS (SELECT cell_id, time, pr, CASE WHEN pr IS NOT NULL AND shape IS NOT NULL THEN {p} END AS p FROM c),
s AS (SELECT cell_id, time, pr, CASE WHEN p IS NULL THEN NULL WHEN p <= 0 THEN -{sp.SPI_LIMIT} WHEN p >= 1 THEN {sp.SPI_LIMIT} ELSE GREATEST(LEAST({normal_quantile('p')}, {sp.SPI_LIMIT}), -{sp.SPI_LIMIT}) END AS spi FROM q)"""


@query("standardised_precipitation", f"""WITH {GAMMA}{index_sql('fit')} SELECT cell_id, time, ROUND(pr, 6) AS pr, ROUND(spi, 6) AS spi FROM s""")
def standardised_precipitation(t):
    return sp.spi(t.filled(fill=0.0), 30, method="APP").select("cell_id", "time", r6("pr"), r6("spi"))


@query("spi_by_maximum_likelihood", f"""WITH {LIKELY}{index_sql('fit4')} SELECT cell_id, time, ROUND(spi, 6) AS spi FROM s""")
def spi_by_maximum_likelihood(t):
    return sp.spi(t.filled(fill=0.0), 30, method="ML").select("cell_id", "time", r6("spi"))


@query("spi_drought_events", f"""WITH {LIKELY}{index_sql('fit4')}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time) AS pos FROM s),
f AS (SELECT *, CASE WHEN spi >= -1 THEN 1 ELSE 0 END AS calm FROM k WHERE pos > 31), i AS (SELECT *, SUM(calm) OVER (PARTITION BY cell_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM f),
e AS (SELECT cell_id, run, MIN(time) AS time, ABS(SUM(spi)) AS severity, COUNT(*) AS duration FROM i WHERE calm = 0 AND spi IS NOT NULL GROUP BY 1, 2)
SELECT cell_id, time, ROUND(severity, 6) AS severity, duration, ROUND(severity / duration, 6) AS intensity, YEAR(time) AS year, MONTH(time) AS month FROM e""")
def spi_drought_events(t):
    runs = events.drought_runs(sp.spi(t.filled(fill=0.0), 30).select("cell_id", "time", "spi"), warm_up=30, tasks=t.tasks())
    return runs.select("cell_id", "time", r6("severity"), "duration", r6("intensity"), "year", "month")


@query("whittaker_fixed_penalty", f"""WITH RECURSIVE {FILLED}, {smoother('filled', 'value', 10.0)} SELECT cell_id, time, value, ROUND(smoothed, 6) AS smoothed FROM filled JOIN curve USING (cell_id, time)""")
def whittaker_fixed_penalty(t):
    return ser.whittaker(t.filled(), lam=10.0).select("cell_id", "time", "value", r6("smoothed"))


@query("whittaker_v_curve")
def whittaker_v_curve(t):
    """Smoother on ten-day maxima: the penalty is chosen per cell."""
    dekads = tm.dekad_max(t.cube())
    return ser.whittaker(dekads).select("cell_id", "time", "value", r6("smoothed"), "lam")


@query("series_function", f"""WITH {CUBE} SELECT cell_id, COUNT(*) AS n, ROUND(MAX(value) - MIN(value), 6) AS spread FROM cube GROUP BY 1""")
def series_function(t):
    def spread(pdf):
        import pandas as pd

        return pd.DataFrame({"cell_id": [pdf["cell_id"].iloc[0]], "n": [len(pdf)], "spread": [pdf["value"].max() - pdf["value"].min()]})

    return ser.apply_series(t.cube().select("cell_id", "time", "value"), spread, "cell_id long, n long, spread double")

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.operators import climatology as clim, quality, quantiles, temporal as tm
from drygrid.operators.common import first_per_key


def values(df, cell=1, column="value"):
    return [r[column] for r in df.where(F.col("cell_id") == cell).orderBy("time").collect()]


def test_fill_calendar_bounds_and_duplicates(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2020, 2, 28), 1.0), (1, d(2020, 3, 2), 2.0), (1, d(2020, 3, 2), 3.0)], "cell_id long, time date, value double")
    out = tm.fill_calendar(df, start="2020-02-27", end="2020-03-03").orderBy("time", "value").collect()
    assert [(r.time.day, r.value) for r in out] == [(27, None), (28, 1.0), (29, None), (1, None), (2, 2.0), (2, 3.0), (3, None)]
    assert [r.time.day for r in tm.missing_days(df).orderBy("time").collect()] == [29, 1]


def test_rolling_and_fill(daily):
    assert values(daily.withColumn("value", tm.rolling("value", 3))) == [None, None, None, 6.0, None, None, None, None, 21.0, None]
    assert values(daily.withColumn("value", tm.forward_fill("value"))) == [None, 1.0, 2.0, 3.0, 3.0, 3.0, 6.0, 7.0, 8.0, 8.0]
    with pytest.raises(ValueError):
        tm.rolling("value", 3, "median")


def test_interpolation_does_not_extrapolate(daily):
    assert values(tm.interpolate(daily)) == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, None]
    assert values(tm.interpolate(daily, method="nearest")) == [None, 1.0, 2.0, 3.0, 3.0, 6.0, 6.0, 7.0, 8.0, None]
    assert values(tm.interpolate(daily), 2) == [None] * 10
    with pytest.raises(ValueError):
        tm.interpolate(daily, method="cubic")


def test_gap_streaks(daily):
    out = tm.gap_streaks(daily)
    assert values(out, 1, "streaks") == [None, 1, 0, 0, None, None, 2, 0, 0, 1]
    assert values(out, 1, "quality_flag") == [1, 0, 0, 0, 2, 2, 0, 0, 0, 1]
    assert values(out, 2, "quality_flag") == [10] * 10
    assert values(out, 2, "streaks") == [None] * 9 + [10]


def test_differences(daily):
    out = tm.nth_difference(daily.where("cell_id = 3"), 2)
    assert values(out, 3, "difference") == [0.0] * 8


@pytest.mark.parametrize("window,order", [(5, 2), (7, 3)])
def test_savitzky_golay_against_polynomials(spark, window, order):
    rng = np.random.default_rng(1)
    y = rng.normal(size=20)
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "cell_id long, time date, value double")
    got = values(tm.savitzky_golay(df, window, order), 1, "filled")
    half = window // 2
    for i in range(20):
        start = min(max(i - half, 0), 20 - window)
        fit = np.polyfit(np.arange(window), y[start:start + window], order)
        assert got[i] == pytest.approx(np.polyval(fit, i - start), abs=1e-8)
    with pytest.raises(ValueError):
        tm.savitzky_golay(df, 4, 2)


def test_resampling(daily):
    five = tm.n_day_mean(daily, 5)
    assert values(five) == [2.0, 7.0]
    assert values(tm.dekad_max(daily)) == [3.0, 8.0]
    moved = tm.shift_days(daily.where("cell_id = 3"), 1, add_last_day=True)
    assert moved.count() == 11 and moved.agg(F.max("time")).first()[0] == dt.date(2020, 3, 7)


def test_hourly_rain_is_shifted_and_floored(spark):
    t0 = dt.datetime(2020, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=h), 0.001 if h != 5 else -0.002) for h in range(48)]
    df = spark.createDataFrame(rows, "cell_id long, time timestamp, tp double")
    got = [r.tp for r in tm.daily_precipitation(df, "tp").orderBy("time").collect()]
    assert got == pytest.approx([20.0, 24.0])
    dry = df.withColumn("tp", F.lit(None).cast("double"))
    assert [r.tp for r in tm.daily_precipitation(dry, "tp").collect()] == [0.0, 0.0]


def test_condition_index_range_and_constant_cell(spark):
    rows = [(c, dt.date(y, 6, 15), float((y * 7 * c) % 11) if c != 3 else 4.0) for c in (1, 2, 3) for y in range(2000, 2010)]
    df = spark.createDataFrame(rows, "cell_id long, time date, value double")
    out = clim.condition_index(df)
    ends = out.where("cell_id < 3").agg(F.min("vci"), F.max("vci")).first()
    assert tuple(ends) == (0.0, 100.0)
    assert out.where("cell_id = 3 AND vci IS NOT NULL").count() == 0
    assert clim.standardised(df).where("cell_id = 3 AND svi IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        clim.monthly_anomaly(df, against="median")


def test_year_against_all_uses_month_day(spark):
    rows = [(1, dt.date(y, m, d), float(y)) for y in (2019, 2020, 2021) for m, d in ((2, 28), (3, 1), (12, 31))] + [(1, dt.date(2020, 2, 29), 1.0)]
    df = spark.createDataFrame(rows, "cell_id long, time date, value double")
    out = {r.month_day: r.all_mean for r in clim.year_against_all(df, 2019, drop_last_day=True).collect()}
    assert out == {"02-28": 2020.0, "03-01": 2020.0}


@pytest.mark.parametrize("accuracy", [40, 5000])
def test_exact_quantiles_with_a_hot_group(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "GRID", accuracy // 10)
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(size=6000), 2), "ties": np.repeat([1.0, 2.0], [4000, 1000]), "one": np.array([7.0]), "wide": rng.lognormal(0, 5, 3000)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, "v", probs, ["k"], "q").collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)
    whole = quantiles.exact_quantiles(df, "v", probs, name="q").first()[0]
    assert whole == pytest.approx(list(np.quantile(np.concatenate(list(groups.values())), probs)), rel=1e-12)


def test_quantiles_of_groups_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    sizes = [1, 2, 3, 4, 5, 7, 10, 33, 100, 499, 500, 501, 999, 4999, 5001, 9999, 10001, 30000]
    groups = {n: (np.round(rng.normal(size=n), 1) if n % 2 else rng.normal(size=n)) for n in sizes}
    df = spark.createDataFrame([(n, float(v)) for n, vs in groups.items() for v in vs], "k long, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for bounded in (False, True):
        got = {r.k: r.q for r in quantiles.exact_quantiles(df, "v", probs, ["k"], "q", bounded).collect()}
        for n, vs in groups.items():
            assert got[n] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12), n
    nothing = df.where("k < 0")
    assert quantiles.exact_quantiles(nothing, "v", probs).collect() == quantiles.exact_quantiles(nothing, "v", probs, bounded=True).collect() == []


def test_audits(daily):
    audit = quality.null_audit(daily, ["value"]).first()
    assert (audit.rows, audit.nulls, audit.known) == (30, 14, 16)
    assert audit.nulls_per_cell == pytest.approx(14 / 3)
    assert quality.coverage(daily).first().points == 2


def test_first_per_key_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 9, "c")], "k long, o long, v string")
    assert first_per_key(df, ["k"], "o").first().v == "a"
    assert first_per_key(df, ["k"], "o", last=True).first().v == "c"


def test_quantiles_when_each_scan_deals_rows_otherwise(spark, monkeypatch):
    """A sketch depends on which rows a task gets; without shared exchanges every use of it is another one."""
    rng = np.random.default_rng(4)
    vs = rng.normal(size=60_000)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vs)], "k int, v double").repartition(6)

    def stir(frames):
        rng = np.random.default_rng()
        for f in frames:
            yield f.assign(p=rng.integers(0, 1_000_000, len(f)))

    dealt = df.mapInPandas(stir, "k int, v double, p long").repartition(6, "p").drop("p")
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "GRID", 20)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.k: r.q for r in quantiles.exact_quantiles(dealt, "v", [0.0, 0.25, 0.5, 0.75, 1.0], ["k"], "q").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for k in range(3):
        assert got[k] == pytest.approx(list(np.quantile(vs[k::3], [0.0, 0.25, 0.5, 0.75, 1.0])), rel=1e-12)


def test_rows_of_few_hot_groups_stay_where_they_are(spark, monkeypatch):
    """Two groups hold all rows: their brackets and cuts come to the rows, so no task sorts half of the table."""
    seen = []
    monkeypatch.setattr(quantiles, "checkpointed", lambda df: seen.append(df) or df)
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.sqrt("id").alias("v"))
    quantiles.exact_quantiles(df, "v", [0.1, 0.5], ["k"], "q")
    assert sum(r._c for r in seen[-1].collect()) == 50_000
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.operators import events, series as ser, spi as sp


def frame(spark, values, name="spi", start=dt.date(2020, 1, 1)):
    return spark.createDataFrame([(1, start + dt.timedelta(days=i), v) for i, v in enumerate(values)], f"cell_id long, time date, {name} double")


def test_runs(spark):
    spi = [-2.0, -1.5, 0.0, -1.0, -1.2, None, -3.0, 0.5, None]
    out = events.drought_runs(frame(spark, spi)).orderBy("time").collect()
    assert [(r.time.day, r.severity, r.duration, r.intensity) for r in out] == [(1, 3.5, 2, 1.75), (5, pytest.approx(4.2), 2, pytest.approx(2.1))]
    strict = events.drought_runs(frame(spark, spi), strict=True).orderBy("time").collect()
    assert [r.time.day for r in strict] == [1, 4]  # the first run starts the series, the second follows day 4
    assert sum(r.duration for r in out) == sum(v is not None and v < -1 for v in spi)
    assert events.drought_runs(frame(spark, spi), warm_up=4).count() == 1


def test_transitions(spark):
    out = events.transitions(frame(spark, [2.0, 0.0, -2.0, None, 2.5]), 3).orderBy("time").collect()
    assert [(r.wet, r.dry, r.wet_cond, r.dw, r.wd) for r in out] == [(1, 0, None, 0, 0), (0, 0, None, 0, 0), (0, 1, 1, 1, 0), (0, 0, 0, 0, 0), (1, 0, 1, 0, 1)]


def test_season_table_rejects_other_groupings(spark):
    with pytest.raises(ValueError):
        events.dry_wet_by_season(frame(spark, [1.0]), aggr="month")


def brute_spi(pr, method):
    known = np.array([v for v in pr if v > 0])
    a = math.log(known.mean()) - np.log(known).mean()
    shape = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)
    if method == "ML":  # the root of ln(k) - digamma(k) = a by bisection on differences of lgamma
        low, high = shape / 2, shape * 2
        for _ in range(100):
            k = (low + high) / 2
            slope = (math.lgamma(k + 1e-4) - math.lgamma(k - 1e-4)) / 2e-4
            low, high = (k, high) if math.log(k) - slope > a else (low, k)
        shape = (low + high) / 2
    scale = known.mean() / shape
    p0 = np.mean(np.array(pr) == 0)
    out = []
    for x in pr:
        t = np.linspace(0, x, 200_001)[1:] if x > 0 else None
        g = 0.0 if t is None else np.trapezoid(np.exp((shape - 1) * np.log(t) - t / scale - math.lgamma(shape) - shape * math.log(scale)), t)
        p = p0 + (1 - p0) * g
        low, high = -9.0, 9.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
        out.append((low + high) / 2)
    return out


@pytest.mark.parametrize("method", ["ML", "APP"])
def test_spi_against_integration(spark, method):
    rng = np.random.default_rng(5)
    pr = [0.0] + [float(v) for v in rng.gamma(3.0, 2.0, 14)]
    rows = [(1, dt.date(2000 + i, 7, 1), v) for i, v in enumerate(pr)]
    df = spark.createDataFrame(rows, "cell_id long, time date, value double")
    # July 1st has one day of year in common and another in leap years: fit each apart.
    got = {r.time: r.spi for r in (sp.spi(df, 1) if method == "ML" else sp.spi(df, 1, method=method)).collect()}
    for leap in (True, False):
        part = [(d, v) for _, d, v in rows if (d.year % 4 == 0) == leap]
        for (d, _), want in zip(part, brute_spi([v for _, v in part], method)):
            assert got[d] == pytest.approx(want, abs=2e-4)


def test_spi_null_until_window_full_and_constant_cell(spark):
    rows = [(1, dt.date(2000 + i, 7, 1), 3.0) for i in range(6)]
    df = spark.createDataFrame(rows, "cell_id long, time date, value double")
    out = sp.spi(df, 2).orderBy("time").collect()
    assert out[0].pr is None and all(r.spi is None for r in out)
    with pytest.raises(ValueError):
        sp.spi(df, 2, method="MOM")


def test_maximum_likelihood_improves_the_fit(spark):
    rng = np.random.default_rng(8)
    x = rng.gamma(0.7, 3.0, 40)
    rows = [(1, dt.date(1900 + 4 * i, 7, 1) if i else dt.date(1904, 7, 1), float(v)) for i, v in enumerate(x) if i]
    df = spark.createDataFrame(rows, "cell_id long, time date, value double")
    data = x[1:]

    def likelihood(row):
        k, s = row.shape, row.scale
        return np.sum((k - 1) * np.log(data) - data / s - k * math.log(s) - math.lgamma(k))

    # All years are leap years, 1900 being left out, so the fit uses every row.
    fits = [sp.gamma_parameters(df, 1, method=m).select("shape", "scale").first() for m in ("APP", "ML")]
    assert likelihood(fits[1]) >= likelihood(fits[0])
    psi = [r[0] for r in spark.createDataFrame([(fits[1].shape,)], "k double").select(F.ln("k")).collect()]
    assert math.isfinite(psi[0])


# --- smoother ------------------------------------------------------------------------------------------


def dense(y, w, lam):
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)


def test_solver_against_dense_matrix():
    rng = np.random.default_rng(2)
    y, w = rng.normal(size=(3, 25)), (rng.random((3, 25)) > 0.3).astype(float)
    z = ser.solve_smoother(y, w, np.array([0.1, 1.0, 50.0]))
    for i, lam in enumerate((0.1, 1.0, 50.0)):
        assert np.allclose(z[i], dense(y[i], w[i], lam))


def test_v_curve_against_loops():
    rng = np.random.default_rng(4)
    n = 40
    y = np.sin(np.arange(n) / 5) + 0.2 * rng.normal(size=n)
    w = np.ones(n)
    w[[3, 17, 18]] = 0
    y = y * w
    exponents = np.round(np.arange(-2, 3, 0.2), 2)

    def asymmetric(lam, p):
        z = np.zeros(n)
        for _ in range(10):
            new = dense(y, w * np.where(y > z, p, 1 - p), lam)
            moved, z = np.abs(new - z).sum(), new
            if moved == 0:
                break
        return z

    zs = [asymmetric(10.0**e, 0.99) for e in exponents]
    fit = [math.log((w * (y - z) ** 2).sum()) for z in zs]
    rough = [math.log((np.diff(z, 2) ** 2).sum()) for z in zs]
    v = [math.hypot(fit[i + 1] - fit[i], rough[i + 1] - rough[i]) for i in range(len(zs) - 1)]
    k = int(np.argmin(v))
    lam = 10 ** ((exponents[k] + exponents[k + 1]) / 2)
    z, chosen, settled = ser.v_curve_smoother(y[None, :], w[None, :], exponents, 0.99)
    assert chosen[0] == pytest.approx(lam)
    assert np.allclose(z[0], asymmetric(lam, 0.99))


def test_whittaker_on_cubes(spark, daily):
    out = ser.whittaker(daily, lam=2.0)
    assert out.count() == 30
    assert out.where("cell_id = 2 AND smoothed IS NOT NULL").count() == 0
    flat = [r.smoothed for r in out.where("cell_id = 3").collect()]
    assert flat == pytest.approx([5.0] * 10)
    got = [r.smoothed for r in out.where("cell_id = 1").orderBy("time").collect()]
    y = np.array([0, 1, 2, 3, 0, 0, 6, 7, 8, 0.0])
    assert np.allclose(got, dense(y, np.array([0, 1, 1, 1, 0, 0, 1, 1, 1, 0.0]), 2.0))


def test_apply_series_sorts(spark, daily):
    out = ser.apply_series(daily.orderBy(F.col("time").desc()), lambda p: p.head(1)[["cell_id", "time"]], "cell_id long, time date")
    assert {r.time for r in out.collect()} == {dt.date(2020, 2, 25)}


def test_index_in_numpy_is_that_of_the_formulas(spark):
    """The shape by four Newton steps and the clipped index against the column expressions they replace."""
    from drygrid.functions import special as sp

    rows = [(float(x), a, z) for x in (0.0, 0.4, 3.0, 40.0, 1e6) for a in (0.003, 0.05, 0.4, 2.0, None) for z in (0.0, 0.3, 1.0)] + [(None, 0.4, 0.2)]
    df = spark.createDataFrame(rows, "x double, a double, zero double").withColumn("shape", (1 + F.sqrt(1 + 4 * F.col("a") / 3)) / (4 * F.col("a")))
    for _ in range(4):
        k = F.col("shape")
        df = df.withColumn("shape", 1 / (1 / k + (F.ln(k) - sp.digamma(k) - F.col("a")) / (k * k * (1 / k - sp.trigamma(k)))))
    df = df.withColumn("shape", F.when(F.col("a").isNotNull(), F.col("shape"))).withColumn("scale", F.lit(2.5))
    g = F.when(F.col("x") <= 0, F.lit(0.0)).otherwise(sp.gamma_cdf("x", "shape", "scale"))
    p = F.col("zero") + (1 - F.col("zero")) * F.when(F.col("x").isNotNull() & F.col("shape").isNotNull(), g)
    q = F.when(p <= 0, F.lit(-8.21)).when(p >= 1, F.lit(8.21)).otherwise(F.greatest(F.least(sp.normal_quantile(p), F.lit(8.21)), F.lit(-8.21)))
    want = F.when(p.isNotNull(), q)
    got = df.select("shape", sp.likely_shape("a").alias("k"), want.alias("want"), sp.gamma_score("x", "shape", "scale", "zero", F.lit(8.21)).alias("got")).collect()
    for r in got:
        assert (r.k is None) == (r.shape is None) and (r.k is None or r.k == pytest.approx(r.shape, rel=1e-10))
        assert (r.got is None) == (r.want is None) and (r.got is None or r.got == pytest.approx(r.want, abs=1e-9)), r


def test_series_are_dealt_by_the_size_of_their_calendar(spark):
    """Two rows a cell, but 4,000 days each: as many tasks as the calendar needs, not as the rows do."""
    from drygrid.operators import common, temporal as tm

    df = spark.range(200).select(F.col("id").alias("cell_id"), F.explode(F.array(F.to_date(F.lit("2000-01-01")), F.to_date(F.lit("2010-12-13")))).alias("time"), F.lit(1.0).alias("value"))
    tasks = common.series_tasks(df, rows=50_000, least=50_000)
    assert 13 <= tasks <= 19
    filled = tm.fill_calendar(df, tasks=tasks)
    assert filled.count() == 200 * 4000
    sizes = filled.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 200_000
    assert common.series_tasks(df.where("cell_id < 0")) == 2

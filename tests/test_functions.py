import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.functions import calendar as cal, cover, grid, special, values as val, vegetation as veg


def one(spark, *columns, **fields):
    names = list(fields)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) or v is None else 'string' if isinstance(v, str) else 'date' if isinstance(v, dt.date) else 'long'}" for n, v in fields.items())
    return spark.createDataFrame([tuple(fields[n] for n in names)], schema).select(*columns).first()


def test_null_rules(spark):
    x = F.col("x")
    row = one(spark, val.floor_at_zero(x), val.floor_at_zero(x, True), val.drought_flag(x), val.rain_flag(x), val.clamp(x), val.wet_flag(x), x=None)
    assert tuple(row) == (None, 0.0, None, 0, None, 0)
    row = one(spark, val.drought_flag(x), val.clamp(x), val.null_outside(x), val.dry_flag(x), x=-2.0)
    assert tuple(row) == (1, -1.0, None, 1)
    assert tuple(one(spark, val.low_flag(x), val.rain_flag(F.col("y")), x=10.0, y=1.0)) == (0, 0)


def test_nan_becomes_null(spark):
    df = val.declare_missing(spark.createDataFrame([(float("nan"), "3.5", 1), (2.0, "x", 2)], "a double, b string, c int"), parse=True)
    assert [tuple(r) for r in df.orderBy("c").collect()] == [(None, 3.5, 1), (2.0, None, 2)]
    assert df.agg(F.avg("a")).first()[0] == 2.0


def test_scaling_round_trip_and_passthrough(spark):
    x, lo, hi = F.col("x"), F.lit(2.0), F.lit(6.0)
    assert one(spark, val.min_max_restore(val.min_max_scale(x, lo, hi), lo, hi), x=3.0)[0] == 3.0
    assert one(spark, val.min_max_restore(x, lo, hi, null_value=-1.0), x=-1.0)[0] == -1.0
    assert one(spark, val.min_max_scale(x, lo, lo), x=3.0)[0] is None
    assert one(spark, val.z_restore(val.z_scale(x, lo, hi), lo, hi), x=3.0)[0] == 3.0


def test_ndvi_and_radiance(spark):
    assert one(spark, veg.ndvi(F.col("a"), F.col("b")), a=0.0, b=0.0)[0] is None
    assert one(spark, veg.ndvi(F.col("a"), F.col("b")), a=1.0, b=3.0)[0] == 0.5
    name = F.col("n")
    assert one(spark, veg.radiance(F.col("a"), name, 0), a=65.2065, n="MSG2-x")[0] == pytest.approx(1.0)
    assert one(spark, veg.radiance(F.col("a"), name, 0), a=7.0, n="OTHER")[0] == 7.0
    assert one(spark, veg.unpack_byte_ndvi(F.col("a")), a=255.0)[0] is None
    q = F.col("q")
    assert tuple(one(spark, veg.qa_cloudy(q), veg.qa_water(q), veg.bit_field(q, 6, 7), q=64)) == (1, 1, 1)


def test_calendar_keys(spark):
    d = F.col("d")
    row = one(spark, cal.dekad(d), cal.march_quarter(d), cal.week_end(d), cal.season(d), cal.month_day(d), d=dt.date(2020, 2, 29))
    assert tuple(row) == (dt.date(2020, 2, 21), dt.date(2019, 12, 1), dt.date(2020, 3, 1), "DJF", "02-29")
    assert one(spark, cal.week_end(d), d=dt.date(2020, 3, 1))[0] == dt.date(2020, 3, 1)
    assert one(spark, cal.sinusoid_at(d, F.lit(5)), d=dt.date(2020, 1, 1))[0] == 1.0


def test_grid(spark):
    mesh = grid.pixel_grid(spark, 3, 2, (0.0, 4.0), (10.0, 11.0)).orderBy("cell_id").collect()
    assert [(r.lat, r.lon) for r in mesh] == [(0.0, 10.0), (0.0, 11.0), (2.0, 10.0), (2.0, 11.0), (4.0, 10.0), (4.0, 11.0)]
    assert one(spark, grid.roll_longitude(F.col("x")), x=190.0)[0] == -170.0
    assert one(spark, grid.arc_row(F.col("x"), -90, 0.5), x=89.75)[0] == 0  # half to even
    km = one(spark, grid.haversine_km(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1.0)), a=0.0, b=0.0)[0]
    assert km == pytest.approx(math.pi / 180 * 6371.0088)


def test_cover(spark):
    table = {r.code: r.level1 for r in cover.cover_table(spark).collect()}
    assert table[111] == 11 and table[126] == 12 and table[100] == 100 and table[200] == 200
    codes = spark.createDataFrame([(111,), (122,), (20,), (None,)], "code int")
    assert [(r.level, r.description) for r in cover.levels(codes, one_forest=True).collect()] == [(11, "Forest"), (20, "Shrubland")]


def test_special_columns(spark):
    xs = [0.05, 0.5, 1.0, 3.3, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, row in zip(xs, df.select(special.log_gamma(F.col("x")), special.digamma(F.col("x")), special.trigamma(F.col("x"))).collect()):
        assert row[0] == pytest.approx(math.lgamma(x), abs=1e-10)
        h = 1e-5 * max(x, 0.1)
        assert row[1] == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5)
        assert row[2] > 0
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    qs = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p"))).collect()]
    for p, q in zip(ps, qs):
        assert 0.5 * math.erfc(-q / math.sqrt(2)) == pytest.approx(p, abs=1e-8)
    assert spark.range(1).select(special.normal_quantile(F.lit(0.0))).first()[0] is None


@pytest.mark.parametrize("a", [0.3, 1.0, 7.5, 90.0, 150.0, 4000.0])
def test_incomplete_gamma_against_integration(a):
    for ratio in (0.7, 0.95, 1.0, 1.1, 1.4):
        x = a * ratio
        t = np.linspace(max(0.0, a - 14 * math.sqrt(a)), x, 400_001) if a > 5 else None
        if t is None:
            u = np.linspace(0, 1, 400_001)[1:]  # t = x u^(1/a) removes the pole at 0
            want = np.exp(a * math.log(x) - math.lgamma(a + 1)) * np.trapezoid(np.exp(-x * u ** (1 / a)), u)
        else:
            y = np.zeros_like(t)
            pos = t > 0
            y[pos] = np.exp((a - 1) * np.log(t[pos]) - t[pos] - math.lgamma(a))
            want = np.trapezoid(y, t)
        assert special.regularised_gamma(np.array([a]), np.array([x]))[0] == pytest.approx(want, abs=2e-5)


def test_incomplete_beta():
    want = sum(math.comb(49, j) * 0.6**j * 0.4 ** (49 - j) for j in range(30, 50))
    assert special.regularised_beta(np.array([30.0]), np.array([20.0]), np.array([0.6]))[0] == pytest.approx(want, abs=1e-12)
    assert special.regularised_beta(np.array([0.5]), np.array([0.5]), np.array([0.7]))[0] == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.7)))


def test_t_critical(spark):
    df = spark.createDataFrame([(1,), (2,), (29,), (30,), (500,)], "n long")
    assert [r[0] for r in df.select(special.t_critical(F.col("n"))).collect()] == [None, 12.706, 2.048, 1.96, 1.96]
    with pytest.raises(ValueError):
        special.t_critical(F.col("n"), 0.5)

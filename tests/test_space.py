import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from drygrid.functions.grid import GridSpec
from drygrid.operators import align as al, regrid, spatial, subset as sub


@pytest.fixture
def plane(spark):
    rows = [(r * 6 + c, 10.0 + r, 20.0 + 0.5 * c, dt.date(2020, 1, 1), 2.0 * (10 + r) - 3.0 * (20 + 0.5 * c)) for r in range(5) for c in range(6)]
    return spark.createDataFrame(rows, "cell_id long, lat double, lon double, time date, value double")


GRID = GridSpec(10.0, 20.0, 1.0, 0.5)


def test_bilinear_reproduces_a_plane(spark, plane):
    target = spark.createDataFrame([(1, 11.3, 21.2), (2, 10.0, 20.0), (3, 14.0, 22.5), (4, 12.5, 20.5)], "cell_id long, lat double, lon double")
    out = {r.cell_id: r.value for r in regrid.regrid_bilinear(plane, target, GRID).collect()}
    for r in target.collect():
        assert out[r.cell_id] == pytest.approx(2 * r.lat - 3 * r.lon)


def test_bilinear_drops_missing_corners(spark, plane):
    holes = plane.withColumn("value", F.when(F.col("cell_id") != 0, F.col("value")))
    target = spark.createDataFrame([(1, 10.5, 20.25)], "cell_id long, lat double, lon double")
    got = regrid.regrid_bilinear(holes, target, GRID).first().value
    assert got == pytest.approx(np.mean([2 * 10 - 3 * 20.5, 2 * 11 - 3 * 20, 2 * 11 - 3 * 20.5]))


def test_nearest_and_majority(spark, plane):
    target = spark.createDataFrame([(1, 10.4, 20.2), (2, 99.0, 0.0)], "cell_id long, lat double, lon double")
    assert [(r.cell_id, r.value) for r in regrid.regrid_nearest(plane, target, GRID).collect()] == [(1, 2 * 10 - 3 * 20.0)]
    cover = spark.createDataFrame([(10.1, 20.1, 30), (9.9, 20.0, 20), (10.2, 19.9, None), (11.0, 20.0, 80)], "lat double, lon double, code int")
    assert [(r.row, r.col, r.code) for r in regrid.regrid_majority(cover, GRID).orderBy("row").collect()] == [(0, 0, 20), (1, 0, 80)]


def test_lookup_layers(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "cell_id long, lat double, lon double")
    rasters = spark.createDataFrame([("elevation", 2, 2, -5.0), ("slope1", 2, 2, 1234.0), ("SQ1", 1, 3, 4.0)], "layer string, row int, col int, value double")
    out = regrid.lookup_layers(cells, rasters, -1, -1, 0.5, ["elevation", "slope1", "SQ1"]).orderBy("cell_id").collect()
    assert [(r.elevation, r.slope1, r.SQ1) for r in out] == [(None, 0.1234, 0.0), (0.0, 0.0, 0.0)]


def inside(lon, lat, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 <= lat) != (y2 <= lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_ray_casting_against_loop(spark):
    rng = np.random.default_rng(6)
    rings = {"star": [(0, 0), (4, 1), (8, 0), (5, 4), (6, 9), (3, 5)], "box": [(5, 5), (9, 5), (9, 9), (5, 9)]}
    data = [(name, 0, [(float(x), float(y)) for x, y in ring]) for name, ring in rings.items()]
    edges = spatial.polygon_edges(spark.createDataFrame(data, "region string, ring_id int, points array<struct<lon:double,lat:double>>"))
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-1, 10, (300, 2)))] + [(900, 5.0, 5.0), (901, 9.0, 9.0)]
    cells = spark.createDataFrame(points, "cell_id long, lat double, lon double")
    got = {(r.cell_id, r.region) for r in spatial.assign_region(cells, edges, band=0.7).collect()}
    assert got == {(i, n) for i, lat, lon in points for n, ring in rings.items() if inside(lon, lat, ring)}


def test_overlapping_polygons_of_a_country_do_not_cancel(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    data = [("a", "X", 0, square), ("b", "X", 0, square)]
    rings = spark.createDataFrame(data, "region string, country string, ring_id int, points array<struct<lon:double,lat:double>>")
    edges = spatial.polygon_edges(rings).join(rings.select("region", "country"), "region")
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "cell_id long, lat double, lon double")
    assert [r.cell_id for r in spatial.clip_to_regions(cells, edges, countries=["X"]).collect()] == [1]
    assert [r.cell_id for r in spatial.clip_to_regions(cells, edges, regions=["a"], outside=True).collect()] == [2]
    for wrong in ({}, {"countries": ["X"], "regions": ["a"]}):
        with pytest.raises(ValueError):
            spatial.clip_to_regions(cells, edges, **wrong)


def test_zonal_means(spark):
    df = spark.createDataFrame([("r", 1, 0.0, 2.0), ("r", 1, 60.0, 5.0), ("r", 1, 10.0, None)], "region string, time int, lat double, value double")
    assert spatial.zonal_mean(df).first()["mean"] == 3.5
    assert spatial.zonal_mean(df, strict=True).first()["mean"] == pytest.approx(7 / 3)
    assert spatial.zonal_mean(df, weighted=True).first()["mean"] == pytest.approx((2 + 5 * 0.5) / 1.5)


def test_nearest_fill_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for day in range(3):
        for r in range(7):
            for c in range(9):
                known = rng.random() < (0.15 if day else 0.0)
                rows.append((day, r * 9 + c, float(r), c * 0.5, float(rng.integers(100)) if known else None))
    df = spark.createDataFrame(rows, "time int, cell_id long, lat double, lon double, value double")
    got = {(r.time, r.cell_id): r.value for r in spatial.fill_nearest_in_space(df).collect()}
    assert len(got) == len(rows)
    for day, cell, lat, lon, value in rows:
        cands = [(round((lat - b) ** 2 + (lon - x) ** 2, 9), b, x, v) for d, _, b, x, v in rows if d == day and v is not None]
        want = value if value is not None else (min(cands)[3] if cands else None)
        assert got[day, cell] == want
    near = spatial.fill_nearest_in_space(df, max_distance=0.5)
    assert near.where("value IS NULL").count() > df.where("time = 0").count()


@given(st.integers(1, 4), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_lines_are_filled_from_the_nearest_candidate(lines, cells, seed):
    """Against all pairs, with many ties and candidates of several latitudes."""
    rng = np.random.default_rng(seed)
    line, x = np.repeat(np.arange(lines), cells), np.tile(np.arange(cells) * 0.5, lines)
    y = np.repeat(rng.integers(0, 4, lines).astype(float), cells)
    cy = y + rng.integers(-3, 4, len(x))
    cv = np.where(rng.random(len(x)) < 0.5, rng.integers(0, 99, len(x)).astype(float), np.nan)
    v = np.where((rng.random(len(x)) < 0.4) & ~np.isnan(cv), cv, np.nan)
    got = spatial._fill_lines(line, y, x, v, cy, cv, np.inf)
    for i in range(len(x)):
        near = [(round((x[i] - x[j]) ** 2 + (cy[j] - y[i]) ** 2, 9), cy[j], x[j], cv[j]) for j in range(len(x)) if line[j] == line[i] and not np.isnan(cv[j])]
        want = v[i] if not np.isnan(v[i]) else min(near)[3] if near else np.nan
        assert got[i] == want or (np.isnan(got[i]) and np.isnan(want))


def test_align_and_periods(spark):
    d = dt.datetime
    a = spark.createDataFrame([(1, d(2020, 1, 1, 6), 1.0), (1, d(2020, 1, 1, 18), 2.0), (1, d(2020, 1, 2), 3.0)], "cell_id long, time timestamp, a double")
    b = spark.createDataFrame([(1, d(2020, 1, 1, 12), 9.0), (1, d(2020, 1, 4), 8.0)], "cell_id long, time timestamp, b double")
    assert [(r.a, r.b) for r in al.align(a, b).collect()] == [(1.0, 9.0)]
    with pytest.raises(ValueError):
        al.align(a)
    with pytest.raises(ValueError):
        al.common_period(a, b)  # January 2nd is missing in b
    left, _ = al.common_period(a, b, strict=False)
    assert left.count() == 3
    late = b.withColumn("time", F.lit(d(2021, 1, 1)))
    assert al.common_period(a, late, strict=False)[0].count() == 3
    with pytest.raises(ValueError):
        al.common_period(a, late)


def test_axis_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "X int, latitude int, spatial_ref int")
    assert al.axis_name(df, "lon") == "X" and al.axis_name(df, "lat") == "latitude"
    assert al.axis_name(df.drop("X"), "lon") is None
    assert al.rename_axes(df).columns == ["lon", "lat"]
    assert al.swap_axes(al.rename_axes(df)).columns == ["lat", "lon"]


def test_selection_guards(spark, daily):
    with pytest.raises(ValueError):
        sub.random_cells(daily, 9)
    assert sub.random_cells(daily, 2).count() == 2
    assert sub.random_cells(daily, 2, value="value").where("cell_id = 2").count() == 0
    with pytest.raises(ValueError):
        sub.on_date(daily, "1990-01-01", time="time", check=True)
    with pytest.raises(ValueError):
        sub.corner_crop(daily, 2, "middle")
    with pytest.raises(ValueError):
        sub.clear_sky_ndvi(daily, daily)
    assert sub.drop_empty_cells(daily).where("cell_id = 2").count() == 0


def test_cloud_mask_values(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(c, day, 1.0) for c in range(4)], "cell_id long, time date, value double")
    mask = spark.createDataFrame([(0, day, 0), (1, day, 1), (2, day, 2)], "cell_id long, time date, cloud_mask int")
    assert {r.cell_id: r.value for r in sub.apply_cloud_mask(df, mask).collect()} == {0: 1.0, 1: 1.0, 2: None}
    assert {r.cell_id: r.value for r in sub.apply_cloud_mask(df, mask, align=False).collect()} == {0: 1.0, 1: 1.0, 2: None, 3: 1.0}


def test_impute(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, None), (0, 1.0, 2.0, 5.0)], "time int, lat double, lon double, value double")
    assert sorted(r.value for r in spatial.impute(df, "constant", fill=-1).collect()) == [-1.0, 5.0]
    assert [r.value for r in spatial.impute(df, "nearest").collect()] == [5.0, 5.0]
    assert spatial.impute(df, "none").where("value IS NULL").count() == 1
    with pytest.raises(ValueError):
        spatial.impute(df, "constant")
    with pytest.raises(NotImplementedError):
        spatial.impute(df, "median")

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.operators import samples as sa, series as ser
from drygrid.plans import datasets, hydrology, verification
from drygrid.functions.grid import GridSpec
from drygrid.sources import sinks, tables as tb, text as tx
from drygrid.streaming.incremental import days_to_retry, ingest_new_days, ingested


@pytest.fixture
def ramp(spark):
    start = dt.date(2020, 1, 1)
    rows = [(c, start + dt.timedelta(days=i), float(100 * c + i), float(i)) for c in (1, 2) for i in range(20)]
    return spark.createDataFrame(rows, "cell_id long, time date, a double, b double")


@pytest.mark.parametrize("length,horizon,out,step", [(4, 0, 1, 1), (4, 3, 2, 2), (5, 1, 3, 2)])
def test_windows_against_slices(ramp, length, horizon, out, step):
    got = sa.supervised_windows(ramp, ["b"], "a", length, horizon, out, step, lag_channel=True).where("cell_id = 1").orderBy("sample_id").collect()
    a, b = [100.0 + i for i in range(20)], [float(i) for i in range(20)]
    want = []
    t = length
    while t + horizon + out <= 20:
        want.append(([[b[i], a[i]] for i in range(t - length, t, step)], a[t + horizon:t + horizon + out]))
        t += 1
    assert [(r.x, r.y) for r in got] == want
    assert got[0].sample_id == 0 and got[0].x_start == dt.date(2020, 1, 1)
    assert got[0].y_start == dt.date(2020, 1, 1) + dt.timedelta(days=length + horizon)
    if out == 1:
        assert len(got) == 20 - length - horizon


def test_last_frame_keeps_lag_history(ramp):
    r = sa.supervised_windows(ramp, ["b"], "a", 3, 1, lag_channel=True, last_obs=True).where("cell_id = 1 AND sample_id = 0").first()
    assert r.x == [[2.0, 100.0], [2.0, 101.0], [2.0, 102.0]]


def test_conditioning_modes(ramp):
    samples = sa.supervised_windows(ramp, ["a", "b"], "a", 3, 1, lag_channel=True)
    assert sa.conditioning(samples, "climate").where("cell_id = 1 AND sample_id = 0").first().cond == [102.0, 2.0]
    assert "cond" not in sa.conditioning(samples).columns
    for mode in ("autoenc", "all"):
        with pytest.raises(ValueError):
            sa.conditioning(samples, mode)
    with pytest.raises(ValueError):
        sa.conditioning(samples, "other")


def test_split_partitions_the_axis(ramp):
    out = sa.chronological_split(ramp, 0.7, 0.333)
    sizes = {r["split"]: r["count"] for r in out.where("cell_id = 1").groupBy("split").count().collect()}
    assert sizes == {"train": 14, "val": 2, "test": 4}
    with pytest.raises(ValueError):
        sa.chronological_split(ramp, 0.8, 0.5, by_ratio=True)


def test_folds_and_batches(ramp):
    folds = [tuple(r) for r in sa.sliding_folds(ramp, 8, 4, 5).orderBy("fold").collect()]
    assert folds == [(0, 0, 8, 8, 12), (1, 5, 13, 13, 17)]
    rows = sa.fold_rows(ramp, 8, 4, 5).where("cell_id = 1").groupBy("fold", "part").count()
    assert {(r.fold, r.part): r["count"] for r in rows.collect()} == {(f, p): n for f in (0, 1) for p, n in (("train", 8), ("test", 4))}
    assert sa.sliding_folds(ramp, 30, 4).count() == 0
    samples = sa.supervised_windows(ramp, ["a"], "a", 3, 1).select("cell_id", "sample_id")
    padded = sa.batches(samples, 5).where("cell_id = 1")
    assert padded.count() == 20 and padded.agg(F.max("batch_id")).first()[0] == 3
    assert padded.where("position >= 15").select("sample_id").distinct().count() == 1 + 0 or padded.where("sample_id = 15").count() == 5
    mixed = sa.batches(samples, 5, shuffle_seed=3).where("cell_id = 1")
    assert sorted(r.position for r in mixed.collect()) == list(range(20))
    assert [r.position for r in mixed.orderBy("sample_id").collect()] != list(range(20))


def test_training_tables_do_not_cross_the_split(ramp):
    out = datasets.training_tables(ramp, ["b"], "a", 3, 1, batch_size=4)
    limit = ramp.where("cell_id = 1").orderBy("time").collect()[13].time
    assert out.where((F.col("split") == "train") & (F.col("y_end") > F.lit(limit))).count() == 0
    assert out.where((F.col("split") == "test") & (F.col("x_start") <= F.lit(limit))).count() == 0
    per = out.groupBy("split", "cell_id").count().collect()
    assert all(r["count"] % 4 == 0 for r in per)


def test_scalers(spark, ramp):
    low = sa.min_max_normalise(ramp, ["a", "b"]).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert tuple(low) == (0.0, 1.0, 0.0, 1.0)
    back = sa.standardise(sa.standardise(ramp, ["a"], train=None), ["a"], train=None, inverse_of=ramp)
    assert back.join(ramp.withColumnRenamed("a", "a0"), ["cell_id", "time"]).agg(F.max(F.abs(F.col("a") - F.col("a0")))).first()[0] < 1e-9
    names = sa.order_channels(spark.createDataFrame([(1, 1, 1, 1, 1)], "cell_id int, time int, sm_1 int, t2m int, total_precipitation int")).columns
    assert names == ["cell_id", "time", "total_precipitation", "t2m", "sm_1"]


def test_scoring_members(ramp):
    samples = sa.supervised_windows(ramp, ["a"], "a", 2, 1).select("cell_id", "sample_id", "x")
    scored = ser.score_samples(samples, lambda p: p.assign(y_pred=p["member"].astype(float))[["cell_id", "sample_id", "member", "y_pred"]],
                               "cell_id long, sample_id long, member int, y_pred double", members=4)
    assert scored.count() == 4 * samples.count()
    assert ser.member_mean(scored, ["cell_id"]).first().y_pred == 1.5


# --- sources and sinks ---------------------------------------------------------------------------------

ASCII = "ncols 3\nnrows 2\nxllcorner -180\nyllcorner -90\ncellsize 0.5\nNODATA_value -9999\n 1 -9999 3\n-9999 5.5 0\n"


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "sq1.asc").write_text(ASCII)
    rows = tx.read_ascii_grids(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r.layer, r.row, r.col, r.value) for r in rows] == [("sq1", 0, 0, 1.0), ("sq1", 0, 2, 3.0), ("sq1", 1, 1, 5.5), ("sq1", 1, 2, 0.0)]
    assert rows[0].x_corner == -180.0 and rows[0].cellsize == 0.5


def test_point_json(spark, tmp_path):
    doc = """{"geometry": {"coordinates": [9.5, 40.25, 812.0]}, "properties": {"parameter": {"T2M": {"20200101": 21.5, "20200102": 22.0}, "PREC": {"20200101": 0.0}}},
      "parameters": {"T2M": {"units": "C", "longname": "Temperature"}, "PREC": {"units": "mm", "longname": "Rain"}}}"""
    (tmp_path / "p.json").write_text(doc)
    points = tx.read_point_json(spark, str(tmp_path))
    assert points.count() == 3 and points.where("parameter = 'T2M'").first().units == "C"
    wide = tx.pivot_parameters(points, ["T2M", "PREC"], {"T2M": ("C", "Temperature")}).orderBy("time")
    assert [(r.lat, r.time.day, r.T2M, r.PREC) for r in wide.collect()] == [(9.5, 1, 21.5, 0.0), (9.5, 2, 22.0, None)]
    assert wide.schema["T2M"].metadata == {"units": "C", "long_name": "Temperature"}


def test_links_and_manifests(spark):
    pages = spark.createDataFrame([("https://h.org/data/2005/", '<td><a href="a.nc">x</a><a href="/b.nc"></a><a href="c.txt">')], "url string, html string")
    assert [r.address for r in tx.page_links(pages, suffix=".nc").collect()] == ["https://h.org/data/2005/a.nc", "https://h.org/b.nc"]
    days = tx.dekad_manifest(spark, 2008, 2009, "u/{year}/{month}/{day}/f_{date}.zip").orderBy("time")
    assert days.count() == 72 and days.first().address == "u/2008/01/01/f_20080101.zip"
    assert tx.daily_manifest(spark, "2020-02-28", "2020-03-01", "{date}").count() == 3


def test_names(spark):
    df = spark.createDataFrame([("/a/MSG_20200102030405.nc",), ("/a/2020_01_02.tif",), ("/a/IMERG_spi_gamma_90.nc",), ("/a/x_202001021200.nc",)], "p string")
    product, index, latency = tb.spi_name_parts(F.col("p"))
    rows = df.select(tb.time_from_name(F.col("p")).alias("t"), product.alias("product"), index.alias("i"), latency.alias("l"), tb.noon_from_name(F.col("p")).alias("noon")).collect()
    assert rows[0].t == dt.datetime(2020, 1, 2, 3, 4, 5) and rows[1].t == dt.datetime(2020, 1, 2) and rows[2].t is None
    assert (rows[2].product, rows[2].i, rows[2].l) == ("IMERG", "spi_gamma_90", 90)
    assert rows[3].noon == dt.datetime(2020, 1, 2, 12)
    registry = spark.createDataFrame([("SPI", "IMERG", "/d/IMERG_spi_gamma_180.nc"), ("PRECIP", "IMERG", "/p/IMERG_merged.parquet")], "kind string, product string, path string")
    wanted = spark.createDataFrame([("SPI", "IMERG"), ("PRECIP", "IMERG"), ("SPI", "GPCC")], "kind string, product string")
    got = {(r.kind, r.product): (r.path, r.index_name, r.latency) for r in tb.resolve_products(wanted, registry).collect()}
    assert got == {("SPI", "IMERG"): ("/d/IMERG_spi_gamma_180.nc", "spi_gamma_180", 180), ("PRECIP", "IMERG"): ("/p/IMERG_merged.parquet", None, None), ("SPI", "GPCC"): (None, None, None)}
    with pytest.raises(LookupError, match="SPI product called GPCC"):
        tb.read_product(spark, registry, "SPI", "GPCC")


def test_product_is_read_by_its_registry_entry(spark, ramp, tmp_path):
    ramp.write.parquet(str(tmp_path / "x"))
    registry = spark.createDataFrame([("PRECIP", "IMERG", str(tmp_path / "x"))], "kind string, product string, path string")
    assert tb.read_product(spark, registry, "PRECIP", "IMERG").count() == ramp.count()


def test_corrupt_files(spark, ramp, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    ramp.withColumn("a", F.when(F.col("b") == 0, F.lit(float("nan"))).otherwise(F.col("a"))).write.parquet(str(good))
    bad.mkdir()
    (bad / "x.parquet").write_bytes(b"not a file")
    out = tb.read_files(spark, str(good), hook=lambda d: d.withColumn("n", F.length("file_path")))
    assert out.where("a IS NULL").count() == 2 and "file_path" not in out.columns
    with pytest.raises(ValueError):
        tb.read_files(spark, [])
    both = tb.read_files(spark, [str(good), str(bad)], skip_corrupt=True, with_path=True)
    assert both.count() == 40


def test_cube_round_trip_prunes_and_pushes_down(spark, ramp, tmp_path):
    path = str(tmp_path / "cube")
    cube = ramp.withColumn("lat", F.col("cell_id") * 1.0).withColumn("lon", F.lit(5.0))
    sinks.write_cube(cube, path)
    got = tb.load_arrays(spark, path, ["b"], "2020-01-05", "2020-01-06", (0.0, 9.0), (0.0, 1.5))
    assert sorted(r.b for r in got.collect()) == [4.0, 5.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(time" in plan
    assert "a:double" not in plan
    with pytest.raises(ValueError):
        tb.load_arrays(spark, path, ["missing"])
    later = cube.withColumn("time", F.add_months("time", 12))
    sinks.write_cube(later, path)
    sinks.write_cube(later, path)
    assert spark.read.parquet(path).count() == 80
    assert tb.data_variables(spark.read.parquet(path)) == ["a", "b", "year"]
    fc = cube.select(F.lit("m").alias("model"), F.lit(10).alias("horizon"), F.col("time").alias("valid_date"), "cell_id", F.lit(-1.0).alias("y"), F.col("a").alias("y_pred"))
    sinks.write_predictions(fc, str(tmp_path / "fc"))
    read = tb.forecasts(spark, str(tmp_path / "fc"), "m", [10], mask=cube.select("cell_id", F.lit(1).alias("mask")).distinct(), drop_last=11)
    assert read.where("y IS NOT NULL").count() == 0 and read.agg(F.max("valid_date")).first()[0] == dt.date(2020, 1, 9)


def test_other_sinks(spark, ramp, tmp_path):
    path = sinks.write_csv(ramp, str(tmp_path), "events", 2001, 2009, "chirps")
    assert path.endswith("events_2001_2009_chirps") and spark.read.csv(path, header=True).count() == 40
    samples = datasets.training_tables(ramp, ["b"], "a", 3, 1, batch_size=4)
    sinks.write_samples(samples.drop("batch_id"), str(tmp_path / "samples"), 4)
    assert tb.samples(spark, str(tmp_path / "samples"), "train").select("split").distinct().count() == 1
    fails = spark.createDataFrame([("2020-01-01", "timeout")], "time string, error string")
    sinks.append_failures(fails, str(tmp_path / "log"))
    sinks.append_failures(fails, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    axes = sinks.with_axes(spark.createDataFrame([(0, 1, 0.5)], "sample_id int, cell_id long, y_pred double"),
                           spark.createDataFrame([(0, dt.date(2020, 1, 1))], "sample_id int, valid_date date"),
                           spark.createDataFrame([(1, 2.0, 3.0)], "cell_id long, lat double, lon double"))
    assert (axes.first().lat, axes.first().valid_date) == (2.0, dt.date(2020, 1, 1))


def test_incremental_ingestion(spark, ramp, tmp_path):
    inbox, cube, bad, progress = (str(tmp_path / n) for n in ("in", "cube", "bad", "progress"))
    schema = "cell_id long, time timestamp, value double"
    first = ramp.select("cell_id", F.col("time").cast("timestamp").alias("time"), F.col("a").alias("value"))
    first.where("time < '2020-01-11'").write.mode("append").parquet(inbox)
    first.where("time = '2020-01-20'").withColumn("time", F.lit(None).cast("timestamp")).write.mode("append").parquet(inbox)

    def run():
        query = ingest_new_days(spark, inbox, schema, cube, bad, progress)
        query.awaitTermination()

    run()
    assert spark.read.parquet(cube).count() == 20 and spark.read.parquet(bad).count() == 2
    assert days_to_retry(ramp.select("time").distinct(), spark.read.parquet(cube)).count() == 10
    first.where("time >= '2020-01-11'").write.mode("append").parquet(inbox)
    run()
    run()
    assert spark.read.parquet(cube).count() == 40
    again = first.where("time = '2020-01-03' AND cell_id = 1").withColumn("value", F.lit(99.0))
    again.union(again).write.mode("append").parquet(inbox)
    run()
    stored = ingested(spark, cube)
    assert stored.count() == stored.select("cell_id", "time").distinct().count() == spark.read.parquet(cube).select("cell_id", "time").distinct().count()
    assert stored.where("time = '2020-01-03' AND cell_id = 1").first().value == 99.0
    plan = days_to_retry(ramp.select("time"), spark.read.parquet(cube))._jdf.queryExecution().executedPlan().toString()
    assert "value:double" not in plan


# --- compositions --------------------------------------------------------------------------------------


def test_prepare_inputs_scales_fills_and_crops(spark):
    rows = [(r * 4 + c, float(r), float(c), dt.date(2020, 1, 1) + dt.timedelta(days=d), float(d + r) if (r, c, d) != (3, 0, 0) else None)
            for r in range(4) for c in range(4) for d in range(3) if (r, c, d) != (3, 1, 1)]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double, time date, v double")
    out = hydrology.prepare_inputs(df, ["v"], crop=2)
    assert out.select("cell_id").distinct().count() == 4 and out.count() == 12
    assert out.where("v = -1").count() == 1  # the leading gap is not extrapolated
    assert out.where("cell_id = 13 AND time = '2020-01-02'").first().v == pytest.approx(4 / 5)


def test_match_products_guard(spark, daily):
    with pytest.raises(ValueError):
        verification.match_products(daily, daily, GridSpec(0, 0, 1, 1), 3, extreme="heat")


def test_products_are_matched_in_tasks_of_the_calendar(spark):
    """Both sides are dealt once to the tasks given, and neither is broadcast, however small the planner takes them to be."""
    rows = [(r * 3 + c, float(r), float(c), dt.date(2020, 1, 1) + dt.timedelta(days=d), None if (r, d) == (1, 2) else float((r + c * d) % 5 - 3)) for r in range(2) for c in range(3) for d in range(6)]
    reference = spark.createDataFrame(rows, "cell_id long, lat double, lon double, time date, spi double")
    product = reference.where("time > '2020-01-01'").withColumn("spi", -1 - F.col("spi"))
    plain, sized = (verification.match_products(product, reference, GridSpec(0, 0, 1, 1), 3, dry_limit=-1.0, tasks=n) for n in (None, 5))
    assert sorted(sized.collect()) == sorted(plain.collect()) and sized.count() == 6
    plan = sized._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(cell_id#\d+L, time#\d+, 5\)", plan)
    assert not re.search(r"hashpartitioning\(cell_id#\d+L, time#\d+, (?!5\))", plan) and not re.search(r"BroadcastHashJoin \[cell_id", plan)

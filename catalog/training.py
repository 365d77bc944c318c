"""Supervised samples, splits, folds and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUBE, query, r6
from drygrid.operators import align as al, samples as sa, series as ser, temporal as tm


def as_text(column):
    """Integer-valued nested floats as one string."""
    return F.array_join(F.transform(column, lambda v: v.cast("int").cast("string")), ",")


WINDOW = f"""{CUBE}, w AS (SELECT *, ROW_NUMBER() OVER p - 1 AS i, COUNT(*) OVER (PARTITION BY cell_id) AS n, LAG(value, 4) OVER p AS v4, LAG(value, 2) OVER p AS v2, LAG(value2, 4) OVER p AS u4, LAG(value2, 2) OVER p AS u2,
 LAG(value, 1) OVER p AS v1, LAG(value2, 1) OVER p AS u1, LAG(value, 3) OVER p AS v3, LAG(value2, 3) OVER p AS u3, LEAD(value, 3) OVER p AS y1, LEAD(value, 4) OVER p AS y2, LAG(time, 4) OVER p AS xs, LAG(time, 1) OVER p AS xe, LEAD(time, 3) OVER p AS ys, LEAD(time, 4) OVER p AS ye
 FROM cube WINDOW p AS (PARTITION BY cell_id ORDER BY time))"""


def num(*columns: str) -> str:
    return " || ',' || ".join(f"CAST(CAST({c} AS INTEGER) AS VARCHAR)" for c in columns)


@query("supervised_windows", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, time AS origin, {num('v4', 'u4', 'v4', 'v2', 'u2', 'v2')} AS x, {num('y1', 'y2')} AS y, xs AS x_start, xe AS x_end, ys AS y_start, ye AS y_end
 FROM w WHERE i >= 4 AND i + 4 < n""")
def supervised_windows(t):
    out = sa.supervised_windows(t.cube(), ["value", "value2"], "value", 4, 3, out=2, step=2, lag_channel=True)
    return out.withColumn("x", as_text(F.flatten("x"))).withColumn("y", as_text("y"))


@query("windows_lag_only", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, {num('0', 'v4', '0', 'v3', '0', 'v2', '0', 'v1')} AS x, {num('y1')} AS y, ys - 1 AS y_start FROM w WHERE i >= 4 AND i + 3 < n""")
def windows_lag_only(t):
    out = sa.supervised_windows(t.cube(), ["value2"], "value", 4, 3, lag_channel=True, only_lag=True, strict=True)
    return out.select("cell_id", "sample_id", as_text(F.flatten("x")).alias("x"), as_text("y").alias("y"), "y_start")


@query("windows_last_frame", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, {num('u1', 'v1', 'u1', 'v1')} AS x FROM w WHERE i >= 4 AND i + 3 < n""")
def windows_last_frame(t):
    out = sa.supervised_windows(t.cube(), ["value2", "value"], "value", 4, 3, step=2, last_obs=True)
    return out.select("cell_id", "sample_id", as_text(F.flatten("x")).alias("x"))


@query("windows_for_diffusion", f"""WITH {WINDOW} SELECT cell_id, i - 2 AS sample_id, {num('v2', 'v1', 'value')} AS x, {num('y1')} AS y FROM w WHERE i >= 2 AND i + 3 < n""")
def windows_for_diffusion(t):
    out = sa.supervised_windows(t.cube(), ["value"], "value", 2, 3, diffusion_days=2)
    return out.select("cell_id", "sample_id", as_text(F.flatten("x")).alias("x"), as_text("y").alias("y"))


@query("offset_windows", f"""WITH {CUBE}, w AS (SELECT *, LAG(value, 2) OVER p AS a, LAG(value, 1) OVER p AS b, LEAD(value2, 1) OVER p AS d, LEAD(value2, 2) OVER p AS e, LEAD(value2, 3) OVER p AS f FROM cube WINDOW p AS (PARTITION BY cell_id ORDER BY time))
SELECT cell_id, time AS origin, {num('a', 'b', 'value')} AS x, {num('d', 'e', 'f')} AS y FROM w WHERE a IS NOT NULL AND f IS NOT NULL""")
def offset_windows(t):
    return sa.offset_windows(t.cube(), "value", "value2", 3).withColumn("x", as_text("x")).withColumn("y", as_text("y"))


@query("climate_conditioning", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, {num('v1', 'u1')} AS cond FROM w WHERE i >= 4 AND i + 3 < n""")
def climate_conditioning(t):
    out = sa.supervised_windows(t.cube(), ["value", "value2"], "value", 4, 3, lag_channel=True)
    return sa.conditioning(out, "climate").select("cell_id", "sample_id", as_text("cond").alias("cond"))


@query("all_conditioning", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, {num('v1', 'u1', 'v2', 'v1')} AS cond FROM w WHERE i >= 4 AND i + 3 < n""")
def all_conditioning(t):
    """The stand-in encoder keeps the last two values of its input window."""
    out = sa.supervised_windows(t.cube(), ["value", "value2"], "value", 4, 3, lag_channel=True)
    encoder = sa.encoder_windows(t.cube(), "value", 4, 3).select("cell_id", "sample_id", F.col("x").alias("encoded"))
    return sa.conditioning(out, "all", encoder, n_encoded=2).select("cell_id", "sample_id", as_text("cond").alias("cond"))


RANKED = f"""{CUBE}, d AS (SELECT time, ROW_NUMBER() OVER (ORDER BY time) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT time FROM cube))"""


@query("chronological_split", f"""WITH {RANKED} SELECT cell_id, cube.time, CASE WHEN r <= ROUND_EVEN(0.6 * n, 0) THEN 'train' WHEN r <= ROUND_EVEN(0.6 * n, 0) + ROUND_EVEN(0.25 * n, 0) THEN 'val' ELSE 'test' END AS split FROM cube JOIN d ON d.time = cube.time""")
def chronological_split(t):
    return sa.chronological_split(t.cube(), 0.6, 0.25, by_ratio=True).select("cell_id", "time", "split")


@query("sliding_folds", f"""WITH {CUBE}, n AS (SELECT COUNT(DISTINCT time) AS n FROM cube) SELECT CAST(s // 365 AS INTEGER) AS fold, CAST(s AS INTEGER) AS train_start, CAST(s + 730 AS INTEGER) AS train_end, CAST(s + 730 AS INTEGER) AS test_start, CAST(s + 820 AS INTEGER) AS test_end FROM n, range(0, n - 820 + 1, 365) r(s)""")
def sliding_folds(t):
    return sa.sliding_folds(t.cube(), 730, 90)


@query("fold_rows", f"""WITH {RANKED}, f AS (SELECT s // 365 AS fold, s FROM (SELECT MAX(n) AS n FROM d), range(0, n - 820 + 1, 365) r(s)) SELECT cell_id, cube.time, CAST(fold AS INTEGER) AS fold, CASE WHEN r - 1 < s + 730 THEN 'train' ELSE 'test' END AS part FROM cube JOIN d ON d.time = cube.time JOIN f ON r - 1 >= s AND r - 1 < s + 820""")
def fold_rows(t):
    return sa.fold_rows(t.cube(), 730, 90).select("cell_id", "time", "fold", "part")


BATCH = f"""WITH {CUBE}, d AS (SELECT time, ROW_NUMBER() OVER (ORDER BY time) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM cube)),
 s AS (SELECT cell_id, i - 4 AS sample_id, time AS origin FROM d, (SELECT DISTINCT cell_id FROM cube) WHERE i >= 4 AND i + 3 < n), m AS (SELECT MAX(sample_id) AS last FROM s),
 p AS (SELECT cell_id, sample_id, origin, sample_id AS position FROM s UNION ALL SELECT cell_id, sample_id, origin, sample_id + k FROM s, m, range(1, 32) r(k) WHERE sample_id = last AND k <= (32 - (last + 1) % 32) % 32)"""


def dated_samples(t):
    """Windows on one calendar for all cells, so a sample number is one date."""
    return sa.supervised_windows(tm.common_calendar(t.cube(), values=("value", "value2"), tasks=t.tasks()), ["value"], "value", 4, 3).select("cell_id", "sample_id", "origin")


@query("padded_batches", f"""{BATCH} SELECT cell_id, sample_id, origin, position, position // 32 AS batch_id FROM p""")
def padded_batches(t):
    return sa.batches(dated_samples(t), 32)


@query("shuffled_batches", f"""{BATCH}, o AS (SELECT position, ROW_NUMBER() OVER (ORDER BY md5(position::VARCHAR || ':7'), position) - 1 AS place FROM (SELECT DISTINCT position FROM p))
SELECT cell_id, sample_id, origin, place AS position, place // 32 AS batch_id FROM p JOIN o USING (position)""")
def shuffled_batches(t):
    return sa.batches(dated_samples(t), 32, shuffle_seed=7)


@query("scaler_table", f"""WITH {CUBE} SELECT 'value' AS variable, MIN(value) AS low, MAX(value) AS high FROM cube UNION ALL SELECT 'value2', MIN(value2), MAX(value2) FROM cube""")
def scaler_table(t):
    return sa.min_max_table(t.cube(), ["value", "value2"])


@query("scored_samples", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, ROUND((v4 + v3 + v2 + v1) / 4 + (0 + 1 + 2) / 3.0::DOUBLE, 6) AS y_pred FROM w WHERE i >= 4 AND i + 3 < n""")
def scored_samples(t):
    """A three-member ensemble of window means, member m shifted by m, averaged over members."""

    def model(pdf):
        import numpy as np

        means = [float(np.mean([f[0] for f in x])) for x in pdf["x"]]
        return pdf[["cell_id", "sample_id", "member"]].assign(y_pred=np.asarray(means, float) + pdf["member"].to_numpy())

    out = sa.supervised_windows(t.cube(), ["value"], "value", 4, 3).select("cell_id", "sample_id", "x")
    scored = ser.score_samples(out, model, "cell_id long, sample_id long, member int, y_pred double", members=3)
    return ser.member_mean(scored, ["cell_id", "sample_id"]).withColumn("y_pred", r6("y_pred"))


@query("features_with_encoder_columns", f"""WITH {WINDOW} SELECT cell_id, i - 4 AS sample_id, {num('v4', 'v3', 'v2', 'v1', 'u1')} AS x FROM w WHERE i >= 4 AND i + 3 < n""")
def features_with_encoder_columns(t):
    base = sa.encoder_windows(t.cube(), "value", 4, 3).select("cell_id", "sample_id", "x")
    other = sa.encoder_windows(t.cube(), "value2", 4, 3).select("cell_id", "sample_id", F.slice("x", 4, 1).alias("extra"))
    return al.append_array(base, other, ["cell_id", "sample_id"], "x", "extra").withColumn("x", as_text("x"))

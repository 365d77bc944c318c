import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.operators import graph as gr, series as ser, ssim as sm, verify as vf


def test_contingency(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0), (None, 1), (1, None)]
    df = spark.createDataFrame([(0, o, f) for o, f in rows], "time int, obs int, fc int")
    r = vf.contingency(df, "obs", "fc").first()
    assert (r.hits, r.misses, r.false_alarms, r.correct_negatives) == (1, 1, 1, 2)
    assert (r.accuracy, r.hit_rate, r.bias_score) == (0.6, 0.5, 1.0)
    assert r.false_alarm_rate == pytest.approx(1 / 3) and r.mse == pytest.approx(0.4)
    empty = vf.contingency(df.where("obs = 0 AND fc = 0"), "obs", "fc").first()
    assert empty.hit_rate is None and empty.accuracy == 1.0


def test_agreement_with_missing(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (None, None), (None, 1)], "t int, r int")
    pod, far, acc = vf.agreement_indices(F.col("t"), F.col("r"))
    assert [tuple(x) for x in df.select(pod, far, acc).collect()] == [(1.0, 0.0, 1.0), (None, 1.0, 0.0), (0.0, None, 0.0), (None, None, None), (0.0, None, 0.0)]


def test_masked_losses_count_missing_predictions(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1), (None, 1.0, 1), (5.0, None, 1), (2.0, 2.5, 0)], "p double, y double, m int")
    p, y, m = F.col("p"), F.col("y"), F.col("m")
    r = df.agg(vf.masked_mse(p, y), vf.masked_mae(p, y, null_val=2.5), vf.mask_mae(p, y, m), vf.mask_mse(p, y)).first()
    assert r[0] == pytest.approx((4 + 0.25) / 3) and r[1] == pytest.approx(2 / 2)
    assert r[2] == pytest.approx(2 / 3) and r[3] == pytest.approx(4.25 / 4)
    table = vf.metric_table(df, ["rmse", "rmse_elementwise"], pred="p", truth="y", mask="m").first()
    assert table.masked_share == 0.25 and table.rmse >= table.rmse_elementwise
    assert vf.metric_table(df, ["rmse"], pred="p", truth="y", mask="m", strict=True).first().rmse == pytest.approx(table.rmse_elementwise)
    with pytest.raises(ValueError):
        vf.loss("crps", p, y)
    with pytest.raises(ValueError):
        vf.error_by_calendar(df, "week")


def test_percentile_bands_strict_loses_the_maximum(spark):
    df = spark.createDataFrame([(float(i), float(i) + 1) for i in range(101)], "y double, y_pred double")
    full = vf.error_by_percentile(df, ["rmse", "bias"]).collect()
    assert len(full) == 10 and all(r.rmse == 1.0 and r.bias == -1.0 for r in full)
    assert [r.lower for r in sorted(full, key=lambda r: r.percentile)] == pytest.approx([10.0 * i for i in range(10)])
    assert vf.error_by_percentile(df, "mse", strict=True).count() == 10
    with pytest.raises(ValueError):
        vf.error_by_percentile(df, "mape")


def test_month_table_has_all_months(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 1), 1.0, 2.0), (dt.date(2021, 3, 2), 1.0, 4.0)], "valid_date date, y double, y_pred double")
    out = vf.error_by_calendar(df, "month").orderBy("month").collect()
    assert len(out) == 12 and out[2].error == 2.0 and out[2].time_key == "March" and out[0].error is None


@pytest.mark.parametrize("skipna", [False, True])
def test_lag_correlation(spark, skipna):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=30), rng.normal(size=30)
    rows = [(1, i, float(x[i]), float(y[i]) if i != 29 or not skipna else None) for i in range(30)]
    df = spark.createDataFrame(rows, "cell_id long, time int, x double, y double")
    r = vf.lag_correlation(df, "x", "y", 4, skipna=skipna, return_p=True).first()
    n = 25 if skipna else 26
    want = np.corrcoef(x[:n], y[4:4 + n])[0, 1]
    assert r.r == pytest.approx(want) and r.n == n
    t = want * np.sqrt((n - 2) / (1 - want**2))
    grid = np.linspace(-abs(t), abs(t), 200_001)
    import math

    dens = np.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / np.sqrt((n - 2) * np.pi) * (1 + grid**2 / (n - 2)) ** (-(n - 1) / 2)
    assert r.p_value == pytest.approx(1 - np.trapezoid(dens, grid), abs=1e-7)


def test_autocorrelation_forms_agree(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=40).cumsum()
    df = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(v)] + [(2, i, None if i == 20 else float(i % 5)) for i in range(40)], "cell_id long, time int, value double")
    some = {(r.cell_id, r.lead): r.r for r in vf.autocorrelation(df, 6).collect()}
    full = {(r.cell_id, r.lead): r.r for r in ser.full_autocorrelation(df).collect()}
    assert len([k for k in full if k[0] == 1]) == 38
    for k in range(1, 39):
        assert full[1, k] == pytest.approx(np.corrcoef(v[:-k], v[k:])[0, 1], abs=1e-9)
    for k in range(1, 7):
        assert some[1, k] == pytest.approx(full[1, k]) and some[2, k] is None and full[2, k] is None


@pytest.mark.parametrize("padding", ["zero", "reflect"])
def test_ssim_against_direct_convolution(spark, padding):
    rng = np.random.default_rng(13)
    a, b = rng.uniform(-1, 1, (12, 14)), rng.uniform(-1, 1, (12, 14))
    w = np.array(sm.gaussian_weights())
    kernel = np.outer(w, w)

    def blur(z):
        p = np.pad(z, 5, mode="constant" if padding == "zero" else "reflect")
        return np.array([[(p[i:i + 11, j:j + 11] * kernel).sum() for j in range(z.shape[1])] for i in range(z.shape[0])])

    ma, mb = blur(a), blur(b)
    va, vb, vab = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = 0.02**2, 0.06**2
    want = ((2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean()
    df = spark.createDataFrame([(0, i, j, float(a[i, j]), float(b[i, j])) for i in range(12) for j in range(14)], "image int, row int, col int, a double, b double")
    assert sm.ssim(df, padding=padding).first().ssim == pytest.approx(want)
    assert sm.ssim(df.withColumn("b", F.col("a"))).first().ssim == pytest.approx(1.0)


# --- graphs --------------------------------------------------------------------------------------------


def matrix(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.src, r.dst] += r.w
    return out


def test_largest_eigenvalue_against_numpy(spark):
    rng = np.random.default_rng(4)
    for size, share in ((2, 1.0), (40, 0.1), (25, 1.0)):
        w = np.triu(rng.random((size, size)) * (rng.random((size, size)) < share), 1)
        matrix = w + w.T + np.diag(rng.normal(size=size) * 3)
        entries = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(size) for j in range(size) if matrix[i, j] or i == j], "src long, dst long, w double")
        values = np.linalg.eigvalsh(matrix)
        assert gr.largest_eigenvalue(entries, tolerance=1e-9) == pytest.approx(values[np.abs(values).argmax()], rel=1e-6)
    assert gr.largest_eigenvalue(entries.limit(0)) == 0.0
    one = spark.createDataFrame([(5, 5, -2.5)], "src long, dst long, w double")
    assert gr.largest_eigenvalue(one) == pytest.approx(-2.5)


def points_of(kind):
    rng = np.random.default_rng(12)
    if kind == "grid":  # with holes, a repeated cell and one far line
        cells = [(la, lo) for la in np.arange(-2, 2, 0.3) for lo in np.arange(30, 33, 0.1) if rng.random() < 0.8]
        return np.array(cells + [cells[0], (40.0, 31.0)])
    if kind == "globe":  # across the date line and up to the poles
        return np.array([(la, lo) for la in range(-90, 91, 15) for lo in range(-180, 180, 30)], float)
    if kind == "line":
        return np.array([(10.0, lo) for lo in np.arange(0, 20, 0.5)])
    return np.column_stack((rng.uniform(-60, 60, 300), rng.uniform(-180, 180, 300)))


@pytest.mark.parametrize("kind", ["grid", "globe", "line", "scattered"])
@pytest.mark.parametrize("cutoff", [0.05, 0.7, 0.0])
def test_distance_graph_forms_only_pairs_within_its_radius(spark, kind, cutoff):
    points = points_of(kind)
    lat, lon = points.T
    d = gr._kilometres(lat[:, None], lat[None], lon[None] - lon[:, None])
    whole = gr._Side(np.arange(len(points)), lat, lon)
    assert (gr._columns(whole, whole) is None) == (kind == "scattered")
    halves = gr._Side(np.arange(0, len(points), 2), lat[::2], lon[::2]), gr._Side(np.arange(1, len(points), 2), lat[1::2], lon[1::2])
    assert gr._moments(whole, whole) == pytest.approx((d.sum(), (d**2).sum()), rel=1e-9)
    assert gr._moments(*halves) == pytest.approx((d[::2, 1::2].sum(), (d[::2, 1::2] ** 2).sum()), rel=1e-9)
    sigma = d.std()
    w = np.exp(-((d / sigma) ** 2))
    radius = sigma * math.sqrt(-math.log(cutoff)) if cutoff else math.inf
    formed = sum(len(x) for x, _, _ in gr._within(whole, whole, radius))
    assert (d <= radius).sum() <= formed + 1e-3 * d.size and formed <= (d <= radius + 1e-3).sum()

    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(9999, None, 1.0)], "cell_id long, lat double, lon double")
    edges = gr.distance_adjacency(nodes, cutoff=cutoff, block=64).collect()
    got = {(r.src, r.dst): r.w for r in edges}
    assert len(got) == len(edges) and got.pop((9999, 9999)) == 1.0
    sure = {(i, j): w[i, j] for i, j in zip(*np.nonzero(w >= cutoff))}
    unsure = {k for k in set(got) ^ set(sure) if abs(w[k] - cutoff) > 1e-9}
    assert not unsure
    assert all(got[k] == pytest.approx(sure[k], rel=1e-6) for k in set(got) & set(sure))


def test_distance_graph_plans_without_a_job(spark):
    nodes = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 3.5)], "cell_id long, lat double, lon double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    gr.distance_adjacency(nodes)
    jobs = tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    assert gr.distance_adjacency(nodes.limit(0)).count() == 0
    assert [tuple(r) for r in gr.distance_adjacency(nodes.limit(1)).collect()] == [(1, 1, 1.0)]


def test_scaled_laplacian_by_its_eigenvalue(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (1, 4, 0.5)], "src long, dst long, w double")
    got = {(r.src, r.dst): r.w for r in gr.scaled_laplacian(edges, lambda_max=None).collect()}
    scaled = np.array([[got.get((i, j), 0.0) for j in range(1, 5)] for i in range(1, 5)])
    assert np.abs(np.linalg.eigvalsh(scaled)).max() == pytest.approx(1.0, abs=1e-5)


def test_graph_normalisations(spark):
    rng = np.random.default_rng(14)
    a = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    a[3] = 0  # no way out of node 3
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6) if a[i, j]], "src long, dst long, w double")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    d = a.sum(1)
    with np.errstate(divide="ignore"):
        s = np.where(d > 0, d**-0.5, 0.0)
        inv = np.where(d > 0, 1 / d, 0.0)
    assert np.allclose(matrix(gr.symmetric(edges), 6), (a * s[None, :]).T * s[None, :])
    t = matrix(gr.row_normalised(edges), 6)
    assert np.allclose(t, inv[:, None] * a) and np.allclose(t.sum(1)[d > 0], 1)
    assert np.allclose(matrix(gr.normalised_laplacian(edges, nodes), 6), np.eye(6) - (a * s[None, :]).T * s[None, :])
    u = np.maximum(a, a.T)
    du = u.sum(1)
    with np.errstate(divide="ignore"):
        su = np.where(du > 0, du**-0.5, 0.0)
    assert np.allclose(matrix(gr.scaled_laplacian(edges, nodes=nodes), 6), np.eye(6) - su[:, None] * u * su[None, :] - np.eye(6))
    assert len(gr.supports(edges, "doubletransition")) == 2
    with pytest.raises(ValueError):
        gr.supports(edges, "chebyshev")
    x = rng.random(6)
    feats = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node long, value double")
    hops = {(r.node, r.hop): r.value for r in gr.diffuse(edges, feats, 2).collect()}
    for k, want in enumerate((x, x @ a, x @ a @ a)):
        for i in range(6):
            assert hops.get((i, k), 0.0) == pytest.approx(want[i])


@pytest.mark.parametrize("block", [3, 512])
def test_distance_adjacency(spark, block):
    rng = np.random.default_rng(15)
    pts = rng.uniform([-5, 32], [15, 51], (11, 2))
    nodes = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], "cell_id long, lat double, lon double")
    d = gr._distances(pts, pts, "geodesic")
    w = np.exp(-((d / d.std()) ** 2))
    w[w < 0.05] = 0
    assert np.allclose(matrix(gr.distance_adjacency(nodes, block=block), 11), w)


@pytest.mark.parametrize("measure", gr.MEASURES)
@pytest.mark.parametrize("percentile", [40.0, 90.0, 99.9])
def test_feature_adjacency(spark, measure, percentile):
    rng = np.random.default_rng(16)
    x = rng.random((13, 4)) + 0.1
    if measure == "jensenshannon":
        p = x / x.sum(1, keepdims=True)
        m = (p[:, None] + p[None]) / 2
        d = np.sqrt(np.maximum(((p[:, None] * np.log(p[:, None] / m)).sum(2) + (p[None] * np.log(p[None] / m)).sum(2)) / 2, 0))
    elif measure == "correlation":
        d = 1 - np.corrcoef(x)
    else:
        diff = x[:, None] - x[None]
        vi = np.linalg.inv(np.cov(np.vstack([x, x]).T)) if measure == "mahalanobis" else np.eye(4)
        d = np.sqrt(np.einsum("ijk,kl,ijl->ij", diff, vi, diff))
    np.fill_diagonal(d, 1)
    v = 1 / d
    np.fill_diagonal(v, 0)
    v = (v - v.min()) / (v.max() - v.min())
    np.fill_diagonal(v, 1)
    threshold = np.percentile(np.triu(v), percentile)
    v[v < threshold - 1e-12] = 0
    nodes = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "node long, vector array<double>")
    out = gr.feature_adjacency(nodes, percentile, measure, block=5)
    assert np.allclose(matrix(out, 13), v)
    with pytest.raises(ValueError):
        gr.feature_adjacency(nodes, measure="cosine")


def test_feature_adjacency_with_a_near_copy_and_undefined_vectors(spark):
    """One pair at 1e-6 must not move the other pairs together; a NULL element puts a node at no distance."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    x[1] = x[0] + 5e-7
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, [1.0, None, 0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>")
    got = {(r.src, r.dst): r.w for r in gr.feature_adjacency(nodes, 97.0, "euclidean", block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.triu_indices(60, 1)
    inverse = np.concatenate((1 / d[i, j], np.zeros(60)))
    w = inverse / inverse.max()
    threshold = np.quantile(np.concatenate((w, np.zeros(61 * 60 // 2), np.ones(61))), 0.97)
    want = {(int(a), int(b)): v for a, b, v in zip(i, j, w) if v >= threshold}
    assert len(want) > 10
    pairs = {k: v for k, v in got.items() if k[0] < k[1]}
    assert pairs.keys() == want.keys() and all(pairs[k] == pytest.approx(want[k]) for k in want)
    assert got[60, 60] == 1.0 and len(got) == 2 * len(want) + 61


@pytest.mark.parametrize("measure", ["euclidean", "jensenshannon"])
def test_feature_adjacency_by_products_of_long_vectors(spark, measure):
    """Several blocks of several tiles, exact and near copies, zeros: edges are those of the distances themselves."""
    rng = np.random.default_rng(31)
    x = rng.random((1300, 12)) * (rng.random((1300, 12)) > 0.2) + 1e-3 * np.eye(12)[rng.integers(0, 12, 1300)]
    x[1], x[2] = x[0], x[0] + 1e-9
    p = x / x.sum(1, keepdims=True) if measure == "jensenshannon" else x
    i, j = np.triu_indices(1300, 1)
    d = gr._paired(p[i], p[j], measure)
    near = gr._distances(p[:40], p[40:90], measure)
    assert np.allclose(near, d[(i < 40) & (j >= 40) & (j < 90)].reshape(40, 50), rtol=1e-12)
    w = np.minimum(1 / np.where(d > 0, d, 1e-300), 1 / d[d > 0].min()) * d[d > 0].min()
    threshold = np.quantile(np.concatenate((w, np.zeros(1300 * 1299 // 2), np.ones(1300))), 0.99)
    want = dict(zip(zip(i[w >= threshold].tolist(), j[w >= threshold].tolist()), w[w >= threshold]))
    nodes = spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], "node long, vector array<double>")
    got = {(r.src, r.dst): r.w for r in gr.feature_adjacency(nodes, 99.0, measure, block=700).collect() if r.src < r.dst}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert got[0, 1] == 1.0


def test_distance_blocks_meet_by_a_shuffle_and_copy_a_cell_to_few_tasks(spark):
    """Sixteen blocks hold 20,000 cells; their copies are not broadcast, though the cells alone are few bytes."""
    nodes = spark.range(20_000).select(F.col("id").alias("cell_id"), (F.floor(F.col("id") / 10) * 0.01).alias("lat"), (F.col("id") % 10 * 0.25).alias("lon"))
    assert spark.range(1).select(gr._parts(nodes, 512)).first()[0] == 16
    plan = gr.distance_adjacency(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cosines_give_the_divergence_within_their_slack():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.random((40, 30)) ** 8, np.exp(-30 * rng.random((40, 30))), np.eye(30)])
    p = x / x.sum(1, keepdims=True)
    s, left, right = gr._factors(p, "jensenshannon")
    assert np.abs(s[:, None] + s[None] - left @ right.T - gr._distances(p, p, "jensenshannon") ** 2).max() < gr.JS_SLACK


def test_feature_blocks_copy_a_vector_to_few_tasks(spark):
    """Sixteen blocks hold 20,000 nodes as they hold 10,000, and the nodes are computed once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    nodes = spark.range(20_000).select(F.col("id").alias("node"), F.array(F.col("id") % 97 + 0.5, F.sqrt("id")).alias("vector"))
    pairs = gr._block_pairs(nodes.select(F.col("node").alias("id"), F.col("vector").alias("v")), 20_000, 512)
    assert pairs.count() == 16 * 17 // 2
    few = nodes.where("node < 50").mapInPandas(counted, nodes.schema)
    assert gr.feature_adjacency(few, 90.0).count() > 50 and seen.value == 50

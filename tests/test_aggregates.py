import numpy as np
import pytest
from pyspark.sql import functions as F

from drygrid.operators.aggregates import huber_error, user_aggregate


@pytest.fixture
def pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if i % 17 == 0 else float(rng.normal()), float(rng.normal())) for i in range(900) for k in ["hot" if i % 3 else None if i % 2 else "b"]]
    return rows, spark.createDataFrame(rows, "k string, y double, y_pred double").repartition(5)


def loss(rows, limit=0.2):
    e = np.array([abs(p - y) for _, y, p in rows if y is not None])
    return np.where(e <= limit, e * e / 2, limit * (e - limit / 2))


def test_states_merge_over_batches_and_tasks(spark, pairs):
    rows, df = pairs
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.k: r for r in huber_error(df, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == {"hot", "b", None}
    for k, r in got.items():
        want = loss([x for x in rows if x[0] == k])
        assert r.pairs == len(want) and r.huber == pytest.approx(want.mean()) and r.worst == pytest.approx(want.max())


def test_merge_runs_before_the_shuffle(pairs):
    plan = huber_error(pairs[1], ["k"])._jdf.queryExecution().executedPlan().toString()
    after = plan.index("MapInPandas")
    exchange = [i for i in range(len(plan)) if plan.startswith("Exchange hashpartitioning(k", i)]
    assert len(exchange) == 1 and "partial_sum(" in plan[exchange[0]:after] and "FlatMapGroups" not in plan


def test_whole_table_empty_table_and_groups_without_pairs(spark, pairs):
    rows, df = pairs
    r = huber_error(df, []).first()
    assert r.pairs == len(loss(rows)) and r.huber == pytest.approx(loss(rows).mean())
    assert huber_error(df.limit(0), ["k"]).count() == 0
    r = huber_error(df.limit(0), []).first()
    assert r.huber is None and r.worst is None and r.pairs is None
    r = huber_error(spark.createDataFrame([("a", None, 1.0)], "k string, y double, y_pred double"), ["k"]).first()
    assert r.huber is None and r.worst is None and r.pairs == 0


def test_bad_merges_and_clashing_names(pairs):
    for merge in ({"total": "mean"}, {"k": "sum"}):
        with pytest.raises(ValueError):
            user_aggregate(pairs[1], ["k"], ["y"], lambda v, g, n: {}, merge, lambda s: {})
    out = user_aggregate(pairs[1].withColumn("_in_0", F.lit(1)), ["k"], ["y"], lambda v, g, n: {"least": np.array([np.nanmin(np.append(v["y"][g == i], np.inf)) for i in range(n)])},
                         {"least": "min"}, lambda s: {"least": s["least"]})
    want = {k: min(y for x, y, _ in pairs[0] if x == k and y is not None) for k in ("hot", "b", None)}
    assert {r.k: r.least for r in out.collect()} == want

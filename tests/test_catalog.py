"""Every query against its SQL on the smallest tables, and the shape of the plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, int, float)) or type(value).__name__ == "Decimal":
        return float(value) + 0.0
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_no_cross_join(df):
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert_no_cross_join(df)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert_no_cross_join(df)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["drought_events", "spi_gamma_fit", "gap_quality_flags", "interpolated_linear", "wet_dry_transitions", "savitzky_golay_5_2", "autocorrelation_ten_lags"])
def test_series_operators_share_one_shuffle(spark, name):
    """One exchange builds the daily cube, one spreads it by cell; nothing after that moves rows."""
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["scan_in_box_and_period"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_entry(spark):
    assert entry_module.entry(spark).count() == 470


@pytest.mark.parametrize("name", ["error_by_percentile", "efficiency_by_percentile"])
def test_quantiles_of_the_whole_table_are_not_taken_as_bounded(spark, monkeypatch, name):
    from drygrid.operators import verify

    seen, exact = [], verify.exact_quantiles
    monkeypatch.setattr(verify, "exact_quantiles", lambda df, value, probs, by, out, bounded: seen.append((by, bounded)) or exact(df, value, probs, by, out, bounded))
    QUERIES[name](spark, FOLDER)
    assert seen == [([], False)]


@pytest.mark.parametrize("name", ["domain_mean_and_median", "day_of_year_distribution", "day_distribution_in_season", "one_year_against_all", "forecast_spread_by_day"])
def test_quantiles_over_all_cells_of_a_date_are_not_gathered(spark, name):
    assert " percentile(" not in plan_of(QUERIES[name](spark, FOLDER)).replace("(percentile(", " percentile(")


@pytest.mark.parametrize("name", ["training_tables", "training_tables_by_fold", "shuffled_batches", "chronological_split"])
def test_samples_are_not_shuffled_by_date_or_part(spark, name):
    """A part holds a large share of all samples, and a date one of each cell: tables of dates and parts come to the samples."""
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "BroadcastHashJoin" in plan and not any(f"SortMergeJoin [{c}#" in plan for c in ("time", "position", "split", "fold", "part"))

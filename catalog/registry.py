"""Registration of queries and the adapters from the test tables to cubes."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drygrid.operators.common import by_series, series, series_tasks
from drygrid.operators.temporal import fill_calendar

FAMILIES = ("columns", "selection", "alignment", "resampling", "drought", "verification", "graphs", "training", "records", "workflows", "stores")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name`` with its SQL, if SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for family in FAMILIES:
        import_module(f"catalog.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def r6(value: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(value) if isinstance(value, str) else value, 6)
    return out.alias(name or value) if (name or isinstance(value, str)) else out


class Tables:
    """The driver tables as cubes. One supplier is one grid cell, one ship date one day."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tasks: int | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cube(self, coordinates: bool = False) -> DataFrame:
        """Daily cube: ``value`` (quantity) and ``value2`` (line numbers), aggregated before any window."""
        out = self.lineitem.groupBy(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("time")).agg(
            F.sum("l_quantity").alias("value"), F.sum("l_linenumber").cast("double").alias("value2")
        )
        return with_coordinates(out) if coordinates else out

    def tasks(self) -> int:
        """Tasks for the calendars of all cells, looked up once."""
        if self._tasks is None:
            self._tasks = series_tasks(self.lineitem, ["l_suppkey"], "l_shipdate")
        return self._tasks

    def filled(self, fill: float | None = None) -> DataFrame:
        """Cube on a hole-free calendar, NULL (or ``fill``) on added days."""
        return fill_calendar(self.cube(), values=("value", "value2"), fill=fill, tasks=self.tasks())

    def cells(self) -> DataFrame:
        return with_coordinates(self.supplier.select(F.col("s_suppkey").alias("cell_id"), "s_nationkey"))

    def bands(self) -> DataFrame:
        """Two reflectance channels per line with a satellite product name."""
        return self.lineitem.select(
            "l_orderkey", "l_linenumber",
            (F.col("l_extendedprice") * F.col("l_discount")).alias("channel_1"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("channel_2"),
            F.concat(F.lit("MSG"), (F.col("l_linenumber") % 5 + 1).cast("string"), F.lit("-SEVIRI")).alias("product_name"),
        )

    def forecast(self) -> DataFrame:
        """Forecast table: two models by order line number, two horizons, persistence of the daily value.

        Truth and prediction are a cell's day and the day before in its series, on a calendar-bounded window.
        """
        prev1, prev2 = F.lag("value", 1).over(series()), F.lag("value", 2).over(series())
        base = by_series(self.cube(), tasks=self.tasks()).withColumn("_p", F.array(F.struct(F.lit("last").alias("model"), F.lit(10).alias("horizon"), prev1.alias("p")),
                                                    F.struct(F.lit("mean").alias("model"), F.lit(15).alias("horizon"), ((prev1 + prev2) / 2).alias("p"))))
        rows = base.select("cell_id", F.col("time").alias("valid_date"), "value", F.inline("_p"))
        return rows.select("model", "horizon", "valid_date", "cell_id", (F.col("value") / 50).alias("y"), (F.col("p") / 50).alias("y_pred"),
                           (F.col("cell_id") % 7 != 3).cast("int").alias("mask"))


def with_coordinates(df: DataFrame, cell: str = "cell_id") -> DataFrame:
    row, col = grid_row(cell), grid_col(cell)
    return df.withColumn("lat", F.lit(-5.25) + row * F.lit(0.2)).withColumn("lon", F.lit(32.25) + col * F.lit(0.25))


def grid_row(cell: str = "cell_id") -> Column:
    return F.floor(F.col(cell) / F.lit(10))


def grid_col(cell: str = "cell_id") -> Column:
    return F.col(cell) % 10


# --- the same adapters as SQL --------------------------------------------------------------------------

CUBE = """cube AS (
  SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS time, SUM(l_quantity) AS value,
         CAST(SUM(l_linenumber) AS DOUBLE) AS value2
  FROM lineitem GROUP BY 1, 2)"""
GRID = f"""{CUBE}, grid AS (
  SELECT *, -5.25 + (cell_id // 10) * 0.2::DOUBLE AS lat, 32.25 + (cell_id % 10) * 0.25::DOUBLE AS lon FROM cube)"""
FILLED = f"""{CUBE}, span AS (SELECT cell_id, MIN(time) AS a, MAX(time) AS b FROM cube GROUP BY 1),
days AS (SELECT cell_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time FROM span),
filled AS (SELECT d.cell_id, d.time, c.value, c.value2 FROM days d LEFT JOIN cube c ON c.cell_id = d.cell_id AND c.time = d.time)"""
BANDS = """bands AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS channel_1, l_extendedprice * l_tax AS channel_2,
         'MSG' || CAST(l_linenumber % 5 + 1 AS VARCHAR) || '-SEVIRI' AS product_name FROM lineitem)"""
FORECAST = f"""{CUBE}, lagged AS (
  SELECT *, LAG(value, 1) OVER (PARTITION BY cell_id ORDER BY time) AS p1, LAG(value, 2) OVER (PARTITION BY cell_id ORDER BY time) AS p2 FROM cube),
fc AS (
  SELECT 'last' AS model, 10 AS horizon, time AS valid_date, cell_id, value / 50 AS y, p1 / 50 AS y_pred, CAST(cell_id % 7 <> 3 AS INTEGER) AS mask FROM lagged
  UNION ALL
  SELECT 'mean', 15, time, cell_id, value / 50, (p1 + p2) / 2 / 50, CAST(cell_id % 7 <> 3 AS INTEGER) FROM lagged)"""

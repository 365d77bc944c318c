"""Helpers shared by the operators.

Keys name the series (usually the cell), ``time`` its axis. A cube holds one row per (keys, time), so a
window over one series is bounded by the calendar, however many raw measurements feed it. Raw rows are
therefore aggregated to the cube before any window runs.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

Keys = Sequence[str]
CELL: Keys = ("cell_id",)


def series(keys: Keys = CELL, time: str = "time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def up_to_now(keys: Keys = CELL, time: str = "time") -> WindowSpec:
    return series(keys, time).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def back_from_end(keys: Keys = CELL, time: str = "time") -> WindowSpec:
    """Running window from the end of the series. A frame open towards the end would be rescanned per row."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def series_tasks(df: DataFrame, keys: Keys = CELL, time: str = "time", rows: int = 1_000_000, least: int = 100_000) -> int:
    """Number of tasks that hold about ``rows`` days of calendar each: number of series times the days from the first to the last time.

    Smaller tables get a task a core, but none below ``least`` days (two at least: a single one is not dealt by series). It counts series and days, in one scan of ``keys`` and ``time`` without a
    shuffle of rows, so ``df`` is best the raw table. A job runs when called.
    """
    span = F.date_diff(F.max(time), F.min(time)) + 1
    days = df.agg((F.approx_count_distinct(F.struct(*keys)) * span).alias("_d")).first()[0] or 0
    return max(2, math.ceil(days / rows), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(days / least)))


def by_series(df: DataFrame, keys: Keys = CELL, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by series to a given number of tasks; every window over a series then stays there. None leaves it to the planner."""
    return df if tasks is None else df.repartition(tasks, *keys)


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """Whole-table aggregate as a scalar subquery: one row, no join and no driver round trip."""
    return df.agg(aggregate.alias("_v")).scalar()


def first_per_key(df: DataFrame, keys: Keys, order: str | Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``, ties broken by the other columns.

    An aggregate and not a window: copies of one key merge on the map side, so a key holding a large
    share of the rows never meets in one task.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    out = df.groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0 for an all-missing group."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenate by name; columns absent on one side become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def label_axis(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Concatenate along a new axis: one key column holding each frame's label."""
    return union_all(*[frame.withColumn(name, F.lit(label)) for label, frame in frames.items()])


def head_by_time(df: DataFrame, n: int, time: str = "time", last: bool = False) -> DataFrame:
    """Rows of the first (last) n distinct times."""
    stamp = F.col(time).desc() if last else F.col(time).asc()
    return df.join(df.select(time).distinct().orderBy(stamp).limit(n), time, "left_semi")


def to_wide(df: DataFrame, keys: Keys, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide over a given list of names; one value per (keys, name)."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def to_long(df: DataFrame, keys: Keys, values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept below ``spark.checkpoint.dir``, so a plan that is built step by step doesn't grow.

    Only a local session without that setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()

"""Coverage, null and negative-value audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from drygrid.operators.common import CELL, Keys


def negative_days(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """Number of cells below zero per day, days without any left out."""
    counts = df.groupBy(time).agg(F.count_if(F.col(value) < 0).alias("negatives"))
    return counts.where("negatives > 0")


def null_share_by_day(df: DataFrame, time: str = "time", value: str = "value", points: int | None = None) -> DataFrame:
    """Share of missing cells per day against ``points`` cells (default: the best-covered day)."""
    daily = df.groupBy(time).agg(F.count(value).alias("valid"))
    total = F.lit(points) if points is not None else daily.agg(F.max("valid")).scalar()
    return daily.select(time, "valid", (1 - F.try_divide(F.col("valid"), total)).alias("null_share"))


def coverage(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """One row: cells on the best-covered day and mean coverage, whole cells over that, two decimals."""
    daily = df.groupBy(time).agg(F.count(value).alias("n"))
    return daily.agg(F.max("n").alias("points"), F.floor(F.avg("n")).alias("mean_valid")).select(
        "points", F.round(F.try_divide(F.col("mean_valid"), F.col("points")), 2).alias("valid_share")
    )


def null_audit(df: DataFrame, values: Sequence[str], keys: Keys = CELL) -> DataFrame:
    """Per variable: rows, NULLs, known values and mean NULLs per series."""
    parts = [F.count(F.lit(1)).alias("rows"), F.count_distinct(*[F.col(k) for k in keys]).alias("cells")]
    parts += [F.count(v).alias(f"_k_{v}") for v in values]
    wide = df.agg(*parts)
    entries = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"_k_{v}").alias("known")) for v in values])
    out = wide.select("rows", "cells", F.inline(entries))
    return out.select(
        "variable", "rows", (F.col("rows") - F.col("known")).alias("nulls"), "known",
        F.try_divide(F.col("rows") - F.col("known"), F.col("cells")).alias("nulls_per_cell"),
    )


def extreme_times(df: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """Times of the largest value (latest tie) and of the smallest (earliest tie)."""
    at = F.struct(F.col(value), F.col(time))
    known = df.where(F.col(value).isNotNull())
    return known.agg(F.max(at).alias("hi"), F.min(at).alias("lo")).select(
        F.col("hi")[time].alias("time_max"), F.col("hi")[value].alias("value_max"),
        F.col("lo")[time].alias("time_min"), F.col("lo")[value].alias("value_min"),
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()

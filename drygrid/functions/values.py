"""Column rules for missing values, clamps, scaling and threshold flags.

Missing is NULL everywhere. Spark treats NaN as the largest number and lets it through averages, so a
reader must call :func:`nan_to_null` before anything else sees the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def declare_missing(df: DataFrame, columns: Sequence[str] | None = None, parse: bool = False) -> DataFrame:
    """NaN to NULL on every floating column; with ``parse`` text columns become doubles first."""
    names = set(columns) if columns is not None else None
    out = []
    for field in df.schema.fields:
        value = F.col(field.name)
        wanted = names is None or field.name in names
        if wanted and parse and isinstance(field.dataType, StringType):
            value = nan_to_null(value.try_cast("double"))
        elif wanted and isinstance(field.dataType, (FloatType, DoubleType)):
            value = nan_to_null(value)
        out.append(value.alias(field.name))
    return df.select(*out)


def fill_missing(value: Column, fill: float = -1.0) -> Column:
    return F.coalesce(value, F.lit(fill))


def sentinel_to_null(value: Column, sentinel: float = -1.0) -> Column:
    return F.nullif(value, F.lit(sentinel))


def floor_at_zero(value: Column, null_as_zero: bool = False) -> Column:
    """Negatives become 0. ``null_as_zero`` also turns NULL into 0 (keep-if-positive form)."""
    if null_as_zero:
        return F.when(value > 0, value).otherwise(F.lit(0.0))
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def null_outside(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(value.between(low, high), value)


def zero_to_null(value: Column, strict: bool = False) -> Column:
    """0 marks a cleared pixel. ``strict`` keeps the value as it is (the comparison never matches)."""
    return value if strict else F.nullif(value, F.lit(0.0))


def unpack(value: Column, fill: float, offset: float, scale: float) -> Column:
    """Packed storage: fill value to NULL, then (value - offset) * scale."""
    return (F.nullif(value.cast("double"), F.lit(float(fill))) - F.lit(offset)) * F.lit(scale)


def metres_to_millimetres(value: Column) -> Column:
    return value * F.lit(1000.0)


def kelvin_to_celsius(value: Column) -> Column:
    return value - F.lit(273.15)


def drought_flag(value: Column, threshold: float = -2.0) -> Column:
    """1 at or below the threshold, 0 above, NULL stays NULL."""
    return F.when(value.isNotNull(), (value <= threshold).cast("int"))


def low_flag(value: Column, threshold: float = 10.0) -> Column:
    """1 strictly below the threshold, 0 otherwise, NULL stays NULL."""
    return F.when(value.isNotNull(), (value < threshold).cast("int"))


def rain_flag(value: Column, millimetres: float = 1.0) -> Column:
    """1 above the limit; NULL counts as dry."""
    return F.when(value > millimetres, 1).otherwise(0)


def wet_flag(value: Column, limit: float = 2.0) -> Column:
    return F.when(value >= limit, 1).otherwise(0)


def dry_flag(value: Column, limit: float = -2.0) -> Column:
    return F.when(value <= limit, 1).otherwise(0)


def min_max_scale(value: Column, low: Column, high: Column) -> Column:
    return F.try_divide(value - low, high - low)


def min_max_restore(value: Column, low: Column, high: Column, null_value: float | None = None) -> Column:
    restored = value * (high - low) + low
    return restored if null_value is None else F.when(value == null_value, F.lit(null_value)).otherwise(restored)


def z_scale(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)


def z_restore(value: Column, mean: Column, std: Column, null_value: float | None = None) -> Column:
    restored = value * std + mean
    return restored if null_value is None else F.when(value == null_value, F.lit(null_value)).otherwise(restored)


def l1_normalise(vector: Column) -> Column:
    """Array divided by the sum of its absolute entries; an all-zero array gives NULL entries."""
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), total))


def confidence_bounds(mean: Column, std: Column, n: Column, critical: Column) -> tuple[Column, Column]:
    """mean -/+ critical * std / sqrt(n)."""
    half = critical * F.try_divide(std, F.sqrt(n))
    return mean - half, mean + half

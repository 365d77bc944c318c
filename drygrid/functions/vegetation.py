"""Reflectance, NDVI and quality-bit column rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from drygrid.functions.values import clamp, null_outside

# Band irradiances of the four geostationary satellites (0.6 um, 0.8 um).
IRRADIANCE = {
    "MSG1": (65.2296, 73.1869),
    "MSG2": (65.2065, 73.0127),
    "MSG3": (65.5148, 73.1807),
    "MSG4": (65.2656, 73.1692),
}
# Linear correction between the two NDVI products.
BIAS_OFFSET, BIAS_SLOPE = 0.015705526, 1.256689
# Packed NDVI with 255 as fill.
PACKED_FILL, PACKED_OFFSET, PACKED_STEP = 255, -0.08, 0.004


def ndvi(red: Column, nir: Column, good: Column | None = None) -> Column:
    """(nir - red) / (nir + red); 0/0 and rows failing ``good`` give NULL."""
    index = F.try_divide(nir - red, nir + red)
    return index if good is None else F.when(good, index)


def irradiance(satellite: Column, band: int) -> Column:
    """Irradiance of a satellite's band, NULL for other platforms."""
    table = F.create_map(*[F.lit(x) for name, pair in IRRADIANCE.items() for x in (name, pair[band])])
    return F.try_element_at(table, satellite)


def radiance(channel: Column, product_name: Column, band: int) -> Column:
    """Channel over its irradiance; the satellite is the first four letters of the product name."""
    return channel / F.coalesce(irradiance(F.substring(product_name, 1, 4), band), F.lit(1.0))


def ndvi_irradiance_weighted(red: Column, nir: Column, irr_red: Column, irr_nir: Column) -> Column:
    return F.try_divide(nir * irr_red - red * irr_nir, nir * irr_red + red * irr_nir)


def unpack_byte_ndvi(packed: Column) -> Column:
    """255 to NULL, then -0.08 + 0.004 x."""
    return F.lit(PACKED_OFFSET) + F.nullif(packed.cast("double"), F.lit(float(PACKED_FILL))) * F.lit(PACKED_STEP)


def unpack_percent_ndvi(packed: Column) -> Column:
    """255 to NULL, then x / 100."""
    return F.nullif(packed.cast("double"), F.lit(float(PACKED_FILL))) / F.lit(100.0)


def half_day_back(time: Column) -> Column:
    return time - F.expr("INTERVAL 12 HOURS")


def correct_bias(value: Column) -> Column:
    return F.lit(BIAS_OFFSET) + F.lit(BIAS_SLOPE) * value


def remove_outliers(value: Column, impute: bool = False) -> Column:
    """Clamp to [-1, 1] when imputing, else NULL outside it."""
    return clamp(value) if impute else null_outside(value)


def bit_field(packed: Column, first: int, last: int) -> Column:
    """Integer held by bits first..last."""
    return F.shiftright(packed, first).bitwiseAND((1 << (last - first + 1)) - 1)


def qa_cloudy(packed: Column) -> Column:
    """1 where bits 1-2 are both clear."""
    return (packed.bitwiseAND(6) == 0).cast("int")


def qa_water(packed: Column) -> Column:
    """1 where bits 6-7 read water (0) or coast (64)."""
    return packed.bitwiseAND(192).isin(0, 64).cast("int")

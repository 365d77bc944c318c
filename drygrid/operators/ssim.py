"""Structural similarity of image pairs stored as (image, row, col, a, b) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Window, spread and stabilising constants of the index.
WINDOW, SIGMA, K1, K2 = 11, 1.5, 0.01, 0.03


def gaussian_weights(window: int = WINDOW, sigma: float = SIGMA) -> list[float]:
    raw = [math.exp(-((i - window // 2) ** 2) / (2 * sigma**2)) for i in range(window)]
    return [w / sum(raw) for w in raw]


def _blur(df: DataFrame, image: Sequence[str], line: str, along: str, columns: Sequence[str], weights: list[float], reflect: bool) -> DataFrame:
    """Weighted sum along one axis: a range frame of at most ``window`` neighbours per pixel."""
    half = len(weights) // 2
    kernel = F.array(*[F.lit(w) for w in weights])
    whole = Window.partitionBy(*image, line)
    frame = whole.orderBy(along).rangeBetween(-half, half)
    work = df.withColumn("_near", F.collect_list(F.struct(F.col(along).alias("at"), *columns)).over(frame))
    if reflect:
        work = work.withColumn("_lo", F.min(along).over(whole)).withColumn("_hi", F.max(along).over(whole))

    def weight(offset: Column) -> Column:
        return F.when(F.abs(offset) <= half, F.element_at(kernel, (offset + half + 1).cast("int"))).otherwise(0.0)

    def total(x: Column) -> Column:
        here = F.col(along)
        w = weight(x["at"] - here)
        if reflect:
            w = w + F.when(x["at"] != F.col("_lo"), weight(2 * F.col("_lo") - x["at"] - here)).otherwise(0.0)
            w = w + F.when(x["at"] != F.col("_hi"), weight(2 * F.col("_hi") - x["at"] - here)).otherwise(0.0)
        return w

    def summed(name: str) -> Column:
        return F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + total(x) * x[name])

    blurred = [summed(c).alias(c) for c in columns]
    others = [c for c in df.columns if c not in columns]
    return work.select(*others, *blurred)


def ssim_map(
    df: DataFrame, image: Sequence[str] = ("image",), row: str = "row", col: str = "col", a: str = "a", b: str = "b",
    span: float = 2.0, padding: str = "zero", fill: float = 0.0,
) -> DataFrame:
    """SSIM of every pixel.

    The 11 x 11 Gaussian separates into one pass along rows and one along columns; a group is one line
    of one image. ``padding`` is ``zero`` or ``reflect``; missing pixels read as ``fill``.
    """
    if padding not in ("zero", "reflect"):
        raise ValueError("padding must be 'zero' or 'reflect'")
    x = F.coalesce(F.col(a).cast("double"), F.lit(fill))
    y = F.coalesce(F.col(b).cast("double"), F.lit(fill))
    work = df.select(*image, row, col, x.alias("_x"), y.alias("_y"), (x * x).alias("_xx"), (y * y).alias("_yy"), (x * y).alias("_xy"))
    parts = ["_x", "_y", "_xx", "_yy", "_xy"]
    weights = gaussian_weights()
    work = _blur(work, image, col, row, parts, weights, padding == "reflect")
    work = _blur(work, image, row, col, parts, weights, padding == "reflect")
    mx, my = F.col("_x"), F.col("_y")
    vx, vy, vxy = F.col("_xx") - mx * mx, F.col("_yy") - my * my, F.col("_xy") - mx * my
    c1, c2 = (K1 * span) ** 2, (K2 * span) ** 2
    score = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return work.select(*image, row, col, score.alias("ssim"))


def ssim(df: DataFrame, image: Sequence[str] = ("image",), by: Sequence[str] = (), **options) -> DataFrame:
    """Mean SSIM: over the pixels of each image, then over images (per ``by``)."""
    per_image = ssim_map(df, image, **options).groupBy(*image).agg(F.avg("ssim").alias("ssim"))
    return per_image.groupBy(*by).agg(F.avg("ssim").alias("ssim"))

"""Polygons, zonal means and nearest-neighbour filling in space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from drygrid.operators.align import swap_axes
from drygrid.operators.common import CELL, Keys


def polygon_edges(rings: DataFrame, region: str = "region") -> DataFrame:
    """Edges of closed rings given as (region, ring_id, points array<struct<lon,lat>>)."""
    after = F.concat(F.slice("points", F.lit(2), F.size("points") - 1), F.slice("points", F.lit(1), F.lit(1)))
    pairs = F.arrays_zip(F.col("points").alias("a"), after.alias("b"))
    return rings.select(region, "ring_id", F.posexplode(pairs).alias("seq", "_e")).select(
        region, "ring_id", "seq",
        F.col("_e.a.lon").alias("lon1"), F.col("_e.a.lat").alias("lat1"),
        F.col("_e.b.lon").alias("lon2"), F.col("_e.b.lat").alias("lat2"),
    )


def assign_region(cells: DataFrame, edges: DataFrame, region: str = "region", keys: Keys = CELL, band: float = 1.0) -> DataFrame:
    """(keys, region) for every cell centre inside a region, by ray casting.

    Only the distinct latitudes of the cells meet the edges, on integer latitude bands (an equi-join; each edge enters the bands it
    spans), and leave one array of crossing longitudes per region and latitude. Cells join these arrays on their latitude: a cell is
    inside when a ray to the east crosses an odd number of edges. So rows grow with cells times the regions at their latitude, never
    with cells times edges. Edges are half open in latitude, so a vertex counts once. ``cells`` are distinct cells, not rows of a series.
    """
    step = F.lit(float(band))
    points = cells.select(*keys, "lat", "lon").distinct()
    rows = points.select("lat").distinct().withColumn("_b", F.floor(F.col("lat") / step))
    spans = edges.where("lat1 <> lat2").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.least("lat1", "lat2") / step), F.floor(F.greatest("lat1", "lat2") / step)))
    )
    crosses = (F.col("lat1") <= F.col("lat")) != (F.col("lat2") <= F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    crossings = rows.join(spans.select(region, "lat1", "lon1", "lat2", "lon2", "_b"), "_b").where(crosses).groupBy(region, "lat").agg(F.collect_list(at).alias("_x"))
    inside = F.size(F.filter("_x", lambda x: x > F.col("lon"))) % 2 == 1
    return points.join(crossings, "lat").where(inside).select(*keys, region)


def clip_to_regions(
    df: DataFrame, edges: DataFrame, countries: list[str] | None = None, regions: list[str] | None = None,
    country_col: str = "country", region_col: str = "region", keys: Keys = CELL, outside: bool = False, invert: bool = False,
) -> DataFrame:
    """Rows of the cells inside (or outside) the union of named polygons; give countries or regions, not both."""
    if (countries is None) == (regions is None):
        raise ValueError("give either countries or regions")
    column, names = (country_col, countries) if countries is not None else (region_col, regions)
    chosen = edges.where(F.col(column).isin(*names))
    cells = df.select(*keys, "lat", "lon").distinct()
    if invert:
        cells = swap_axes(cells)
    # Parity counts within one polygon; overlapping polygons of a country must not cancel.
    polygon = region_col if region_col in edges.columns else column
    inside = assign_region(cells, chosen, polygon, keys).select(*keys).distinct()
    return df.join(inside, list(keys), "left_anti" if outside else "left_semi")


def zonal_mean(
    df: DataFrame, region: str = "region", time: str = "time", value: str = "value", weighted: bool = False, strict: bool = False
) -> DataFrame:
    """Mean per (region, time), optionally weighted by cos(latitude).

    Missing cells leave the denominator; ``strict`` keeps them in it.
    """
    v = F.col(value)
    w = F.cos(F.radians("lat")) if weighted else F.lit(1.0)
    counted: Column = w if strict else F.when(v.isNotNull(), w)
    return df.groupBy(region, time).agg(F.try_divide(F.coalesce(F.sum(v * w), F.lit(0.0)), F.sum(counted)).alias("mean"))


def regional_mean_on_cells(df: DataFrame, region: str = "region", time: str = "time", value: str = "value") -> DataFrame:
    """Every row carries the mean of its region and time.

    An aggregate and a join instead of a window: a region can hold a third of all cells, and the mean
    is combined on the map side before it meets them.
    """
    means = df.groupBy(region, time).agg(F.avg(value).alias("region_mean"))
    return df.join(means, [region, time], "left")


def fill_nearest_in_space(
    df: DataFrame, time: str = "time", value: str = "value", lat: str = "lat", lon: str = "lon", max_distance: float | None = None
) -> DataFrame:
    """Each NULL cell takes the value of the nearest known cell of the same time (in degrees).

    Exact, in two passes over lines of the grid: along every meridian the nearest known value north and
    south (running windows), then along every parallel the best of those candidates. No group is larger
    than one grid line and no pairs are emitted. Ties (to nine decimals of a
    degree) take the lower latitude, then the lower longitude.
    """
    column = Window.partitionBy(time, lon)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(lat).alias("y"), F.col(value).cast("double").alias("v")))
    work = df.withColumn("_k", known)
    work = work.withColumn("_s", F.last("_k", ignorenulls=True).over(column.orderBy(F.col(lat).asc())))
    work = work.withColumn("_n", F.last("_k", ignorenulls=True).over(column.orderBy(F.col(lat).desc())))
    south, north = F.round(F.col(lat) - F.col("_s")["y"], 9), F.round(F.col("_n")["y"] - F.col(lat), 9)
    best = F.when(F.col("_n").isNull() | (south <= north), F.col("_s")).otherwise(F.col("_n"))
    work = work.withColumn("_c", best).withColumn("_cy", F.col("_c")["y"]).withColumn("_cv", F.col("_c")["v"])
    rows = F.array_sort(F.collect_list(F.struct(
        F.col(lon).cast("double").alias("_x"), F.col(value).cast("double").alias("_v"), "_cy", "_cv",
        *[F.col(c) for c in df.columns if c != value],
    )))
    lines = work.groupBy(F.col(time).alias("_t"), F.col(lat).alias("_y")).agg(rows.alias("_rows"))
    lines = lines.select(F.col("_y").cast("double").alias("_y"), "_rows", *[F.col("_rows")[c].alias(c) for c in ("_x", "_v", "_cy", "_cv")])
    reach = np.inf if max_distance is None else float(max_distance)

    @F.arrow_udf(ArrayType(DoubleType()))
    def fill(y: pa.Array, x: pa.Array, v: pa.Array, cy: pa.Array, cv: pa.Array) -> pa.Array:
        size = x.value_lengths().to_numpy(zero_copy_only=False)
        x, v, cy, cv = (c.flatten().to_numpy(zero_copy_only=False) for c in (x, v, cy, cv))
        out = _fill_lines(np.repeat(np.arange(len(size)), size), np.repeat(y.to_numpy(zero_copy_only=False), size), x, v, cy, cv, reach)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(out, from_pandas=True))

    done = lines.select("_rows", fill("_y", "_x", "_v", "_cy", "_cv").alias("_filled")).select(F.inline(F.arrays_zip("_rows", "_filled")))
    return done.select(*[F.col("_filled").alias(c) if c == value else F.col("_rows")[c].alias(c) for c in df.columns])


def _fill_lines(line: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, cy: np.ndarray, cv: np.ndarray, reach: float) -> np.ndarray:
    """Fill the holes of many parallels at once; the cells of a line are sorted by longitude.

    From each hole the search walks to the nearest candidates west and east and stops where the longitude alone is farther than the
    best one: a hole costs as many steps as its nearest value is columns away, however long the line.
    """
    v = v.astype(float, copy=True)
    has = ~np.isnan(cv)
    px, py, pv = x[has], cy[has], cv[has]
    rise = (py - y[has]) ** 2
    before = np.concatenate(([0], np.cumsum(has)))
    first = np.searchsorted(line[has], np.arange(line[-1] + 2 if len(line) else 1))
    hole = np.flatnonzero(np.isnan(v))
    low, high = first[line[hole]], first[line[hole] + 1]
    best = np.stack([np.full(len(hole), np.inf)] * 3)  # distance, latitude, longitude: the least of them in this order wins
    pick = np.full(len(hole), -1)
    for step, at in ((1, before[hole]), (-1, before[hole] - 1)):
        live, at = np.arange(len(hole)), at.copy()
        while len(live):
            inside = (at >= low[live]) & (at < high[live])
            live, at = live[inside], at[inside]
            aside = (x[hole[live]] - px[at]) ** 2
            near = np.round(aside, 9) <= best[0, live]
            live, at, aside = live[near], at[near], aside[near]
            found = np.stack([np.round(aside + rise[at], 9), py[at], px[at]])
            old = best[:, live]
            wins = (found[0] < old[0]) | (found[0] == old[0]) & ((found[1] < old[1]) | (found[1] == old[1]) & (found[2] < old[2]))
            best[:, live[wins]] = found[:, wins]
            pick[live[wins]] = at[wins]
            at = at + step
    hit = (pick >= 0) & (best[0] <= reach * reach)
    v[hole[hit]] = pv[pick[hit]]
    return v


def impute(df: DataFrame, method: str = "constant", value: str = "value", fill: float | None = None, time: str = "time") -> DataFrame:
    """Fill missing cells: ``constant`` (needs a number), ``nearest`` in space, or ``none``."""
    if method == "constant":
        if fill is None:
            raise ValueError("constant imputation needs a fill value")
        return df.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))
    if method == "nearest":
        return fill_nearest_in_space(df, time, value)
    if method == "none":
        return df
    raise NotImplementedError(f"imputation {method} is not defined")

"""Exact quantiles (linear interpolation) that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.operators.common import checkpointed

ACCURACY = 1000
GRID = 200
SLICES = 64
FEW = 4096  # groups whose small tables are broadcast


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    name: str = "quantiles",
    bounded: bool = False,
) -> DataFrame:
    """Array of quantiles of ``value`` per ``keys``, NULLs ignored.

    A bounded sketch per group gives ``GRID`` + 1 evenly spaced quantiles, each at most ``1 / ACCURACY`` of the group off its rank. The
    grid points a step outside the two ranks of a probability bracket them, whatever the group's size. Rows inside a bracket keep their
    value, rows between brackets only count, and both collapse on the map side. The exact rank is then read from the bracket rows, cut
    into slices of which only those holding a wanted rank are sorted. A rank without a row is an error, never a NULL.

    A sketch depends on the order in which tasks deliver, so it may differ each time it is computed. The sliced counts are therefore
    computed once and kept (:func:`checkpointed`, a job when called); slice totals and ranks both come from that copy. Brackets at a
    group's ends are open, so values that move by a rounding error between scans are not lost.

    ``bounded`` is the caller's word that the distinct values of a group fit in memory (one cell's calendar, a short list of dates):
    then Spark's exact ``percentile`` does the same in one aggregate.
    """
    groups = keys = list(keys)
    probs = [float(p) for p in probs]
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if bounded:
        exact = F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias(name)
        found = data.groupBy(*keys).agg(exact)
        return found if keys else found.where(F.col(name).isNotNull())
    grid = F.percentile_approx("_v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
    stats = [F.count("_v").alias("_n"), grid.alias("_e")]
    if not keys:
        # One group for the whole table. The key is computed, because joining on a literal is a cross join.
        keys = ["_all"]
        data = data.withColumn("_all", F.pmod(F.hash("_v"), F.lit(1)))


    def point(index: Column, end: float) -> Column:
        """Grid value, or no bound beyond the grid. NaN is the largest value."""
        inside = (index > 0) & (index < GRID)
        return F.when(inside, F.get("_e", index.cast("int"))).otherwise(F.lit(end))

    positions = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    lows = [point(F.floor(F.floor(r) / F.col("_n") * GRID) - 1, float("-inf")) for r in positions]
    highs = [point(F.ceil((F.ceil(r) + 1) / F.col("_n") * GRID) + 1, float("nan")) for r in positions]
    edges = [F.col(f"_b{i}") for i in range(2 * len(probs))]
    brackets = data.groupBy(*keys).agg(*stats).select(*keys, "_n", *[e.alias(f"_b{i}") for i, e in enumerate([x for pair in zip(lows, highs) for x in pair])])
    # Few groups hold many rows each: their brackets, cuts and wanted slices, some rows a group, come to the rows by broadcast.
    brackets = checkpointed(brackets)
    few = not groups or len(brackets.limit(FEW + 1).select(*keys).collect()) <= FEW
    small = F.broadcast if few else lambda table: table
    joined = data.join(small(brackets), keys)

    # Plain comparisons, one per bracket: they compile, lambdas over arrays do not.
    highs = edges[1::2]
    within = [F.col("_v").between(lo, hi) for lo, hi in zip(edges[::2], highs)]
    inside = reduce(lambda x, y: x | y, within)
    none = F.lit(None).cast("double")
    below = F.greatest(none, *[F.when(h < F.col("_v"), h) for h in highs])
    counted = (
        joined.withColumn("_keep", inside)
        .withColumn("_at", F.when(F.col("_keep"), F.col("_v")).otherwise(below))
        .groupBy(*keys, "_n", "_at", "_keep")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # Counted-only rows sort just after the bracket end below them, so (at, kept first) is the value order.
    # Equi-depth splitters cut that order into slices. Slice totals give each slice its starting rank, and
    # only slices that hold a wanted rank are sorted, each in its own task.
    even = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    # The total makes both uses of the counts need the same columns, so one shuffle of them can serve both.
    splitters = counted.groupBy(*keys).agg(F.percentile_approx("_at", even, ACCURACY).alias("_s"), F.sum("_c").alias("_w")).where("_w > 0").drop("_w")
    sliced = counted.join(small(splitters), keys)
    inner = F.coalesce(F.size(F.filter("_s", lambda c: c < F.col("_at"))), F.lit(0))
    sliced = sliced.withColumn("_slice", F.when(F.col("_at").isNull(), F.lit(-1)).otherwise(inner)).drop("_s")
    sliced = checkpointed(sliced)  # the splitters are a sketch too: a second computation may cut elsewhere
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_total"), F.first("_n").alias("_n"))
    ends = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_before", F.sum("_total").over(ends) - F.col("_total"))

    ranks = [rank for position in positions for rank in (F.floor(position), F.ceil(position))]
    holds = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_total")) for r in ranks]
    wanted = totals.where(reduce(lambda x, y: x | y, holds)).select(*keys, "_slice", "_before")
    on = [*keys, "_slice"]
    chosen = sliced.join(small(wanted), on)
    running = Window.partitionBy(*on).orderBy(F.col("_at").asc_nulls_first(), F.col("_keep").desc())
    chosen = chosen.withColumn("_cum", F.col("_before") + F.sum("_c").over(running.rowsBetween(Window.unboundedPreceding, 0)))

    def at_rank(rank):
        hit = F.col("_keep") & (F.col("_cum") > rank) & (F.col("_cum") - F.col("_c") <= rank)
        return F.coalesce(F.min(F.when(hit, F.col("_at"))), F.raise_error(F.lit("a bracket misses its rank")).cast("double"))

    out = chosen.groupBy(*keys).agg(F.first("_n").alias("_n"), *[at_rank(r).alias(f"_r{i}") for i, r in enumerate(ranks)])
    results = []
    for i, position in enumerate(positions):
        lo, hi = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        results.append(lo + (hi - lo) * (position - F.floor(position)))
    return out.select(*groups, F.array(*results).alias(name))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Quantiles as columns, ``named`` mapping column name to probability."""
    out = exact_quantiles(df, value, list(named.values()), keys, "_q", bounded)
    return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(named)])

"""User-defined aggregates whose states merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# How the states of two batches become one.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}

Partial = Callable[[dict[str, np.ndarray], np.ndarray, int], Mapping[str, np.ndarray]]


def user_aggregate(
    df: DataFrame, by: Sequence[str], inputs: Sequence[str], partial: Partial, merge: Mapping[str, str], finish: Callable[[dict[str, Column]], Mapping[str, Column]],
) -> DataFrame:
    """(by, results) of a metric written in numpy.

    ``partial(values, group, n)`` gets the input columns of a batch as arrays of doubles (NULL is NaN), the number of each row's group and
    the number of groups; it returns one array of n doubles per state. ``merge`` says of each state whether states are added up or the
    least or greatest stays; ``finish`` makes result columns of the merged states. Each batch sends one row per group, which merge on the
    map side and then in one shuffle, so a group with a third of all rows is never gathered. A state that is NaN is left out by the merge.
    A NULL key is a group. Without ``by`` the result is one row; NULL states stand for an empty table.
    """
    unknown = set(merge.values()) - set(MERGES)
    if unknown:
        raise ValueError(f"merge must be one of {sorted(MERGES)}")
    by, inputs, states = list(by), list(inputs), list(merge)
    clash = set(by) & set(states)
    if clash:
        raise ValueError(f"states named like keys: {sorted(clash)}")
    work = df.select(*by, *[F.col(c).cast("double").alias(f"_in_{i}") for i, c in enumerate(inputs)])
    schema = StructType([StructField(f.name, f.dataType) for f in work.schema.fields[: len(by)]] + [StructField(s, DoubleType()) for s in states])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            values = {c: frame[f"_in_{i}"].to_numpy(float) for i, c in enumerate(inputs)}
            if by:
                group = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                out = frame[by].iloc[first].reset_index(drop=True)
            else:
                group, out = np.zeros(len(frame), dtype=np.int64), pd.DataFrame(index=range(1))
            found = partial(values, group, len(out))
            for s in states:
                out[s] = np.asarray(found[s], dtype=float)
            yield out

    sent = work.mapInPandas(run, schema)
    merged = sent.groupBy(*by).agg(*[MERGES[kind](F.nanvl(s, F.lit(None).cast("double"))).alias(s) for s, kind in merge.items()])
    results = finish({s: F.col(s) for s in states})
    return merged.select(*by, *[column.alias(name) for name, column in results.items()])


def huber_error(df: DataFrame, by: Sequence[str], pred: str = "y_pred", truth: str = "y", limit: float = 0.2) -> DataFrame:
    """Mean and greatest Huber loss and its pairs per group: quadratic up to ``limit``, linear beyond. Pairs with a NULL don't count."""

    def partial(values: dict[str, np.ndarray], group: np.ndarray, n: int) -> dict[str, np.ndarray]:
        error = np.abs(values[pred] - values[truth])
        known = ~np.isnan(error)
        loss = np.where(error <= limit, error * error / 2, limit * (error - limit / 2))[known]
        worst = np.full(n, np.nan)
        np.fmax.at(worst, group[known], loss)
        return {"total": np.bincount(group[known], loss, n), "pairs": np.bincount(group[known], minlength=n), "worst": worst}

    return user_aggregate(df, by, [pred, truth], partial, {"total": "sum", "pairs": "sum", "worst": "max"},
                          lambda s: {"huber": F.try_divide(s["total"], s["pairs"]), "worst": s["worst"], "pairs": s["pairs"].cast("long")})

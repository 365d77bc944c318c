"""Supervised samples: windows, labels, splits, folds, batches and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.functions.values import min_max_restore, min_max_scale, z_restore, z_scale
from drygrid.operators.common import CELL, Keys, one_value, series


def supervised_windows(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    horizon: int,
    out: int = 1,
    step: int = 1,
    keys: Keys = CELL,
    time: str = "time",
    lag_channel: bool = False,
    only_lag: bool = False,
    last_obs: bool = False,
    diffusion_days: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """One sample per origin row t that has a full window and a full label.

    ``x`` is an array over window rows [t - length, t) taken every ``step``-th, each an array of the
    channels; ``y`` is the target of rows t + horizon … t + horizon + out - 1. ``lag_channel`` adds the
    target as a last channel, ``only_lag`` zeroes the others, ``last_obs`` repeats the last frame.
    ``diffusion_days`` starts at that row and takes features from its first rows on, ``out`` long per
    step of the origin (the window then starts ``diffusion_days`` rows before t and ends at t + out).
    Window and label dates come along; ``strict`` dates the label one day early.
    """
    w = series(keys, time)
    channels = [F.col(c).cast("float") for c in features]
    frame_channels = [F.lit(0.0).cast("float") if only_lag else c for c in channels]
    if lag_channel:
        frame_channels.append(F.col(target).cast("float"))
    before = length if diffusion_days is None else diffusion_days
    ahead = -1 if diffusion_days is None else out - 1
    size = before + ahead + 1
    window = w.rowsBetween(-before, ahead)
    label = w.rowsBetween(horizon, horizon + out - 1)
    row = F.struct(F.col(time).alias("t"), F.array(*frame_channels).alias("c"))
    work = df.select(
        *keys, F.col(time).alias("origin"),
        (F.row_number().over(w) - 1 - before).cast("long").alias("sample_id"),
        F.collect_list(row).over(window).alias("_x"),
        F.collect_list(F.struct(F.col(time).alias("t"), F.col(target).cast("float").alias("v"))).over(label).alias("_y"),
    )
    work = work.where((F.size("_x") == size) & (F.size("_y") == out) & (F.col("sample_id") >= 0))
    picked = F.filter(F.col("_x.c"), lambda c, i: (i % step == 0) if step > 1 else F.lit(True))
    if last_obs:
        end = F.element_at(F.col("_x.c"), -1)
        if lag_channel:
            # The lag channel keeps its own history.
            n = len(features)
            picked = F.transform(picked, lambda c: F.concat(F.slice(end, 1, n), F.slice(c, n + 1, 1)))
        else:
            picked = F.transform(picked, lambda c: end)
    shift = 1 if strict else 0
    return work.select(
        *keys, "sample_id", "origin", picked.alias("x"), F.col("_y.v").alias("y"),
        F.col("_x")[0]["t"].alias("x_start"), F.element_at("_x", -1)["t"].alias("x_end"),
        F.date_sub(F.col("_y")[0]["t"], shift).alias("y_start"), F.date_sub(F.element_at("_y", -1)["t"], shift).alias("y_end"),
    )


def offset_windows(df: DataFrame, x: str, y: str, n: int, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """x = the last n rows up to t, y = the next n rows."""
    w = series(keys, time)
    back, fwd = w.rowsBetween(-(n - 1), 0), w.rowsBetween(1, n)
    work = df.select(
        *keys, F.col(time).alias("origin"),
        F.collect_list(F.struct(F.col(x).alias("v"))).over(back).alias("_x"),
        F.collect_list(F.struct(F.col(y).alias("v"))).over(fwd).alias("_y"),
    )
    return work.where((F.size("_x") == n) & (F.size("_y") == n)).select(*keys, "origin", F.col("_x.v").alias("x"), F.col("_y.v").alias("y"))


def conditioning(samples: DataFrame, mode: str = "none", encoder: DataFrame | None = None, on: Sequence[str] = ("cell_id", "sample_id"), n_encoded: int | None = None, lag_last: bool = True) -> DataFrame:
    """Add ``cond``: channels that steer a model.

    none / climate (last day of the window without the lag channel) / soil (channels from the fifth on) /
    autoenc (last n encoder columns) / all (climate followed by encoder).
    """
    last = F.element_at(F.col("x"), -1)
    climate = F.slice(last, F.lit(1), F.size(last) - (1 if lag_last else 0))
    if mode == "none":
        return samples
    if mode == "climate":
        return samples.withColumn("cond", climate)
    if mode == "soil":
        return samples.withColumn("cond", F.slice(last, F.lit(5), F.greatest(F.size(last) - 4, F.lit(0))))
    if mode not in ("autoenc", "all"):
        raise ValueError("mode must be none, climate, soil, autoenc or all")
    if encoder is None:
        raise ValueError(f"mode {mode} needs the encoder table")
    joined = samples.join(encoder.select(*on, F.col("encoded").alias("_e")), list(on))
    code = F.col("_e") if n_encoded is None else F.slice(F.col("_e"), F.greatest(F.size("_e") - n_encoded + 1, F.lit(1)), F.lit(n_encoded))
    return joined.withColumn("cond", code if mode == "autoenc" else F.concat(climate, code)).drop("_e")


def encoder_windows(df: DataFrame, target: str, length: int = 180, horizon: int = 0, keys: Keys = CELL, time: str = "time") -> DataFrame:
    """Input of the encoder: the last ``length`` values of the lag channel."""
    return supervised_windows(df, [], target, length, horizon, keys=keys, time=time, lag_channel=True).select(
        *keys, "sample_id", "origin", F.transform("x", lambda c: c[0]).alias("x")
    )


def _time_rank(df: DataFrame, time: str) -> DataFrame:
    """(time, _r, _n): position of each distinct date. One row per date, so a single window is small."""
    days = df.select(time).distinct()
    ranked = days.withColumn("_r", F.row_number().over(Window.orderBy(time)))
    return ranked.withColumn("_n", days.agg(F.count(F.lit(1))).scalar())


def chronological_split(df: DataFrame, train: float = 0.7, val: float = 0.5, time: str = "time", by_ratio: bool = False) -> DataFrame:
    """Add ``split``: the first round(p N) dates train, the next round((1-p) v N) val, the rest test.

    With ``by_ratio`` ``val`` is itself a share of all dates. Halves round to even. The list of dates is broadcast.
    """
    share = val if by_ratio else (1 - train) * val
    if not 0 < train <= 1 or share < 0 or train + share > 1 + 1e-12:
        raise ValueError("invalid split shares")
    days = _time_rank(df, time)
    n_train = F.bround(F.lit(train) * F.col("_n"), 0)
    n_val = F.bround(F.lit(share) * F.col("_n"), 0)
    label = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    return df.join(F.broadcast(days.select(time, label.alias("split"))), time)


def sliding_folds(df: DataFrame, window: int, horizon: int, stride: int = 365, time: str = "time") -> DataFrame:
    """Folds (fold, train_start, train_end, test_start, test_end) in time steps, ends exclusive."""
    n = df.agg(F.count_distinct(time).alias("n"))
    fits = n.where(F.col("n") >= window + horizon)
    starts = fits.select(F.posexplode(F.sequence(F.lit(0), (F.col("n") - window - horizon).cast("int"), F.lit(stride))).alias("fold", "train_start"))
    return starts.select(
        "fold", "train_start", (F.col("train_start") + window).alias("train_end"),
        (F.col("train_start") + window).alias("test_start"), (F.col("train_start") + window + horizon).alias("test_end"),
    )


def fold_rows(df: DataFrame, window: int, horizon: int, stride: int = 365, time: str = "time") -> DataFrame:
    """Rows of every fold with ``fold`` and ``part`` (train / test).

    The folds a date belongs to follow from its position by arithmetic, so no range join is needed.
    """
    days = _time_rank(df, time).withColumn("_p", F.col("_r") - 1)
    first = F.greatest(F.ceil((F.col("_p") - (window + horizon) + 1) / F.lit(stride)), F.lit(0))
    last = F.least(F.floor(F.col("_p") / F.lit(stride)), F.floor((F.col("_n") - window - horizon) / F.lit(stride)))
    tagged = days.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    part = F.when(F.col("_p") - F.col("fold") * stride < window, "train").otherwise("test")
    return df.join(F.broadcast(tagged.select(time, F.col("fold").cast("int").alias("fold"), part.alias("part"))), time)


def batches(
    samples: DataFrame, size: int, sample: str = "sample_id", pad: bool = True, shuffle_seed: int | None = None, last: Column | None = None
) -> DataFrame:
    """Add ``position`` and ``batch_id``: every ``size`` consecutive samples form a batch.

    ``sample`` is the running number of the window's origin, shared by all cells. ``pad`` repeats the
    last sample to fill its batch; ``last`` gives its number where it is known, else it is looked up,
    which computes the samples once more. ``shuffle_seed`` permutes the numbers by a seeded hash; only
    the distinct numbers (one per date) are sorted and broadcast for it.
    """
    work = samples.withColumn("position", F.col(sample).cast("long"))
    if pad:
        if last is None:
            last = one_value(samples, F.max(sample).cast("long"))
        extra = F.pmod(-(last + 1), F.lit(size))
        copies = F.sequence(F.col("position"), F.col("position") + F.when(F.col("position") == last, extra).otherwise(F.lit(0)))
        work = work.withColumn("position", F.explode(copies))
    if shuffle_seed is not None:
        order = Window.orderBy(F.md5(F.concat_ws(":", "position", F.lit(shuffle_seed)).cast("binary")), "position")
        places = work.select("position").distinct().withColumn("_p", (F.row_number().over(order) - 1).cast("long"))
        work = work.join(F.broadcast(places), "position").withColumn("position", F.col("_p")).drop("_p")
    return work.withColumn("batch_id", F.floor(F.col("position") / F.lit(size)).cast("long"))


# --- scalers -------------------------------------------------------------------------------------------


def min_max_table(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(variable, low, high), one row per variable."""
    wide = df.agg(*[F.struct(F.lit(v).alias("variable"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high")).alias(v) for v in values])
    return wide.select(F.inline(F.array(*[F.col(v) for v in values])))


def min_max_normalise(df: DataFrame, values: Sequence[str], null_value: float | None = None, inverse_of: DataFrame | None = None) -> DataFrame:
    """Scale each variable to [0, 1] by its own range; with ``inverse_of`` restore from that table's range."""
    source = df if inverse_of is None else inverse_of
    ends = one_value(source, F.struct(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in values]))
    work = df.withColumn("_s", ends)
    for v in values:
        lo, hi = F.col("_s")[v]["lo"], F.col("_s")[v]["hi"]
        work = work.withColumn(v, min_max_scale(F.col(v), lo, hi) if inverse_of is None else min_max_restore(F.col(v), lo, hi, null_value))
    return work.drop("_s")


def standardise(df: DataFrame, values: Sequence[str], train: str | None = "split = 'train'", null_value: float | None = None, inverse_of: DataFrame | None = None) -> DataFrame:
    """z-score with the mean and population deviation of the training rows (or the way back)."""
    source = df if inverse_of is None else inverse_of
    fit = source if train is None else source.where(train)
    stats = one_value(fit, F.struct(*[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(v) for v in values]))
    work = df.withColumn("_s", stats)
    for v in values:
        m, s = F.col("_s")[v]["m"], F.col("_s")[v]["s"]
        work = work.withColumn(v, z_scale(F.col(v), m, s) if inverse_of is None else z_restore(F.col(v), m, s, null_value))
    return work.drop("_s")


def order_channels(df: DataFrame, keys: Sequence[str] = ("cell_id", "time"), first: Sequence[str] = ("total_precipitation",), last_prefix: str = "sm_") -> DataFrame:
    """Precipitation first, then reanalysis variables, soil moisture last."""
    rest = [c for c in df.columns if c not in keys and c not in first]
    soil = [c for c in rest if c.startswith(last_prefix)]
    return df.select(*keys, *[c for c in first if c in df.columns], *[c for c in rest if c not in soil], *soil)

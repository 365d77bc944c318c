"""Verification: categorical scores, masked losses, ensembles, correlations and error tables.

Metrics are callables returning an aggregate column, so any grouping can use any of them. Forecast
tables are long: one row per (model, horizon, date, cell).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drygrid.functions import calendar as cal
from drygrid.functions.special import correlation_p_value
from drygrid.functions.values import clamp, confidence_bounds, min_max_restore
from drygrid.functions.special import t_critical
from drygrid.operators.common import CELL, Keys, one_value, series
from drygrid.operators.quantiles import exact_quantiles

Metric = Callable[..., Column]


# --- losses per row -----------------------------------------------------------------------------------


def loss(name: str, pred: Column, truth: Column) -> Column:
    """Row loss: ``mse``, ``mae``, ``mape``, ``bias`` or ``rmse_elementwise`` (square root per row)."""
    error = pred - truth
    table = {
        "mse": error * error,
        "mae": F.abs(error),
        "mape": F.abs(F.try_divide(error, truth)),
        "bias": error,
        "mbe": error,
        "rmse_elementwise": F.sqrt(error * error),
    }
    if name not in table:
        raise ValueError(f"metric {name} not recognised; choose from {sorted(table)}")
    return table[name]


# --- losses over rows with missing labels --------------------------------------------------------------


def _over_known(row_loss: Column, label: Column, null_val: float | None) -> Column:
    """Sum of losses over the count of valid labels; a NULL prediction adds 0 and still counts."""
    valid = label.isNotNull() if null_val is None else (label.isNotNull() & (label != null_val))
    total = F.sum(F.when(valid, F.coalesce(row_loss, F.lit(0.0))))
    return F.try_divide(total, F.count(F.when(valid, 1)))


def masked_mse(pred: Column, label: Column, null_val: float | None = None) -> Column:
    return _over_known(loss("mse", pred, label), label, null_val)


def masked_rmse(pred: Column, label: Column, null_val: float | None = None) -> Column:
    return F.sqrt(masked_mse(pred, label, null_val))


def masked_mae(pred: Column, label: Column, null_val: float | None = None) -> Column:
    return _over_known(loss("mae", pred, label), label, null_val)


# Fixed value: added to the label before dividing.
MAPE_EPSILON = 1e-10


def masked_mape(pred: Column, label: Column, null_val: float | None = None) -> Column:
    """The denominator keeps its sign."""
    return _over_known(F.try_divide(F.abs(pred - label), label + F.lit(MAPE_EPSILON)), label, null_val)


# --- losses under a pixel mask -------------------------------------------------------------------------


def under_mask(row_loss: Column, mask: Column | None = None) -> Column:
    """Sum of loss times mask over sum of mask; NULL losses add 0 and still count."""
    weight = F.lit(1.0) if mask is None else F.coalesce(mask.cast("double"), F.lit(0.0))
    return F.try_divide(F.sum(F.coalesce(row_loss, F.lit(0.0)) * weight), F.sum(weight))


def mask_mae(pred: Column, label: Column, mask: Column | None = None) -> Column:
    return under_mask(loss("mae", pred, label), mask)


def mask_mse(pred: Column, label: Column, mask: Column | None = None) -> Column:
    return under_mask(loss("mse", pred, label), mask)


def mask_rmse(pred: Column, label: Column, mask: Column | None = None) -> Column:
    return F.sqrt(mask_mse(pred, label, mask))


def mask_mape(pred: Column, label: Column, mask: Column | None = None) -> Column:
    return under_mask(loss("mape", pred, label), mask)


def mask_mbe(pred: Column, label: Column, mask: Column | None = None) -> Column:
    return under_mask(loss("mbe", pred, label), mask)


def masked_custom(criterion: Callable[[Column, Column], Column], pred: Column, label: Column, mask: Column | None = None) -> Column:
    return under_mask(criterion(pred, label), mask)


def error_map(df: DataFrame, name: str, pred: str = "y_pred", truth: str = "y", keys: Keys = CELL) -> DataFrame:
    """Mean loss over time per cell, no mask."""
    return df.groupBy(*keys).agg(F.avg(loss(name, F.col(pred), F.col(truth))).alias(name))


def metric_table(
    df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), pred: str = "y_pred", truth: str = "y", mask: str | None = None, strict: bool = False
) -> DataFrame:
    """All metrics in one aggregate, NULL losses as 0 but counted, with the masked share of rows.

    ``rmse_elementwise`` is the mean of per-row roots; ``rmse`` is the root of the mean unless ``strict``.
    """
    p, t = F.col(pred), F.col(truth)
    m = F.col(mask) if mask else None
    aggs = []
    for name in metrics:
        if name == "rmse" and not strict:
            aggs.append(F.sqrt(under_mask(loss("mse", p, t), m)).alias(name))
        else:
            aggs.append(under_mask(loss("rmse_elementwise" if name == "rmse" else name, p, t), m).alias(name))
    if mask:
        aggs.append((1 - F.avg(F.coalesce(m.cast("double"), F.lit(0.0)))).alias("masked_share"))
    return df.groupBy(*by).agg(*aggs)


def long_results(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (by, metric)."""
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def results_by_horizon(
    df: DataFrame, metrics: Sequence[str], start=None, end=None, time: str = "valid_date", mask: str | None = None, horizons: Sequence[int] | None = None
) -> DataFrame:
    """(model, horizon, metric, value) over an inclusive date range."""
    work = df
    if horizons is not None:
        work = work.where(F.col("horizon").isin(*horizons))
    if start is not None:
        work = work.where(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        work = work.where(F.col(time) <= F.lit(end).cast("date"))
    return long_results(metric_table(work, metrics, ["model", "horizon"], mask=mask), ["model", "horizon"], metrics)


# --- categorical ---------------------------------------------------------------------------------------


def contingency(df: DataFrame, observed: str, forecast: str, by: Sequence[str] = ("time",), edge: float = 0.5) -> DataFrame:
    """2x2 counts and scores per group; values from ``edge`` to 1 are events, rows with a NULL left out."""
    o, f = F.col(observed), F.col(forecast)
    both = o.isNotNull() & f.isNotNull()
    yes_o, yes_f = o >= edge, f >= edge
    error = f.cast("double") - o.cast("double")
    counts = df.groupBy(*by).agg(
        F.count_if(both & yes_o & yes_f).alias("hits"),
        F.count_if(both & yes_o & ~yes_f).alias("misses"),
        F.count_if(both & ~yes_o & yes_f).alias("false_alarms"),
        F.count_if(both & ~yes_o & ~yes_f).alias("correct_negatives"),
        F.avg(error * error).alias("mse"),
    )
    h, m, fa, cn = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    return (
        counts.withColumn("accuracy", F.try_divide(h + cn, h + m + fa + cn))
        .withColumn("false_alarm_rate", F.try_divide(fa, cn + fa))
        .withColumn("hit_rate", F.try_divide(h, h + m))
        .withColumn("bias_score", F.try_divide(h + fa, h + m))
        .withColumn("rmse", F.sqrt("mse"))
    )


# Names of the scores in result tables.
SCORES = {
    "accuracy_m": "accuracy", "far_m": "false_alarm_rate", "pod_m": "hit_rate", "rmse_m": "rmse", "mse_m": "mse", "bias_m": "bias_score",
}


def mean_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over time of the per-time scores."""
    return table.groupBy(*by).agg(*[F.avg(source).alias(name) for name, source in SCORES.items()])


def agreement_indices(target: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Cellwise (pod, far, accuracy) of two 0/1 flags; NULLs never agree."""
    equal = F.coalesce(target == reference, F.lit(False))
    b = (F.coalesce(target == 1, F.lit(False)) & ~equal).cast("double")
    c = (F.coalesce(reference == 1, F.lit(False)) & ~equal).cast("double")
    a = equal.cast("double")
    return F.try_divide(a, a + c), F.try_divide(b, b + a), F.try_divide(2 * a, 2 * a + b + c)


def agreement(df: DataFrame, target: str, reference: str, by: Sequence[str] = CELL) -> DataFrame:
    """Mean pod, far and accuracy per group (over time by default, over everything with ``by=()``)."""
    pod, far, accuracy = agreement_indices(F.col(target), F.col(reference))
    return df.groupBy(*by).agg(F.avg(pod).alias("pod"), F.avg(far).alias("far"), F.avg(accuracy).alias("accuracy"))


# --- calendar tables -----------------------------------------------------------------------------------


def daily_error(df: DataFrame, by: Sequence[str] = (), time: str = "valid_date", pred: str = "y_pred", truth: str = "y", metric: str = "mae", mask: str | None = None) -> DataFrame:
    """Spatial MAE or RMSE of each date."""
    work = df if mask is None else df.where(F.col(mask) == 1)
    inner = F.avg(loss("mae" if metric == "mae" else "mse", F.col(pred), F.col(truth)))
    if metric not in ("mae", "rmse"):
        raise ValueError("metric must be 'mae' or 'rmse'")
    return work.groupBy(*by, time).agg((inner if metric == "mae" else F.sqrt(inner)).alias("error"))


def error_by_calendar(
    df: DataFrame, aggregate_by: str = "day", by: Sequence[str] = (), time: str = "valid_date", start=None, end=None, mask: str | None = None,
    pred: str = "y_pred", truth: str = "y",
) -> DataFrame:
    """Daily spatial MAE averaged by MM-dd or by month; months run 1..12, absent ones NULL."""
    if aggregate_by not in ("day", "month"):
        raise ValueError("aggregate_by must be 'day' or 'month'")
    work = df
    if start is not None and end is not None:
        work = work.where(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    daily = daily_error(work, by, time, pred, truth, mask=mask)
    if aggregate_by == "day":
        return daily.groupBy(*by, cal.month_day(F.col(time)).alias("time_key")).agg(F.avg("error").alias("error"))
    months = daily.groupBy(*by, F.month(time).alias("month")).agg(F.avg("error").alias("error"))
    wide = months.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("month", "error"))).alias("_m"))
    slots = wide.select(*by, "_m", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    label = F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMMM")
    return slots.select(*by, label.alias("time_key"), "month", F.try_element_at("_m", F.col("month")).alias("error"))


def error_by_year(df: DataFrame, by: Sequence[str] = ("model", "horizon"), time: str = "valid_date", metric: str = "mae", mask: str | None = None) -> DataFrame:
    daily = daily_error(df, by, time, metric=metric, mask=mask)
    return daily.groupBy(*by, F.year(time).alias("year")).agg(F.avg("error").alias("error"))


# --- distributions -------------------------------------------------------------------------------------


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50, min_count: int = 1) -> DataFrame:
    """Counts per (bin_x, bin_y), edges from the data range, last bin closed, NULL truth dropped."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = data.agg(F.struct(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))).scalar()
    work = data.withColumn("_e", ends)

    def place(v: str, lo: Column, hi: Column) -> Column:
        width = (hi - lo) / bins
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(v) - lo, width)), F.lit(0)), F.lit(bins - 1)).cast("int")

    e = F.col("_e")
    work = work.select(place("_x", e["x0"], e["x1"]).alias("bin_x"), place("_y", e["y0"], e["y1"]).alias("bin_y"))
    out = work.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_count) if min_count > 1 else out


BAND_METRICS = ("rmse", "bias", "mse", "nse")


def error_by_percentile(
    df: DataFrame, metric: str | Sequence[str] = "rmse", pred: str = "y_pred", truth: str = "y", bands: int = 10, strict: bool = False, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Scores per band of the truth's quantiles: rmse, bias (truth - prediction), mse or nse as 1/(2 - nse).

    Several metrics share one pass. The last band includes the maximum unless ``strict``. ``by`` holds
    short labels (model, horizon); each gets its own quantiles. ``bounded``: see ``exact_quantiles``.
    """
    metrics = [metric] if isinstance(metric, str) else list(metric)
    if not set(metrics) <= set(BAND_METRICS):
        raise ValueError(f"metric must be one of {BAND_METRICS}")
    by = list(by)
    data = df.where(F.col(truth).isNotNull()).select(*by, F.col(truth).alias("_r"), F.col(pred).alias("_p"))
    bounds = exact_quantiles(data, "_r", [i / bands for i in range(bands + 1)], by, "_b", bounded)
    work = data.join(F.broadcast(bounds), by) if by else data.withColumn("_b", bounds.scalar())
    band = reduce(lambda x, y: x + y, [(F.col("_b")[i] <= F.col("_r")).cast("int") for i in range(bands + 1)]) - 1
    work = work.withColumn("band", band if strict else F.least(band, F.lit(bands - 1)))
    if strict:
        work = work.where(F.col("band") < bands)
    err = F.col("_r") - F.col("_p")
    efficiency = 1 - F.try_divide(F.sum(err * err), F.var_pop("_r") * F.count("_r"))
    scores = {"rmse": F.sqrt(F.avg(err * err)), "bias": F.avg(err), "mse": F.avg(err * err), "nse": F.try_divide(F.lit(1.0), 2 - efficiency)}
    out = work.groupBy(*by, "band").agg(F.first("_b").alias("_b"), *[scores[m].alias(m) for m in metrics])
    lower = F.element_at("_b", (F.col("band") + 1).cast("int"))
    return out.select(*by, F.round(F.col("band") / bands, 6).alias("percentile"), lower.alias("lower"), *metrics)


# --- ensembles -----------------------------------------------------------------------------------------


def _members(df: DataFrame, by: Sequence[str], sample: str, keys: Keys, member_pred: str, truth: str) -> DataFrame:
    return df.groupBy(*by, sample, *keys).agg(
        F.avg(member_pred).alias("mean"), F.var_samp(member_pred).alias("var"), F.first(truth, ignorenulls=True).alias("truth")
    )


def ensemble_scores(
    df: DataFrame, by: Sequence[str] = (), sample: str = "init_date", keys: Keys = CELL, pred: str = "y_pred", truth: str = "y", mask: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """RMSE of the member mean, spread (root mean member variance, n - 1) and their ratio.

    Both are taken per sample and then averaged; masked cells drop out. ``digits`` rounds the results.
    """
    work = df if mask is None else df.where(F.col(mask) == 1)
    cells = _members(work, by, sample, keys, pred, truth)
    error = F.col("truth") - F.col("mean")
    samples = cells.groupBy(*by, sample).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.sqrt(F.avg("var")).alias("spread"))
    out = samples.groupBy(*by).agg(F.avg("rmse").alias("rmse"), F.avg("spread").alias("spread"))
    out = out.withColumn("ssr", F.try_divide(F.col("spread"), F.col("rmse")))
    if digits is not None:
        for c in ("rmse", "spread", "ssr"):
            out = out.withColumn(c, F.round(c, digits))
    return out


def ensemble_by_horizon(df: DataFrame, low: float = -1.0, high: float = 1.0, scale: tuple[float, float] | None = None, mask: str | None = None, pred: str = "y_pred") -> DataFrame:
    """Scores per horizon: members restored from the (min, max) scale, clamped, results to 4 digits."""
    member = F.col(pred)
    if scale is not None:
        member = min_max_restore(member, F.lit(float(scale[0])), F.lit(float(scale[1])))
    return ensemble_scores(df.withColumn(pred, clamp(member, low, high)), ["horizon"], pred=pred, mask=mask, digits=4)


def ensemble_interval(df: DataFrame, by: Sequence[str] = ("init_date",), member: str = "member", pred: str = "y_pred", confidence: float = 0.95, scale: tuple[float, float] | None = None) -> DataFrame:
    """Confidence bounds of the domain mean: mean per member, then mean and spread over members."""
    means = df.groupBy(*by, member).agg(F.avg(pred).alias("_m"))
    out = means.groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"), F.count("_m").alias("n"))
    if scale is not None:
        low, high = F.lit(float(scale[0])), F.lit(float(scale[1]))
        out = out.withColumn("mean", min_max_restore(F.col("mean"), low, high)).withColumn("std", F.col("std") * (high - low))
    lower, upper = confidence_bounds(F.col("mean"), F.col("std"), F.col("n"), t_critical(F.col("n"), confidence))
    return out.withColumn("lower", lower).withColumn("upper", upper)


# --- regression and correlation ------------------------------------------------------------------------


def nse(pred: Column, truth: Column) -> Column:
    """Nash-Sutcliffe efficiency over pairs."""
    both = pred.isNotNull() & truth.isNotNull()
    t = F.when(both, truth)
    error = truth - pred
    return 1 - F.try_divide(F.sum(error * error), F.var_pop(t) * F.count(t))


def bias_corrected(df: DataFrame, pred: str = "y_pred", truth: str = "y", out: str = "y_corrected", by: Sequence[str] = ()) -> DataFrame:
    """Add slope * pred + intercept of the least-squares line truth ~ pred fitted on the whole table.

    ``by`` fits one line per short label (model, horizon); the lines are broadcast, since a label has a large share of the rows.
    """
    t, p = F.col(truth), F.col(pred)
    line = F.struct(F.regr_slope(t, p).alias("slope"), F.regr_intercept(t, p).alias("intercept"))
    if by:
        work = df.join(F.broadcast(df.groupBy(*by).agg(line.alias("_l"))), list(by))
    else:
        work = df.withColumn("_l", one_value(df, line))
    return work.withColumn(out, p * F.col("_l")["slope"] + F.col("_l")["intercept"]).drop("_l")


def pearson(x: str, y: str) -> Column:
    """Pearson r; NULL when a side does not vary."""
    moving = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(moving, F.corr(x, y))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) for every pair of columns, clamped to [-1, 1], in one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.least(F.greatest(F.corr(a, b), F.lit(-1.0)), F.lit(1.0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    rows += [F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    rows += [F.struct(F.lit(a).alias("x"), F.lit(a).alias("y"), F.lit(1.0).alias("r")) for a in columns]
    return wide.select(F.inline(F.array(*rows)))


def lag_correlation(
    df: DataFrame, x: str, y: str, lead: int = 0, keys: Keys = CELL, time: str = "time", skipna: bool = False, return_p: bool = False
) -> DataFrame:
    """r between x and y ``lead`` rows later (earlier for negative lead) per series.

    Without ``skipna`` any NULL in the compared stretch makes r NULL. ``return_p`` adds the p-value.
    """
    if lead < 0:
        x, y, lead = y, x, -lead
    w = series(keys, time)
    work = df.select(*keys, F.col(x).alias("_x"), F.lead(y, lead).over(w).alias("_y"), F.row_number().over(w).alias("_i"),
                     F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    return _correlate(work.where(F.col("_i") + lead <= F.col("_n")), keys, skipna, return_p)


def _correlate(pairs: DataFrame, keys: Keys, skipna: bool, return_p: bool) -> DataFrame:
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    kept = pairs.withColumn("_u", F.when(both, F.col("_x"))).withColumn("_v", F.when(both, F.col("_y")))
    out = kept.groupBy(*keys).agg(pearson("_u", "_v").alias("r"), F.count("_u").alias("n"), F.count(F.lit(1)).alias("_rows"))
    if not skipna:
        out = out.withColumn("r", F.when(F.col("n") == F.col("_rows"), F.col("r")))
    if return_p:
        out = out.withColumn("p_value", correlation_p_value("r", F.col("n").cast("double")))
    return out.drop("_rows")


def autocorrelation(df: DataFrame, nlags: int, keys: Keys = CELL, time: str = "time", value: str = "value", skipna: bool = False) -> DataFrame:
    """(keys, lead, r) for lags 1..nlags.

    Every lag is one more ``lead`` column over the same window and one more term of the same aggregate,
    so the series are shuffled and sorted once. For all lags of long series use
    :func:`drygrid.operators.series.full_autocorrelation`.
    """
    w = series(keys, time)
    work = df.select(*keys, F.col(value).alias("_x"), F.row_number().over(w).alias("_i"),
                     F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
                     *[F.lead(value, k).over(w).alias(f"_y{k}") for k in range(1, nlags + 1)])
    aggs = []
    for k in range(1, nlags + 1):
        inside = F.col("_i") + k <= F.col("_n")
        both = inside & F.col("_x").isNotNull() & F.col(f"_y{k}").isNotNull()
        u, v = F.when(both, F.col("_x")), F.when(both, F.col(f"_y{k}"))
        r = F.when((F.min(u) < F.max(u)) & (F.min(v) < F.max(v)), F.corr(u, v))
        if not skipna:
            r = F.when(F.count(u) == F.count_if(inside), r)
        aggs.append(F.struct(F.lit(k).alias("lead"), r.alias("r")).alias(f"_r{k}"))
    out = work.groupBy(*keys).agg(*aggs)
    return out.select(*keys, F.inline(F.array(*[F.col(f"_r{k}") for k in range(1, nlags + 1)])))


def persistence_rmse(df: DataFrame, keys: Keys = CELL, time: str = "time", value: str = "value") -> DataFrame:
    """RMSE of each value against the one before it: per time step over cells, then averaged."""
    diff = F.lead(value).over(series(keys, time)) - F.col(value)
    steps = df.select(time, diff.alias("_d")).groupBy(time).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("_r"))
    return steps.agg(F.avg("_r").alias("rmse"))

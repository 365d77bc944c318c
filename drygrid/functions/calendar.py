"""Calendar keys and labels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SEASONS = ("DJF", "MAM", "JJA", "SON")


def day(time: Column) -> Column:
    return F.to_date(time)


def n_day_bin(time: Column, origin: Column, days: int) -> Column:
    """First day of the n-day bin anchored at ``origin``."""
    step = F.floor(F.datediff(time, origin) / F.lit(days)) * days
    return F.date_add(origin, step.cast("int"))


def week_end(time: Column) -> Column:
    """The Sunday closing the week of ``time``."""
    return F.next_day(F.date_sub(time, 1), "SU")


def month_start(time: Column) -> Column:
    return F.trunc(time, "MM")


def march_quarter(time: Column) -> Column:
    """First day of the quarter, quarters counted from March."""
    return F.add_months(F.trunc(F.add_months(F.trunc(time, "MM"), -2), "quarter"), 2)


def dekad(time: Column) -> Column:
    """1st, 11th or 21st of the month."""
    first = F.when(F.dayofmonth(time) <= 10, 1).when(F.dayofmonth(time) <= 20, 11).otherwise(21)
    return F.make_date(F.year(time), F.month(time), first)


def season(time: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    names = F.array(*[F.lit(s) for s in SEASONS])
    return F.element_at(names, (F.floor((F.month(time) % 12) / 3) + 1).cast("int"))


def month_day(time: Column) -> Column:
    return F.date_format(time, "MM-dd")


def day_label(time: Column) -> Column:
    return F.date_format(time, "dd-MMM")


def padded_month(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def month_name(time: Column) -> Column:
    return F.date_format(time, "MMMM")


def sinusoid(time: Column) -> list[Column]:
    """sin/cos of month and day position on the unit circle, in the order the embedding tiles them."""
    month = F.lit(2 * math.pi) * (F.month(time) - 1) / F.lit(11.0)
    dom = F.lit(2 * math.pi) * (F.dayofmonth(time) - 1) / F.lit(30.0)
    return [F.sin(month), F.cos(month), F.sin(dom), F.cos(dom)]


def sinusoid_at(time: Column, column: Column) -> Column:
    """Embedding value of a grid column: the four components repeat along the columns."""
    return F.element_at(F.array(*sinusoid(time)), (F.pmod(column, F.lit(4)) + 1).cast("int"))

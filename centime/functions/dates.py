"""Calendar helpers.

Ledger timestamps carry no zone (TIMESTAMP_NTZ); all arithmetic stays on
NTZ values so the session time zone cannot shift them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .money import col_


def ts_lit(text: str) -> Column:
    """A TIMESTAMP_NTZ literal, e.g. ``ts_lit('1998-03-15 12:00:00')``."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def date_lit(text: str) -> Column:
    return F.expr(f"DATE '{text}'")


def shift_days(ts, days) -> Column:
    """Add a whole number of days to a timestamp, keeping the time of day."""
    return col_(ts) + F.make_dt_interval(col_(days) if not isinstance(days, int) else F.lit(days))


def add_months_overflow(d, months: int) -> Column:
    """Calendar months with day overflow into the next month.

    Jan 31 + 1 month = Mar 3 (Feb has 28 days), Feb 29 + 12 months = Mar 1.
    Built as first-of-month + k months + (day - 1) days.
    """
    d = col_(d)
    return F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)


def next_recurring_date(ts, interval) -> Column:
    """Next occurrence of a recurring posting; unknown interval -> unchanged."""
    ts = col_(ts)
    iv = col_(interval)
    d = F.to_date(ts)
    new_d = (F.when(iv == "DAILY", F.date_add(d, 1))
             .when(iv == "WEEKLY", F.date_add(d, 7))
             .when(iv == "MONTHLY", add_months_overflow(d, 1))
             .when(iv == "YEARLY", add_months_overflow(d, 12))
             .otherwise(d))
    return shift_days(ts, F.datediff(new_d, d))


def month_start(ts) -> Column:
    """First day of the month at 00:00 (NTZ)."""
    return F.to_timestamp_ntz(F.trunc(F.to_date(col_(ts)), "MM").cast("string"))


def month_last_day(ts) -> Column:
    """Last day of the month at 00:00 (NTZ)."""
    return F.to_timestamp_ntz(F.last_day(F.to_date(col_(ts))).cast("string"))


def is_new_month(last, now) -> Column:
    """D3: month or year differs."""
    return F.trunc(F.to_date(col_(last)), "MM") != F.trunc(F.to_date(col_(now)), "MM")


def day_of_week(d) -> Column:
    """Monday = 0, missing -> -1."""
    return F.coalesce(F.weekday(col_(d)), F.lit(-1))


def calendar_features(d, trig_digits: int | None = None) -> list[Column]:
    """14 calendar columns, in the reference's feature order.

    ``trig_digits`` rounds the sin/cos encodings (so engines with different
    libm last bits agree)."""
    d = col_(d)

    def trig(c):
        if trig_digits is None:
            return c
        return F.round(c.cast("decimal(38,18)"), trig_digits).cast("double")

    dow = F.weekday(d)
    dom = F.dayofmonth(d)
    mon = F.month(d)
    two_pi = 2 * math.pi
    return [
        dow.alias("day_of_week"),
        dom.alias("day_of_month"),
        mon.alias("month"),
        F.quarter(d).alias("quarter"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (dom <= 5).cast("int").alias("is_month_start"),
        (dom >= 25).cast("int").alias("is_month_end"),
        trig(F.sin(two_pi * dow / 7.0)).alias("sin_dow"),
        trig(F.cos(two_pi * dow / 7.0)).alias("cos_dow"),
        trig(F.sin(two_pi * mon / 12.0)).alias("sin_month"),
        trig(F.cos(two_pi * mon / 12.0)).alias("cos_month"),
        trig(F.sin(two_pi * dom / 31.0)).alias("sin_dom"),
        trig(F.cos(two_pi * dom / 31.0)).alias("cos_dom"),
        days_to_payday(dom).alias("days_to_payday"),
    ]


def days_to_payday(dom) -> Column:
    """max(0, min(dom - 1, 30 - dom))."""
    dom = col_(dom)
    return F.greatest(F.least(dom - 1, 30 - dom), F.lit(0))


def is_payday(d, payday) -> Column:
    """Day equals payday, or payday > 28 and the date is the month's last day."""
    d = col_(d)
    p = col_(payday) if not isinstance(payday, int) else F.lit(payday)
    return (F.dayofmonth(d) == p) | ((p > 28) & (d == F.last_day(d)))


def is_night(hour) -> Column:
    """Hour >= 23 or hour <= 5."""
    h = col_(hour)
    return ((h >= 23) | (h <= 5)).cast("int")


def day_label(d) -> Column:
    """D10: 'MMM dd' chart label (no year)."""
    return F.date_format(col_(d), "MMM dd")


def day_name(d) -> Column:
    return F.date_format(col_(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(col_(d), "MMMM")

"""Month and calendar encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import as_col


def month_start(key: Column | str) -> Column:
    """'YYYY-MM' -> date of the first day."""
    return F.to_date(F.concat(as_col(key), F.lit("-01")), "yyyy-MM-dd")


def quarter_label(month_no: Column) -> Column:
    return F.concat(F.lit("Q"), (F.floor((month_no - 1) / 3) + 1).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM")


def month_year_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_angle(month_no: Column) -> Column:
    return month_no.cast("double") * (2.0 * math.pi / 12.0)


def school_peak(days: Column | str) -> Column:
    return F.when(as_col(days) >= 9, 1.0).otherwise(0.0)


def long_weekend(count: Column | str) -> Column:
    return F.when(as_col(count) >= 2, 1.0).otherwise(0.0)

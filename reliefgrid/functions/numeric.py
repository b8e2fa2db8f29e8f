"""Numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str | int | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def rnd(value: Column | str | float, digits: int = 0) -> Column:
    """Round half up on the binary value; the same form works in any SQL engine.

    NaN becomes null, as a missing number must not read as 0. Scaled numbers must lie within 64 bits, where ``floor`` ends. The value
    stands in the expression only once: roundings are nested, and a second mention would double the plan at every level.
    """
    scale = float(10**digits)
    return F.floor(known(as_col(value)) * scale + 0.5) / F.lit(scale)


def known(value: Column | str) -> Column:
    """NaN becomes null, so defaults can be applied with ``coalesce``."""
    return F.nanvl(as_col(value).cast("double"), F.lit(None).cast("double"))


def or_default(value: Column | str, default: float) -> Column:
    return F.coalesce(known(value), F.lit(float(default)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def at_least(value: Column | str, low: float) -> Column:
    """``max(low, value)`` where null and NaN count as missing."""
    return F.coalesce(F.greatest(known(value), F.lit(float(low))), F.lit(float(low)))


def share(part: Column | str, total: Column | str) -> Column:
    """part / total, null when the total is zero."""
    return as_col(part) / F.nullif(as_col(total), F.lit(0.0))


def parse_number(token: Column | str) -> Column:
    """'1,234' -> 1234, '56.1%' -> 56.1, '(7)' -> -7, anything else null; most words fail the digit test at once."""
    bare = F.trim(F.translate(as_col(token), ",%", ""))
    bracketed = bare.startswith("(") & bare.endswith(")")
    signed = F.when(bracketed, F.concat(F.lit("-"), F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    number = as_col(token).rlike("[0-9]") & signed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(number, signed.try_cast("double"))


def parse_count(token: Column | str) -> Column:
    """Digits with thousands commas -> long, anything else null."""
    bare = F.trim(F.translate(as_col(token), ",", ""))
    return F.when(bare.rlike(r"^\d{1,18}$"), bare.try_cast("bigint"))

"""Hotel and arrival reports: text lines to typed tables.

Input is a table of whole report texts (``file_name``, ``text``), one row per file, as ``sources.readers.report_texts``
gives. Every file is processed whole; lines keep their number so that the first of repeated records can be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.functions.text import (
    REPORT_MARKETS,
    REPORT_STATE_ALIASES,
    STATES,
    file_arrival_type,
    file_month,
    file_period,
    file_year,
    line_counts,
    line_numbers,
    occupancy_value,
    rejoin_split_name,
)
from reliefgrid.operators.aliases import with_first_alias
from reliefgrid.operators.ranking import keep_first

_ORDER = ["file_name", "line_no"]


SPLIT_NAME = ("NEGERI", "SEMBILAN")


def report_lines(texts: DataFrame, split_name: tuple[str, str] | None = None) -> DataFrame:
    """(file_name, year, period, line_no, line) of every line of every dated file; a name that reports break over lines is put together."""
    text = rejoin_split_name("text", *split_name) if split_name else F.col("text")
    return (
        texts.select("file_name", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .withColumns({"year": file_year("file_name"), "period": file_period("file_name")})
        .where(F.col("year").isNotNull())
    )


def _state_pairs() -> list[tuple[str, str]]:
    return [(s.upper(), s) for s in STATES]


def occupancy_rates(
    texts: DataFrame, aliases: list[tuple[str, str]] | None = None, split_name: tuple[str, str] = SPLIT_NAME
) -> DataFrame:
    lines = with_first_alias(report_lines(texts, split_name), aliases or REPORT_STATE_ALIASES, "state")
    found = lines.withColumn("_v", occupancy_value(F.col("year"), line_numbers("line")))
    rows = found.where(F.col("_v").isNotNull()).withColumn("average_occupancy_rate_pct", rnd("_v", 1))
    kept = keep_first(rows.drop("line", "_v"), ["year", "period", "state"], _ORDER)
    return kept.select(F.col("file_name").alias("source_file"), "year", "period", "state", "average_occupancy_rate_pct")


def hotel_inventory(texts: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Last whole number = rooms, the one before = hotels (null when there is only one)."""
    lines = with_first_alias(report_lines(texts), aliases or _state_pairs(), "state").withColumn("_n", line_counts("line"))
    rows = lines.where(F.size("_n") > 0).withColumns(
        {
            "hotels_count": F.try_element_at("_n", F.lit(-2)),
            "rooms_count": F.try_element_at("_n", F.lit(-1)),
        }
    )
    kept = keep_first(rows.drop("line", "_n"), ["year", "period", "state"], _ORDER)
    return kept.select(F.col("file_name").alias("source_file"), "year", "period", "state", "hotels_count", "rooms_count")


def hotel_guests(texts: DataFrame, aliases: list[tuple[str, str]] | None = None, above: int = 1000) -> DataFrame:
    """First count = domestic, second = foreign, third = total (their sum when absent)."""
    lines = with_first_alias(report_lines(texts), aliases or _state_pairs(), "state").withColumn("_n", line_counts("line", above))

    def at(i: int) -> Column:
        return F.get("_n", F.lit(i))

    rows = lines.where(F.size("_n") >= 2).withColumns(
        {"domestic_guests": at(0), "foreign_guests": at(1), "total_guests": F.coalesce(at(2), at(0) + at(1))}
    )
    kept = keep_first(rows.drop("line", "_n"), ["year", "period", "state"], _ORDER)
    return kept.select(
        F.col("file_name").alias("source_file"), "year", "period", "state", "domestic_guests", "foreign_guests", "total_guests"
    )


def arrivals(texts: DataFrame, markets: list[str] | None = None, above: int = 500) -> DataFrame:
    """First count above the bound per market line; type and month come from the file name."""
    pairs = [(m, m.title()) for m in (markets or REPORT_MARKETS)]
    lines = with_first_alias(report_lines(texts), pairs, "origin_market").withColumns(
        {
            "arrivals_count": F.get(line_counts("line", above), F.lit(0)),
            "month": file_month("file_name"),
            "arrival_type": file_arrival_type("file_name"),
        }
    )
    rows = lines.where(F.col("arrivals_count").isNotNull())
    kept = keep_first(rows.drop("line"), ["year", "month", "arrival_type", "origin_market"], _ORDER)
    return kept.select(F.col("file_name").alias("source_file"), "year", "month", "arrival_type", "origin_market", "arrivals_count")


def failed_files(texts: DataFrame) -> DataFrame:
    """Files that cannot be dated or hold no text, with the reason: kept aside, not fatal."""
    reason = F.when(file_year("file_name").isNull(), "no year in file name").when(
        F.col("text").isNull() | (F.trim("text") == ""), "no text"
    )
    return texts.select("file_name", reason.alias("reason")).where(F.col("reason").isNotNull())

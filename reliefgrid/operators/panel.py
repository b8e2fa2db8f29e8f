"""Month spines, calendar joins, holiday proximity, lags and occupancy panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.calendar import long_weekend, month_angle, month_start, quarter_label, school_peak
from reliefgrid.functions.numeric import known
from reliefgrid.functions.text import state_key
from reliefgrid.operators.rollup import DEFAULT_OCCUPANCY
from reliefgrid.session import cut_lineage

# Calendar numbers used when a month is unknown, in training and in scoring.
TRAINING_DEFAULT = (5.0, 2.0, 1.0)
SCORING_DEFAULT = (8.0, 2.0, 1.0)
CALENDAR_COLUMNS = ["cuti_sekolah_days", "public_holidays", "long_weekends"]


def month_spine(df: DataFrame, first: Column, last: Column, out: str = "month_start") -> DataFrame:
    """Repeat every row for each month between two dates."""
    return df.withColumn(out, F.explode(F.sequence(first, last, F.expr("interval 1 month"))))


def with_calendar(df: DataFrame, calendar: DataFrame, month: str = "month", any_year: bool = False) -> DataFrame:
    """Left join of the calendar by 'YYYY-MM' key.

    ``any_year`` falls back to the earliest listed year of the same month and then to the training default; without it
    the scoring default applies and the title is generic.
    """
    rows = calendar.select(F.col("month").alias(month), *CALENDAR_COLUMNS, "event_highlights")
    out = df.join(rows, month, "left")
    number = F.substring(F.col(month), 6, 2)
    if any_year:
        earliest = [F.min_by(c, "month").alias(f"_{c}") for c in CALENDAR_COLUMNS]
        same_month = calendar.groupBy(F.substring("month", 6, 2).alias("_mm")).agg(*earliest)  # at most twelve rows
        out = out.withColumn("_mm", number).join(same_month, "_mm", "left")
        filled = [
            F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(d)).cast("double").alias(c)
            for c, d in zip(CALENDAR_COLUMNS, TRAINING_DEFAULT)
        ]
    else:
        filled = [F.coalesce(F.col(c), F.lit(d)).cast("double").alias(c) for c, d in zip(CALENDAR_COLUMNS, SCORING_DEFAULT)]
    title = F.coalesce("event_highlights", F.concat(F.lit("Month "), number, F.lit(" Period"))).alias("event_title")
    return out.select(*df.columns, *filled, title)


def calendar_encodings(df: DataFrame, month_no: str = "month_no") -> DataFrame:
    angle = month_angle(F.col(month_no))
    return df.withColumns(
        {
            "quarter": quarter_label(F.col(month_no)),
            "is_school_peak": school_peak("cuti_sekolah_days"),
            "is_long_weekend": long_weekend("long_weekends"),
            "month_sin": F.sin(angle),
            "month_cos": F.cos(angle),
        }
    )


def events_listing(calendar: DataFrame) -> DataFrame:
    """Calendar rows with quarter and display label, in month order."""
    quarter = quarter_label(F.substring("month", 6, 2).cast("int"))
    return (
        calendar.withColumn("quarter", quarter)
        .withColumn("label", F.concat(F.col("month"), F.lit(" — "), F.col("event_highlights"), F.lit(" ("), F.col("quarter"), F.lit(")")))
        .orderBy("month")
    )


def holiday_proximity(months: DataFrame, holidays: DataFrame, month: str = "month", day: str = "holiday_date") -> DataFrame:
    """Days from mid-month to the next holiday and the number of holidays within 15 days.

    The forward search is a window over distinct calendar days (bounded by the length of the calendar, whatever the
    number of rows); the count is an equi-join, since a holiday can only touch the mid-months next to it.
    """
    mid = F.date_add(month_start(month), 14)
    keys = months.select(month).distinct().withColumn("_day", mid)
    days = holidays.where(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_day", "_is_month").rowsBetween(0, Window.unboundedFollowing)
    line = keys.select(month, "_day", F.lit(1).alias("_is_month"), F.lit(None).cast("date").alias("_holiday")).unionByName(
        days.select(F.lit(None).cast("string").alias(month), "_day", F.lit(2).alias("_is_month"), F.col("_day").alias("_holiday"))
    )
    upcoming = line.withColumn("_next", F.first("_holiday", ignorenulls=True).over(ahead)).where(F.col(month).isNotNull())
    touched = days.withColumn("_m", F.explode(F.array(*[F.add_months(F.trunc("_day", "month"), k) for k in (-1, 0, 1)])))
    touched = touched.withColumn("_gap", F.abs(F.datediff(F.col("_day"), F.date_add("_m", 14)))).where(F.col("_gap") <= 15)
    near = touched.groupBy(F.date_format("_m", "yyyy-MM").alias(month)).agg(F.sum("_n").alias("_near"))
    wait = F.coalesce(F.datediff("_next", "_day"), F.lit(365))
    features = upcoming.join(near, month, "left").select(
        month,
        wait.alias("days_to_next"),
        (1.0 / (wait + 1.0)).alias("min_inv"),
        F.exp(-wait / 30.0).alias("min_exp"),
        F.coalesce(F.col("_near"), F.lit(0)).cast("double").alias("near_count"),
    )
    return months.join(features, month)


def occupancy_panel(rates: DataFrame, months: DataFrame, value: str = "average_occupancy_rate_pct") -> DataFrame:
    """(state_key, month_start, aor) for every state and month of the calendar.

    Quarter value, else annual value, else the state mean, else the national mean (47.5 without data). ``months`` has
    a ``month`` column of "YYYY-MM" keys. Of repeated source rows the highest rate counts.
    """
    clean = rates.select(state_key("state").alias("state_key"), "year", "period", known(value).alias("aor"))
    # state x year x period: small, and read four times below
    one = cut_lineage(clean.groupBy("state_key", "year", "period").agg(F.max("aor").alias("aor")))
    national = F.coalesce(one.agg(F.avg("aor")).scalar(), F.lit(DEFAULT_OCCUPANCY))
    calendar = months.select(month_start("month").alias("month_start")).distinct()
    # the calendar is a list of months, so it travels as one array
    listed = calendar.agg(F.array_sort(F.collect_list("month_start"))).scalar()
    states = one.groupBy("state_key").agg(F.avg("aor").alias("state_mean"))
    spine = states.withColumn("month_start", F.explode(listed)).withColumns(
        {"year": F.year("month_start"), "period": F.concat(F.lit("Q"), F.quarter("month_start").cast("string"))}
    )
    quarter = one.where("period <> 'Annual'").withColumnRenamed("aor", "quarter_aor")
    annual = one.where("period = 'Annual'").select("state_key", "year", F.col("aor").alias("annual_aor"))
    return (
        spine.join(quarter, ["state_key", "year", "period"], "left")
        .join(annual, ["state_key", "year"], "left")
        .select(
            "state_key", "month_start",
            F.coalesce("quarter_aor", "annual_aor", "state_mean", national).alias("aor"),
        )
    )


def lag_features(
    rows: DataFrame, panel: DataFrame, default: Column, state: str = "state_name", month: str = "month"
) -> DataFrame:
    """Panel value of the month before and the mean of the three months before; unknown months take ``default``.

    Each panel month is sent forward to the three months it serves, so this is one equi-join and one aggregate.
    """
    keys = rows.select(state, month).distinct().withColumns({"_key": state_key(state), "_month": month_start(month)})
    sent = panel.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        F.col("state_key").alias("_key"), F.add_months("month_start", F.col("_k")).alias("_month"), "_k", "aor"
    )

    def lag(k: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_k") == k, F.col("aor"))), default)

    lagged = keys.join(sent, ["_key", "_month"], "left").groupBy(state, month).agg(
        lag(1).alias("aor_t1"), ((lag(1) + lag(2) + lag(3)) / 3.0).alias("aor_ma3")
    )
    return rows.join(lagged, [state, month])

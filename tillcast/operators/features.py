"""Leak-free feature table: context, cyclical encodings, holiday distance, lags, rolling statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.columns import flag, zero_if_null
from tillcast.functions.spine import dense_spine
from tillcast.operators.rollups import DAY, daily_events, daily_promotions
from tillcast.operators.summary import SUMMARY_COLUMNS

TARGET = "target_sales_cents"
FAR = 99  # "no holiday in sight", and "no event near"

# Outcomes known only after the day is over; none of them may be an input.
SAME_DAY_OUTCOMES = tuple(c for c in SUMMARY_COLUMNS if c not in DAY)
KEYS_AND_TARGETS = (
    "business_date", "location_id", "is_future", TARGET, "target_orders", "target_customers", "split",
)
BINARY_PREFIXES = ("is_", "has_", "promotion_active")

# Columns taken from each source table.
SUMMARY_INPUTS = (
    "is_closed", "order_count", "net_sales_cents", "customer_count", "avg_ticket_cents", "item_count",
    "labor_hours",
)
CALENDAR_INPUTS = (
    "day_of_week", "month", "day_of_month", "day_of_year", "week_of_year", "quarter",
    "is_weekend", "is_weekend_night", "is_holiday", "is_holiday_eve",
    "is_day_after_holiday", "is_observance", "is_school_break", "is_month_start",
    "is_month_end", "is_payday_window",
)
WEATHER_INPUTS = (
    "temp_max_f", "temp_min_f", "temp_mean_f", "feels_like_max_f",
    "precipitation_in", "snowfall_in", "precipitation_hours", "wind_max_mph",
    "humidity_mean", "is_rainy", "is_snowy", "is_stormy",
)
CYCLES = {"dow": ("day_of_week", 7), "month": ("month", 12), "doy": ("day_of_year", 365.25)}
SALES_LAGS = (1, 2, 3, 7, 14, 28)


class LeakageError(RuntimeError):
    """Inputs and outcomes overlap."""


def feature_source(
    tables: Mapping[str, DataFrame], summary: DataFrame, horizon_days: int = 14
) -> DataFrame:
    """Calendar x trading locations from the first summary date to ``horizon_days`` past the last, with
    the day's summary and context. Rows without a summary are the future."""
    bounds = summary.agg(F.min("business_date").alias("first"), F.max("business_date").alias("last"))
    trading = tables["locations"].join(
        tables["orders"]
        .where((F.col("state") != "CANCELED") & (F.col("net_sales_cents") > 0))
        .select("location_id")
        .distinct(),
        "location_id", "left_semi",
    )
    calendar = tables["calendar_days"]
    rows = dense_spine(
        calendar, trading,
        bounds.select("first").scalar(), F.date_add(bounds.select("last").scalar(), horizon_days),
    )
    joined = (
        rows.join(summary.select(*DAY, *SUMMARY_INPUTS), DAY, "left")
        .join(calendar.select(F.col("date").alias("business_date"), *CALENDAR_INPUTS), "business_date")
        .join(
            tables["weather"].select(F.col("date").alias("business_date"), *WEATHER_INPUTS),
            "business_date", "left",
        )
        .join(daily_events(tables["events"]).withColumnRenamed("date", "business_date"), "business_date", "left")
        .join(
            daily_promotions(tables["promotions"]).withColumnRenamed("date", "business_date"),
            "business_date", "left",
        )
    )
    return joined.select(
        *DAY,
        F.coalesce("is_closed", F.lit(0)).alias("is_closed"),
        *[c for c in SUMMARY_INPUTS if c != "is_closed"],
        *CALENDAR_INPUTS, *WEATHER_INPUTS,
        zero_if_null("event_count"), zero_if_null("event_attendance"), zero_if_null("sports_events"),
        F.coalesce("nearest_event_miles", F.lit(float(FAR))).alias("nearest_event_miles"),
        zero_if_null("promotion_count"), zero_if_null("promotion_spend_usd", "double"),
        zero_if_null("max_percent_off", "double"),
        zero_if_null("has_facebook_ads", "int"), zero_if_null("has_delivery_promo", "int"),
        flag(F.col("net_sales_cents").isNull()).alias("is_future"),
        F.col("net_sales_cents").alias(TARGET),
        F.col("order_count").alias("target_orders"),
        F.col("customer_count").alias("target_customers"),
    )


def cyclical_features(rows: DataFrame) -> DataFrame:
    """Points on a circle, so that Sunday sits beside Monday and December beside January."""
    added = {}
    for name, (column, period) in CYCLES.items():
        angle = F.lit(2 * math.pi) * F.col(column) / F.lit(period)
        added[f"{name}_sin"] = F.sin(angle)
        added[f"{name}_cos"] = F.cos(angle)
    return rows.withColumns(added)


def holiday_offsets(rows: DataFrame) -> DataFrame:
    """(business_date, days_to_holiday, days_since_holiday) for dates less than 99 days from a holiday.

    Distances stop mattering at 99, so every holiday is spread over the 98 days on either side and the
    nearest one per date is kept: an aggregation on the date, with no ordering over all rows.
    """
    holidays = rows.where(F.col("is_holiday") == 1).select(F.col("business_date").alias("h")).distinct()
    reach = F.sequence(F.lit(1 - FAR), F.lit(FAR - 1))
    near = holidays.select("h", F.explode(reach).alias("k")).select(
        F.date_add("h", F.col("k")).alias("business_date"), "k"
    )
    return near.groupBy("business_date").agg(
        F.min(F.when(F.col("k") <= 0, -F.col("k"))).alias("days_to_holiday"),
        F.min(F.when(F.col("k") > 0, F.col("k"))).alias("days_since_holiday"),
    )


def holiday_distance(rows: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Days to the next holiday (0 on one) and since the last one before the day; 99 at most.

    Only holidays inside the frame count. ``dates`` may name a cheaper relation with the same
    (business_date, is_holiday) pairs as ``rows``.
    """
    near = holiday_offsets(rows if dates is None else dates)
    return rows.join(near, "business_date", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(FAR)).cast("int") for c in ("days_to_holiday", "days_since_holiday")}
    )


def _past() -> Window:
    return Window.partitionBy("location_id").orderBy("business_date")


def _full(column: str, n: int, stat: Column, least: int | None = None) -> Column:
    """A statistic over the previous ``n`` rows, null unless enough of them have a value."""
    frame = _past().rowsBetween(-n, -1)
    return F.when(F.count(column).over(frame) >= (least or n), stat.over(frame))


def lag_columns() -> dict[str, Column]:
    w = _past()
    lags = {f"sales_lag_{n}": F.lag(TARGET, n).over(w) for n in SALES_LAGS}
    for name, source, steps in (
        ("orders", "target_orders", (1, 7)),
        ("customers", "target_customers", (1, 7)),
        ("avg_ticket", "avg_ticket_cents", (7,)),
        ("labor_hours", "labor_hours", (7,)),
    ):
        lags |= {f"{name}_lag_{n}": F.lag(source, n).over(w) for n in steps}
    return lags


def rolling_columns() -> dict[str, Column]:
    return {
        "sales_roll_mean_7": _full(TARGET, 7, F.avg(TARGET)),
        "sales_roll_mean_28": _full(TARGET, 28, F.avg(TARGET)),
        "sales_roll_std_7": _full(TARGET, 7, F.stddev_samp(TARGET)),
        "sales_roll_max_7": _full(TARGET, 7, F.max(TARGET)),
    }


def history_features(rows: DataFrame) -> DataFrame:
    """Lags, rolling statistics and the temperature norm in one window pass: one shuffle and one sort
    by location. The spine gives every location the same number of rows, so no partition is hot."""
    passed = rows.select(
        "*",
        *[c.alias(name) for name, c in (lag_columns() | rolling_columns()).items()],
        _full("temp_max_f", 30, F.avg("temp_max_f"), least=10).alias("__temp_normal"),
    )
    same_dow = (F.col("sales_lag_7") + F.col("sales_lag_14") + F.col("sales_lag_28")) / F.lit(3.0)
    momentum = F.try_divide(
        F.col("sales_roll_mean_7"), F.nullif(F.col("sales_roll_mean_28"), F.lit(0.0))
    )
    return passed.withColumns(
        {"same_dow_mean_4": same_dow, "momentum_7_28": F.coalesce(momentum, F.lit(1.0))}
    )


def interaction_features(rows: DataFrame, first_date: Column) -> DataFrame:
    """Crosses of weather, promotions and weekends, temperature against its norm, and a trend counter.

    ``first_date`` is the first date of the frame; it may be a scalar subquery.
    """
    active = flag(F.col("promotion_count") > 0)
    return (
        rows.withColumn("__first", first_date)
        .withColumns(
            {
                "rain_x_weekend": F.coalesce("is_rainy", F.lit(0)) * F.col("is_weekend"),
                "promotion_active": active,
                "promo_x_weekend": active * F.col("is_weekend"),
                "temp_vs_normal_f": F.coalesce(F.col("temp_max_f") - F.col("__temp_normal"), F.lit(0.0)),
                "days_since_start": F.datediff("business_date", "__first"),
            }
        )
        .drop("__first", "__temp_normal")
    )


def feature_columns(columns: list[str]) -> list[str]:
    """Legitimate inputs, in stable order."""
    banned = {*SAME_DAY_OUTCOMES, *KEYS_AND_TARGETS}
    return [c for c in columns if c not in banned]


def assert_no_leakage(columns: list[str]) -> None:
    if leaked := [c for c in columns if c in SAME_DAY_OUTCOMES]:
        raise LeakageError(f"inputs known only after the day has closed: {', '.join(leaked)}")


def engineered(tables: Mapping[str, DataFrame], summary: DataFrame, horizon_days: int = 14) -> DataFrame:
    """Every feature column, before incomplete rows are dropped."""
    source = feature_source(tables, summary, horizon_days)
    bounds = summary.agg(F.min("business_date").alias("first"), F.max("business_date").alias("last"))
    first = bounds.select("first").scalar()
    # The frame holds every calendar date of its range, so its holidays can be read from the calendar.
    dates = (
        tables["calendar_days"]
        .select(F.col("date").alias("business_date"), "is_holiday")
        .withColumns({"__a": first, "__b": F.date_add(bounds.select("last").scalar(), horizon_days)})
        .where(F.col("business_date").between(F.col("__a"), F.col("__b")))
    )
    rows = holiday_distance(cyclical_features(source), dates)
    return interaction_features(history_features(rows), first)


def complete_rows(rows: DataFrame) -> DataFrame:
    """Rows that have a value in every feature column; the warm-up days of a location have none in its lags."""
    columns = feature_columns(rows.columns)
    assert_no_leakage(columns)
    return rows.dropna(subset=columns)

"""Date dimensions: calendar, holidays, school breaks, local events, promotions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.columns import flag

# Observances that move trade although they are not days off.
OBSERVANCES = {
    (2, 14): "Valentines Day",
    (3, 17): "St Patricks Day",
    (5, 5): "Cinco de Mayo",
    (10, 31): "Halloween",
    (12, 24): "Christmas Eve",
    (12, 31): "New Years Eve",
}


def date_span(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One-row (first, last)."""
    return spark.range(1).select(
        F.lit(str(start)).cast("date").alias("first"), F.lit(str(end)).cast("date").alias("last")
    )


def _dates(span: DataFrame) -> DataFrame:
    """One row per date of a (first, last) row; a reversed span gives none."""
    return span.where(F.col("first") <= F.col("last")).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date")
    )


def school_breaks(school_terms: DataFrame) -> DataFrame:
    """(date, school_break): the first term, in list order, that covers the date.

    Terms are spread to days first, which makes the interval join an equality join.
    """
    days = school_terms.where(F.col("start_date") <= F.col("end_date")).select(
        F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date"),
        "label", "ordinal",
    )
    return days.groupBy("date").agg(F.min_by("label", "ordinal").alias("school_break"))


def calendar_days(span: DataFrame, holidays: DataFrame, school_terms: DataFrame) -> DataFrame:
    """One row per date of ``span`` (first, last) with weekday, holiday, observance, school and payday
    context. ``holidays`` is (date, name); ``school_terms`` is (label, start_date, end_date, ordinal)."""
    d = F.col("date")
    dow = (F.weekday(d) + 1).cast("int")
    observance = F.coalesce(*[
        F.when((F.month(d) == month) & (F.dayofmonth(d) == day), name)
        for (month, day), name in OBSERVANCES.items()
    ])
    named = holidays.groupBy("date").agg(F.min("name").alias("holiday_name"))
    eve = named.select(F.date_sub("date", 1).alias("date"), F.lit(1).alias("is_holiday_eve"))
    after = named.select(F.date_add("date", 1).alias("date"), F.lit(1).alias("is_day_after_holiday"))
    return (
        _dates(span)
        .join(named, "date", "left")
        .join(eve, "date", "left")
        .join(after, "date", "left")
        .join(school_breaks(school_terms), "date", "left")
        .select(
            "date",
            dow.alias("day_of_week"),
            F.date_format(d, "EEEE").alias("day_name"),
            F.month(d).alias("month"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.year(d).alias("year"),
            F.dayofmonth(d).alias("day_of_month"),
            F.dayofyear(d).alias("day_of_year"),
            F.weekofyear(d).alias("week_of_year"),
            F.quarter(d).alias("quarter"),
            flag(dow >= 6).alias("is_weekend"),
            flag(dow.isin(5, 6)).alias("is_weekend_night"),
            flag(F.col("holiday_name").isNotNull()).alias("is_holiday"),
            "holiday_name",
            F.coalesce("is_holiday_eve", F.lit(0)).alias("is_holiday_eve"),
            F.coalesce("is_day_after_holiday", F.lit(0)).alias("is_day_after_holiday"),
            observance.alias("observance"),
            flag(observance.isNotNull()).alias("is_observance"),
            "school_break",
            flag(F.col("school_break").isNotNull()).alias("is_school_break"),
            flag(F.dayofmonth(d) == 1).alias("is_month_start"),
            flag(F.last_day(d) == d).alias("is_month_end"),
            flag(F.dayofmonth(d).isin(1, 2, 15, 16)).alias("is_payday_window"),
        )
    )


def _each_day(df: DataFrame, first: Column, last: Column, *columns: Column | str) -> DataFrame:
    """A row per day that a (start_date, end_date) record is live inside [first, last].

    A missing end is the start itself; a missing start drops the record.
    """
    ends = F.coalesce("end_date", "start_date")
    clipped = (
        df.where(F.col("start_date").isNotNull())
        .withColumns({"__from": F.greatest(F.col("start_date"), first), "__to": F.least(ends, last)})
        .where(F.col("__from") <= F.col("__to"))
    )
    return clipped.withColumn(
        "date", F.explode(F.sequence("__from", "__to", F.expr("interval 1 day")))
    ).select("date", *columns)


def _day_index() -> Column:
    return F.datediff("date", "start_date").alias("day_index")


def expand_events(events: DataFrame, first: Column, last: Column) -> DataFrame:
    spans_days = flag(F.coalesce("end_date", "start_date") != F.col("start_date"))
    return _each_day(
        events, first, last,
        "name", "category", "venue", "distance_miles", "expected_attendance", "start_time",
        spans_days.alias("is_multi_day"), _day_index(), "notes",
    )


def expand_promotions(promotions: DataFrame, first: Column, last: Column) -> DataFrame:
    return _each_day(
        promotions, first, last,
        "name", "channel", "discount_type", "discount_value", "spend_usd", "applies_to", _day_index(), "notes",
    )

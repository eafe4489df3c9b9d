"""Dense location x date spine without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.session import default_parallelism


def dense_spine(calendar: DataFrame, locations: DataFrame, first: Column, last: Column) -> DataFrame:
    """(business_date, location_id) for every calendar date in [first, last] and every location.

    Each location unrolls its own dates, so the rows are produced by as many tasks as there are
    partitions of locations, and the join with the calendar only drops dates the calendar lacks.
    ``first`` and ``last`` may be scalar subqueries.
    """
    tasks = default_parallelism(locations.sparkSession)
    bounded = (
        locations.select("location_id")
        .repartition(tasks, "location_id")
        .withColumns({"__first": first, "__last": last})
        .where(F.col("__first") <= F.col("__last"))
    )
    dates = F.sequence("__first", "__last", F.expr("interval 1 day"))
    days = bounded.select(F.explode(dates).alias("business_date"), "location_id")
    return days.join(calendar.select(F.col("date").alias("business_date")), "business_date", "left_semi")

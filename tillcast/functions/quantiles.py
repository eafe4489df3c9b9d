"""Exact quantiles without gathering all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.ranks import with_rows_before


def exact_quantiles(values: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """Quantiles with linear interpolation between order statistics: one row (n, q0, q1, ..), nulls without values.

    Equal values are counted first, so a value that fills a third of the table is one row. The different values
    get their ranks range by range, and one aggregation picks the two values around every wanted rank. Nothing is
    evaluated before the result is.
    """
    known = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    counted = known.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    ranked = with_rows_before(counted, "v", count="k").withColumn("total", known.agg(F.count(F.lit(1))).scalar())

    def at(slot: Column) -> Column:
        """The value whose rows cover the rank ``slot``, from 0."""
        return F.max(F.when((F.col("before") <= slot) & (slot < F.col("before") + F.col("k")), F.col("v")))

    picked = []
    for i, q in enumerate(qs):
        low = F.floor(F.lit(q) * (F.col("total") - 1))
        picked += [at(low).alias(f"a{i}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"b{i}")]
    found = ranked.agg(F.coalesce(F.max("total"), F.lit(0)).cast("bigint").alias("n"), *picked)

    def between(i: int, q: float) -> Column:
        position = F.lit(q) * (F.col("n") - 1)
        return F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (position - F.floor(position))

    return found.select("n", *[between(i, q).alias(f"q{i}") for i, q in enumerate(qs)])

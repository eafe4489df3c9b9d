"""Exact ranks over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import default_parallelism

ACCURACY = 10_000


def with_rows_before(
    rows: DataFrame, lead: str, then: list[Column] = (), count: str | None = None, out: str = "before",
    descending: bool = False,
) -> DataFrame:
    """``rows`` with ``out``, the number of rows that come before each (the sum of ``count``, if given).

    Rows are ordered by the numeric column ``lead``, nulls last, then by ``then``. A bounded sketch of ``lead`` cuts the
    table into ranges of about equal numbers of rows; the counts of the ranges before a row's own are its offset, and
    the running count inside its range is added. A task sees one range, and all that is put in order as a whole is one
    number per range. The sketch only deals the rows: the ranks are exact wherever its edges lie.

    Rows equal in ``lead`` share a range. A caller whose values repeat without bound groups them first and passes
    their number in ``count``. An empty table stays empty.
    """
    ranges = default_parallelism(rows.sparkSession)
    place = -F.col(lead).cast("double") if descending else F.col(lead).cast("double")
    cuts = F.array(*[F.lit((i + 1) / ranges) for i in range(max(1, ranges - 1))])
    edges = rows.agg(F.percentile_approx(place, cuts, F.lit(ACCURACY))).scalar()
    # Nulls are behind the last edge.
    number = F.when(F.col("__place").isNull(), F.lit(ranges)).otherwise(
        F.size(F.filter(F.coalesce("__edges", F.array()), lambda e: e < F.col("__place")))
    )
    dealt = rows.withColumns({"__place": place, "__edges": edges}).withColumn("__range", number).drop("__edges")
    weight = F.lit(1).cast("bigint") if count is None else F.col(count).cast("bigint")
    listed = dealt.groupBy("__range").agg(F.sum(weight).alias("__n")).agg(
        F.collect_list(F.struct("__range", "__n"))
    ).scalar()
    offset = F.aggregate(
        F.filter("__sizes", lambda x: x["__range"] < F.col("__range")), F.lit(0).cast("bigint"), lambda s, x: s + x["__n"]
    )
    inside = Window.partitionBy("__range").orderBy(F.col("__place").asc_nulls_last(), *then)
    earlier = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    placed = dealt.withColumn("__before", earlier).withColumn("__sizes", listed)
    return placed.select(*rows.columns, (F.col("__before") + offset).alias(out))

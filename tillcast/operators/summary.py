"""daily_summary: one dense row per calendar date and location."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import count_if, flag, ratio_or_zero, sum_if, zero_if_null
from tillcast.functions.spine import dense_spine
from tillcast.operators.rollups import (
    DAY,
    daily_labor,
    daily_payments,
    daily_refunds,
    is_sale,
    order_sums,
)

# Local-hour bounds of the dayparts. Late is everything outside lunch and dinner.
LUNCH = (11, 16)
DINNER = (16, 22)

# Names of the summary's columns.
SUMMARY_COLUMNS = (
    "business_date", "location_id", "is_closed", "order_count", "revenue_cents",
    "net_sales_cents", "discount_cents", "tax_cents", "tip_cents", "service_charge_cents",
    "avg_ticket_cents", "item_count", "distinct_items", "customer_count",
    "new_customer_count", "returning_customer_count", "lunch_orders", "dinner_orders",
    "late_orders", "lunch_sales_cents", "dinner_sales_cents", "late_sales_cents",
    "peak_hour", "pickup_orders", "delivery_orders", "dine_in_orders", "cash_cents",
    "card_cents", "gift_card_cents", "processing_fee_cents", "refund_count",
    "refund_cents", "refund_rate_bps", "labor_hours", "labor_cost_cents", "staff_count",
    "sales_per_labor_hour_cents", "labor_cost_ratio_bps",
)


def _from(since: date | str | None) -> Column:
    return F.lit(True) if since is None else F.col("business_date") >= F.lit(str(since)).cast("date")


def daily_spine(
    calendar: DataFrame, locations: DataFrame, orders: DataFrame, since: date | str | None = None,
    last: date | None = None,
) -> DataFrame:
    """Every calendar date from ``since`` to the last dated order (canceled ones too), per location. Where ``last``
    is known the orders are not read for it."""
    first = calendar.agg(F.min("date")).scalar()
    if since is not None:
        first = F.greatest(first, F.lit(str(since)).cast("date"))
    end = orders.agg(F.max("business_date")).scalar() if last is None else F.lit(last)
    return dense_spine(calendar, locations, first, end)


def customer_first_seen(orders: DataFrame) -> DataFrame:
    """Each customer's first sale date, over all locations and all history."""
    return (
        orders.where(is_sale() & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.min("business_date").alias("first_date"))
    )


def new_vs_returning(
    orders: DataFrame, since: date | str | None = None, first_seen: DataFrame | None = None
) -> DataFrame:
    """Distinct customers per day and location, split by whether the day is their first.

    Visits are reduced to one row per (date, location, customer) and matched to the first visit on
    customer and date together: a customer with a third of all orders is spread over its dates.
    ``first_seen`` may be passed when it is kept as a table.
    """
    first = customer_first_seen(orders) if first_seen is None else first_seen
    visits = (
        orders.where(is_sale() & _from(since) & F.col("customer_id").isNotNull())
        .select(*DAY, "customer_id")
        .distinct()
    )
    debut = first.select(
        "customer_id", F.col("first_date").alias("business_date"), F.lit(1).alias("is_new")
    )
    counted = visits.join(debut, ["customer_id", "business_date"], "left").groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("customer_count"), F.count("is_new").alias("new_customer_count")
    )
    return counted.withColumn(
        "returning_customer_count", F.col("customer_count") - F.col("new_customer_count")
    )


def _daypart_sums() -> list[Column]:
    hour = "business_hour"
    parts = {
        "lunch": f"{hour} >= {LUNCH[0]} and {hour} < {LUNCH[1]}",
        "dinner": f"{hour} >= {DINNER[0]} and {hour} < {DINNER[1]}",
        "late": f"{hour} >= {DINNER[1]} or {hour} < {LUNCH[0]}",
    }
    return [
        *[count_if(inside, f"{name}_orders") for name, inside in parts.items()],
        *[sum_if(inside, "net_sales_cents", f"{name}_sales_cents") for name, inside in parts.items()],
    ]


def dayparts(orders: DataFrame, since: date | str | None = None) -> DataFrame:
    return orders.where(is_sale() & _from(since)).groupBy(*DAY).agg(*_daypart_sums())


def _hour_counts() -> Column:
    """Order counts of the 24 local hours, as an array; the busiest is read from it without another
    grouping."""
    return F.expr(f"array({', '.join(f'count_if(business_hour = {h})' for h in range(24))})")


def _busiest(counts: Column) -> Column:
    """First hour with the highest count; null when no order has an hour."""
    top = F.array_max(counts)
    return F.when(top > 0, (F.array_position(counts, top) - 1).cast("int"))


def peak_hour(orders: DataFrame) -> DataFrame:
    """Busiest local hour per day and location, the earlier one on a tie."""
    hours = orders.where(is_sale() & F.col("business_hour").isNotNull())
    return (
        hours.groupBy(*DAY)
        .agg(_hour_counts().alias("__counts"))
        .select(*DAY, _busiest(F.col("__counts")).alias("peak_hour"))
    )


def distinct_items(items: DataFrame) -> DataFrame:
    """Distinct item names sold; items of canceled orders are included."""
    return (
        items.where(F.col("business_date").isNotNull())
        .groupBy(*DAY)
        .agg(F.countDistinct("item_name").alias("distinct_items"))
    )


def order_rollup(orders: DataFrame, since: date | str | None = None) -> DataFrame:
    """Additive measures, dayparts and peak hour in one aggregation: one partial row per task, day and
    location crosses the shuffle."""
    return (
        orders.where(is_sale() & _from(since))
        .groupBy(*DAY)
        .agg(*order_sums(), *_daypart_sums(), _hour_counts().alias("__counts"))
        .withColumn("peak_hour", _busiest(F.col("__counts")))
        .drop("__counts")
    )


def with_ratios(summary: DataFrame) -> DataFrame:
    """Operating ratios as integers, truncated toward zero, zero when the denominator is exactly zero."""
    net = F.col("net_sales_cents")
    return summary.withColumns(
        {
            "sales_per_labor_hour_cents": ratio_or_zero(net, F.col("labor_hours")),
            "labor_cost_ratio_bps": ratio_or_zero(F.col("labor_cost_cents"), net, 10_000),
            "refund_rate_bps": ratio_or_zero(F.col("refund_cents"), net, 10_000),
        }
    )


def daily_summary(
    tables: Mapping[str, DataFrame], since: date | str | None = None, first_seen: DataFrame | None = None,
    last: date | None = None,
) -> DataFrame:
    """Spine left-joined with every rollup; ``first_seen`` and ``last`` may be passed where they are kept.

    Every rollup and the spine are hash-partitioned by (business_date, location_id), so the joins add
    no shuffle beyond the one each aggregation needs.
    """
    orders = tables["orders"]
    keep = _from(since)
    joined = daily_spine(tables["calendar_days"], tables["locations"], orders, since, last)
    for part in (
        order_rollup(orders, since).withColumn("__open", F.lit(1)),
        new_vs_returning(orders, since, first_seen),
        distinct_items(tables["order_items"].where(keep)),
        daily_payments(tables["payments"].where(keep)),
        daily_refunds(tables["refunds"].where(keep)),
        daily_labor(tables["shifts"].where(keep)),
    ):
        joined = joined.join(part, DAY, "left")
    doubles = ("item_count", "labor_hours")
    ratios = ("sales_per_labor_hour_cents", "labor_cost_ratio_bps", "refund_rate_bps")
    as_is = (*DAY, "is_closed", "peak_hour", *ratios)
    filled = joined.select(
        *DAY,
        flag(F.col("__open").isNull()).alias("is_closed"),
        "peak_hour",
        *[
            zero_if_null(c, "double" if c in doubles else "bigint")
            for c in SUMMARY_COLUMNS
            if c not in as_is
        ],
    )
    return with_ratios(filled).select(*SUMMARY_COLUMNS)

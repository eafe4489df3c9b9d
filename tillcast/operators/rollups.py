"""Daily rollups: facts to one row per trading day and location, or per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import count_if, sum_if
from tillcast.functions.joins import Lookup

DAY = ["business_date", "location_id"]


def is_sale() -> Column:
    """Canceled orders were never revenue; an order of unknown state does not count either."""
    return (F.col("state") != "CANCELED") & F.col("business_date").isNotNull()


def order_sums() -> list[Column]:
    """The additive measures of a set of orders."""
    sums = ("revenue_cents", "net_sales_cents", "discount_cents", "tax_cents", "tip_cents", "service_charge_cents")
    return [
        F.expr("count(*) as order_count"),
        *[F.expr(f"sum({c}) as {c}") for c in sums],
        F.expr("sum(item_quantity) as item_count"),
        F.expr("cast(avg(revenue_cents) as bigint) as avg_ticket_cents"),
        count_if("fulfillment_type = 'PICKUP'", "pickup_orders"),
        count_if("fulfillment_type = 'DELIVERY'", "delivery_orders"),
        count_if("fulfillment_type is null", "dine_in_orders"),
    ]


def daily_sales(orders: DataFrame) -> DataFrame:
    """Sums and distinct customers of every day and location.

    They are grouped apart: a count of distinct customers beside the sums would send all the sums over the shuffle once
    for each customer of a day, here only the customer goes there. A missing location is a location of its own.
    """
    sales = orders.where(is_sale())
    known = (
        sales.where(F.col("customer_id").isNotNull()).select(*DAY, "customer_id").distinct()
        .groupBy(*[F.col(c).alias(f"__{c}") for c in DAY]).agg(F.count(F.lit(1)).alias("known_customer_count"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in DAY]
    joined = sales.groupBy(*DAY).agg(*order_sums()).join(known, same[0] & same[1], "left")
    return joined.drop(*[f"__{c}" for c in DAY]).fillna(0, ["known_customer_count"])


def daily_item_sales(items: DataFrame, variations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Demand per item and category. Items of canceled orders are included.

    Lines are summed per catalog id before the catalog is looked up, so the join sees at most one row
    per day, location, name and id whatever the popularity of an item.
    """
    summed = (
        items.where(F.col("business_date").isNotNull())
        .groupBy(*DAY, "item_name", "catalog_object_id")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("total_cents").alias("revenue_cents"),
            F.count(F.lit(1)).alias("times_ordered"),
        )
    )
    categories = (
        variations.select(F.col("variation_id"), "catalog_object_id")
        .join(catalog.select("catalog_object_id", "category_name"), "catalog_object_id", "left")
        .select(F.col("variation_id").alias("catalog_object_id"), "category_name")
    )
    return (
        Lookup(categories, ["catalog_object_id"])
        .attach(summed)
        .groupBy(*DAY, "item_name", "category_name")
        .agg(*[F.sum(c).alias(c) for c in ("quantity", "revenue_cents", "times_ordered")])
    )


def daily_labor(shifts: DataFrame) -> DataFrame:
    return (
        shifts.where(F.col("business_date").isNotNull())
        .groupBy(*DAY)
        .agg(
            F.countDistinct("team_member_id").alias("staff_count"),
            F.sum("hours").alias("labor_hours"),
            F.sum("labor_cost_cents").alias("labor_cost_cents"),
        )
    )


# Tender types and card brands with a column of their own.
SOURCE_COLUMNS = {"cash_cents": "CASH", "card_cents": "CARD", "gift_card_cents": "GIFT_CARD"}
BRAND_COLUMNS = {"visa_cents": "VISA", "mastercard_cents": "MASTERCARD", "amex_cents": "AMERICAN_EXPRESS"}


def daily_payments(payments: DataFrame) -> DataFrame:
    return (
        payments.where((F.col("status") == "COMPLETED") & F.col("business_date").isNotNull())
        .groupBy(*DAY)
        .agg(
            *[sum_if(f"source_type = '{v}'", "amount_cents", c) for c, v in SOURCE_COLUMNS.items()],
            *[sum_if(f"card_brand = '{v}'", "amount_cents", c) for c, v in BRAND_COLUMNS.items()],
            F.sum("processing_fee_cents").alias("processing_fee_cents"),
        )
    )


def daily_refunds(refunds: DataFrame) -> DataFrame:
    return (
        refunds.where(F.col("business_date").isNotNull())
        .groupBy(*DAY)
        .agg(F.count(F.lit(1)).alias("refund_count"), F.sum("amount_cents").alias("refund_cents"))
    )


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy("date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.coalesce("expected_attendance", F.lit(0).cast("bigint"))).alias("event_attendance"),
        F.min("distance_miles").alias("nearest_event_miles"),
        *[
            count_if(f"category = '{kind}'", f"{kind}_events")
            for kind in ("sports", "concert", "festival")
        ],
    )


# Promotion channels with a flag of their own.
CHANNEL_FLAGS = {
    "has_facebook_ads": "facebook_ads",
    "has_delivery_promo": "ubereats",
    "has_email_promo": "email",
    "has_in_store_promo": "in_store",
}


def daily_promotions(promotions: DataFrame) -> DataFrame:
    return promotions.groupBy("date").agg(
        F.count(F.lit(1)).alias("promotion_count"),
        F.sum(F.coalesce("spend_usd", F.lit(0.0))).alias("promotion_spend_usd"),
        F.expr("max(case when discount_type = 'percent' then discount_value else 0.0D end) as max_percent_off"),
        *[
            F.expr(f"max(case when channel = '{channel}' then 1 else 0 end) as {name}")
            for name, channel in CHANNEL_FLAGS.items()
        ],
    )

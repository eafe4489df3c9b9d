"""Nested upstream payloads to flat landing rows, as pure projections (one input row, one output row,
or one per array element)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import cents, flag, instant, number


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column), _empty("array<string>"))


def _fees(column: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(
        F.aggregate(F.col(column), zero, lambda total, fee: total + cents(fee["amount_money"])), zero
    )


def _filled(column: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(column, F.lit(""))


def normalize_orders(payloads: DataFrame) -> DataFrame:
    """One row per order. Net sales leave out tax and tip; a missing customer is taken from the first
    fulfillment that names a recipient (the pickup recipient when it names a customer, else the delivery one)."""
    recipients = F.transform(
        "fulfillments",
        lambda f: F.coalesce(
            *[_filled(f[kind]["recipient"]["customer_id"]) for kind in ("pickup_details", "delivery_details")]
        ),
    )
    lines = F.col("line_items")
    quantity = F.aggregate(
        lines, F.lit(0.0), lambda total, item: total + F.coalesce(number(item["quantity"]), F.lit(0.0))
    )
    revenue, tax, tip = (cents(F.col(f"total_{kind}money")) for kind in ("", "tax_", "tip_"))
    first = F.get("fulfillments", F.lit(0))
    return payloads.select(
        F.col("id").alias("order_id"),
        "location_id", "created_at", "updated_at", "closed_at", "state",
        F.col("total_money.currency").alias("currency"),
        revenue.alias("revenue_cents"),
        cents(F.col("total_discount_money")).alias("discount_cents"),
        tax.alias("tax_cents"),
        tip.alias("tip_cents"),
        cents(F.col("total_service_charge_money")).alias("service_charge_cents"),
        (revenue - tax - tip).alias("net_sales_cents"),
        F.col("source.name").alias("source"),
        first["type"].alias("fulfillment_type"),
        first["state"].alias("fulfillment_state"),
        F.coalesce(
            _filled(F.col("customer_id")), F.get(F.filter(recipients, lambda c: c.isNotNull()), F.lit(0))
        ).alias("customer_id"),
        F.coalesce(
            F.array_sort(
                F.array_distinct(F.filter(F.col("tenders.type"), lambda t: _filled(t).isNotNull()))
            ),
            _empty("array<string>"),
        ).alias("payment_types"),
        F.coalesce(F.size("tenders"), F.lit(0)).alias("tender_count"),
        F.coalesce(F.size(lines), F.lit(0)).alias("line_item_count"),
        F.coalesce(quantity, F.lit(0.0)).alias("item_quantity"),
        (F.coalesce(F.size("returns"), F.lit(0)) > 0).alias("has_returns"),
        "ticket_name", "version",
    )


def normalize_order_items(payloads: DataFrame) -> DataFrame:
    """One row per line item, numbered from 0, carrying its order's place and time."""
    lines = payloads.select(
        F.col("id").alias("order_id"), "location_id", "created_at",
        F.posexplode("line_items").alias("line_number", "item"),
    )
    item = F.col("item")
    modifiers = F.coalesce(
        F.transform(
            item["modifiers"],
            lambda m: F.struct(
                m["uid"].alias("uid"),
                m["catalog_object_id"].alias("catalog_object_id"),
                m["name"].alias("name"),
                cents(m["base_price_money"]).alias("price_cents"),
            ),
        ),
        _empty("array<struct<uid:string,catalog_object_id:string,name:string,price_cents:bigint>>"),
    )
    return lines.select(
        "order_id",
        item["uid"].alias("line_item_uid"),
        "line_number", "location_id", "created_at",
        item["catalog_object_id"].alias("catalog_object_id"),
        item["name"].alias("item_name"),
        item["variation_name"].alias("variation_name"),
        F.coalesce(number(item["quantity"]), F.lit(0.0)).alias("quantity"),
        item["quantity_unit"]["measurement_unit"]["type"].alias("unit"),
        cents(item["base_price_money"]).alias("base_price_cents"),
        cents(item["gross_sales_money"]).alias("gross_sales_cents"),
        cents(item["total_discount_money"]).alias("discount_cents"),
        cents(item["total_tax_money"]).alias("tax_cents"),
        cents(item["total_money"]).alias("total_cents"),
        item["item_type"].alias("item_type"),
        item["note"].alias("note"),
        modifiers.alias("modifiers"),
        F.filter(modifiers["name"], lambda n: _filled(n).isNotNull()).alias("modifier_names"),
    )


def normalize_payments(payloads: DataFrame) -> DataFrame:
    card = F.col("card_details.card")
    return payloads.select(
        F.col("id").alias("payment_id"),
        "order_id", "location_id", "customer_id", "created_at", "updated_at", "status",
        cents(F.col("amount_money")).alias("amount_cents"),
        cents(F.col("tip_money")).alias("tip_cents"),
        cents(F.col("app_fee_money")).alias("app_fee_cents"),
        cents(F.col("refunded_money")).alias("refunded_cents"),
        cents(F.col("approved_money")).alias("approved_cents"),
        F.col("amount_money.currency").alias("currency"),
        _fees("processing_fee").alias("processing_fee_cents"),
        "source_type",
        card["card_brand"].alias("card_brand"),
        card["card_type"].alias("card_type"),
        card["last_4"].alias("last_4"),
        F.col("card_details.entry_method").alias("entry_method"),
        "receipt_number", "team_member_id",
    )


def normalize_refunds(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        F.col("id").alias("refund_id"),
        "payment_id", "order_id", "location_id", "created_at", "updated_at", "status",
        cents(F.col("amount_money")).alias("amount_cents"),
        F.col("amount_money.currency").alias("currency"),
        _fees("processing_fee").alias("processing_fee_cents"),
        "reason", "destination_type", "team_member_id",
    )


def normalize_customers(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        F.col("id").alias("customer_id"),
        "created_at", "updated_at", "given_name", "family_name",
        F.col("email_address").alias("email"),
        F.col("phone_number").alias("phone"),
        "birthday", "reference_id", "company_name", "creation_source",
        _texts("group_ids").alias("group_ids"),
        _texts("segment_ids").alias("segment_ids"),
        F.col("preferences.email_unsubscribed").alias("email_unsubscribed"),
        F.col("address.postal_code").alias("postal_code"),
        "note",
    )


def normalize_catalog(objects: DataFrame) -> DataFrame:
    """ITEM objects, each with the name of its category.

    Category names come from the CATEGORY objects of the same listing; of a category listed several times the
    newest version counts, so an item stays one row. The join is left to the
    planner: it broadcasts the names when they are measured to be small.
    """
    data = F.col("item_data")
    latest = F.struct("version", "updated_at", F.col("category_data.name").alias("name"))
    names = (
        objects.where(F.col("type") == "CATEGORY")
        .groupBy(F.col("id").alias("category_id"))
        .agg(F.max(latest)["name"].alias("category_name"))
    )
    items = objects.where(F.col("type") == "ITEM").select(
        F.col("id").alias("catalog_object_id"),
        data["name"].alias("item_name"),
        F.coalesce(_filled(data["description_plaintext"]), data["description"]).alias("description"),
        F.coalesce(_filled(data["category_id"]), F.get(data["categories"], F.lit(0))["id"]).alias("category_id"),
        data["product_type"].alias("product_type"),
        F.coalesce(data["is_archived"], F.lit(False)).alias("is_archived"),
        F.coalesce(F.col("is_deleted"), F.lit(False)).alias("is_deleted"),
        "updated_at", "version",
        F.coalesce(
            F.filter(data["modifier_list_info"]["modifier_list_id"], lambda i: _filled(i).isNotNull()),
            _empty("array<string>"),
        ).alias("modifier_list_ids"),
        F.coalesce(
            F.transform(
                data["variations"],
                lambda v: F.struct(
                    v["id"].alias("id"),
                    v["item_variation_data"]["name"].alias("name"),
                    v["item_variation_data"]["sku"].alias("sku"),
                    cents(v["item_variation_data"]["price_money"]).alias("price_cents"),
                ),
            ),
            _empty("array<struct<id:string,name:string,sku:string,price_cents:bigint>>"),
        ).alias("variations"),
    )
    columns = items.columns
    columns.insert(columns.index("category_id") + 1, "category_name")
    return items.join(names, "category_id", "left").select(*columns)


def normalize_inventory(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        "catalog_object_id", "catalog_object_type", "location_id", "state",
        F.coalesce(number(F.col("quantity")), F.lit(0.0)).alias("quantity"),
        "calculated_at",
    )


def normalize_team_members(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        F.col("id").alias("team_member_id"),
        "reference_id", "status", "given_name", "family_name",
        F.coalesce(F.col("is_owner"), F.lit(False)).alias("is_owner"),
        "created_at", "updated_at",
        F.col("assigned_locations.assignment_type").alias("assignment_type"),
        _texts("assigned_locations.location_ids").alias("location_ids"),
    )


def normalize_locations(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        F.col("id").alias("location_id"),
        "name", "status", "currency",
        F.col("address.country").alias("country"),
        F.col("address.administrative_district_level_1").alias("state"),
        F.col("address.locality").alias("city"),
        F.col("address.postal_code").alias("postal_code"),
        F.col("address.address_line_1").alias("address_line_1"),
        F.col("coordinates.latitude").alias("latitude"),
        F.col("coordinates.longitude").alias("longitude"),
        "timezone", "business_name", "type", "created_at",
    )


def normalize_shifts(payloads: DataFrame) -> DataFrame:
    """Worked hours and labor cost. An open shift, or one with unreadable times, has zero hours."""
    micros = F.unix_micros(instant(F.col("end_at"))) - F.unix_micros(instant(F.col("start_at")))
    hours = F.coalesce(F.greatest(micros / F.lit(1e6) / F.lit(3600.0), F.lit(0.0)), F.lit(0.0))
    rate = cents(F.col("wage.hourly_rate"))
    return payloads.select(
        F.col("id").alias("shift_id"),
        "team_member_id", "location_id", "start_at", "end_at",
        hours.alias("hours"),
        "status",
        F.col("wage.job_id").alias("job_id"),
        F.col("wage.title").alias("job_title"),
        rate.alias("hourly_rate_cents"),
        F.bround(rate * hours).cast("bigint").alias("labor_cost_cents"),
        cents(F.col("declared_cash_tip_money")).alias("declared_tips_cents"),
        "timezone",
    )


# Landed column -> daily series of the payload.
WEATHER_SERIES = {
    "temp_max_f": "temperature_2m_max",
    "temp_min_f": "temperature_2m_min",
    "temp_mean_f": "temperature_2m_mean",
    "feels_like_max_f": "apparent_temperature_max",
    "feels_like_min_f": "apparent_temperature_min",
    "precipitation_in": "precipitation_sum",
    "rain_in": "rain_sum",
    "snowfall_in": "snowfall_sum",
    "precipitation_hours": "precipitation_hours",
    "wind_max_mph": "wind_speed_10m_max",
    "wind_gust_mph": "wind_gusts_10m_max",
    "weather_code": "weather_code",
    "sunrise": "sunrise",
    "sunset": "sunset",
}


def weather_flags(df: DataFrame) -> DataFrame:
    """is_rainy, is_snowy, is_stormy from the WMO code and the measured amounts."""
    code = F.coalesce(F.col("weather_code"), F.lit(-1))
    wet = F.coalesce(F.col("precipitation_in"), F.lit(0.0)) > 0.01
    snow = F.coalesce(F.col("snowfall_in"), F.lit(0.0)) > 0.01
    return df.withColumns(
        {
            "is_rainy": flag(wet | code.between(51, 69)),
            "is_snowy": flag(snow | code.between(71, 79)),
            "is_stormy": flag(code.between(95, 99)),
        }
    )


def daily_humidity(payloads: DataFrame) -> DataFrame:
    """Mean relative humidity per source and day from hourly readings, one decimal; null readings are
    left out."""
    readings = payloads.select(
        "source",
        F.inline(F.arrays_zip(F.col("hourly.time").alias("t"), F.col("hourly.relative_humidity_2m").alias("v"))),
    ).toDF("source", "t", "v")
    return (
        readings.where(F.col("t").isNotNull() & F.col("v").isNotNull())
        .groupBy("source", F.substring("t", 1, 10).alias("date"))
        .agg(F.bround(F.avg("v"), 1).alias("humidity_mean"))
    )


def daily_weather(payloads: DataFrame) -> DataFrame:
    """Parallel daily series to one row per day. A series shorter than the dates gives nulls."""
    names = ["date", *WEATHER_SERIES]
    zipped = F.arrays_zip(
        F.col("daily.time").alias("date"),
        # A series that is absent altogether zips as an empty one.
        *[F.expr(f"coalesce(daily.{series}, array())").alias(name) for name, series in WEATHER_SERIES.items()],
    )
    days = payloads.select("latitude", "longitude", "source", F.inline(zipped)).toDF(
        "latitude", "longitude", "source", *names
    )
    rows = days.where(F.col("date").isNotNull()).join(daily_humidity(payloads), ["source", "date"], "left")
    return weather_flags(rows)

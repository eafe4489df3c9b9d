"""Nested upstream payloads over the sample tables, as JSON lines.

Each payload is built from its own row (or, for weather, from the days of one month), so no group is
gathered whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.sources.sample import SampleShop

RFC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def stamp(column: str) -> Column:
    return F.date_format(column, RFC)


def money(amount: Column) -> Column:
    return F.struct(amount.cast("bigint").alias("amount"), F.lit("USD").alias("currency"))


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def as_lines(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.to_json(F.struct(*payloads.columns)).alias("value"))


def order_payloads(shop: SampleShop) -> DataFrame:
    """Orders with 0-3 lines, 0-3 tenders and 0-2 fulfillments. Some lack money, a customer, a quantity or
    a modifier name; recipients then name the customer."""
    k = F.col("k")
    quantity = lambda i: F.when((k + i) % 19 != 0, ((k + i) % 5 + 1).cast("string"))
    line = lambda i: F.struct(
        F.concat(F.lit("L"), i.cast("string")).alias("uid"),
        F.concat(F.lit("VAR"), ((k + i) % 200).cast("string")).alias("catalog_object_id"),
        F.concat(F.lit("Dish "), ((k + i) % 64).cast("string")).alias("name"),
        F.lit("regular").alias("variation_name"),
        quantity(i).alias("quantity"),
        money((k % 900) + i * 100).alias("base_price_money"),
        money((k % 900) * 2 + i * 100).alias("gross_sales_money"),
        F.when(i == 1, money(F.lit(25))).alias("total_discount_money"),
        money(k % 70).alias("total_tax_money"),
        money((k % 900) * 2 + i * 100 + k % 70).alias("total_money"),
        F.when(
            i % 2 == 0,
            F.array(
                F.struct(
                    F.lit("M1").alias("uid"), F.lit("MOD1").alias("catalog_object_id"),
                    F.lit("Extra spicy").alias("name"), money(F.lit(50)).alias("base_price_money"),
                ),
                F.struct(
                    F.lit("M2").alias("uid"), F.lit(None).cast("string").alias("catalog_object_id"),
                    F.lit(None).cast("string").alias("name"), money(F.lit(0)).alias("base_price_money"),
                ),
            ),
        ).alias("modifiers"),
    )
    person = lambda prefix, has: F.when(
        has, F.struct(F.struct(F.concat(F.lit(prefix), k.cast("string")).alias("customer_id")).alias("recipient"))
    )
    fulfillment = lambda i: F.struct(
        F.when((k + i) % 2 == 0, "PICKUP").otherwise("DELIVERY").alias("type"),
        F.lit("COMPLETED").alias("state"),
        person("PU", (k + i) % 3 == 0).alias("pickup_details"),
        person("DE", (k + i) % 3 == 1).alias("delivery_details"),
    )
    kinds = F.array(F.lit("CASH"), F.lit("CARD"), F.lit("GIFT_CARD"))
    return shop.orders_undated.select(
        F.col("order_id").alias("id"),
        "location_id",
        stamp("created_at").alias("created_at"),
        stamp("updated_at").alias("updated_at"),
        stamp("closed_at").alias("closed_at"),
        "state",
        F.when(k % 7 != 0, F.col("customer_id")).alias("customer_id"),
        F.when(k % 13 != 0, money(F.col("revenue_cents"))).alias("total_money"),
        money(F.col("tax_cents")).alias("total_tax_money"),
        money(F.col("tip_cents")).alias("total_tip_money"),
        F.when(k % 6 == 0, money(F.lit(500))).alias("total_discount_money"),
        F.struct(F.lit("Register").alias("name")).alias("source"),
        F.transform(_upto(k % 4), lambda i: F.struct(F.get(kinds, ((k + i) % 4).cast("int")).alias("type")))
        .alias("tenders"),
        F.transform(_upto(k % 3), fulfillment).alias("fulfillments"),
        F.transform(_upto(k % 4), line).alias("line_items"),
        F.when(k % 10 == 0, F.array(F.struct(F.lit("R").alias("uid")))).alias("returns"),
        F.lit(1).cast("bigint").alias("version"),
    )


def payment_payloads(shop: SampleShop) -> DataFrame:
    """Payments whose fee comes in two parts."""
    fee = F.col("processing_fee_cents")
    half = F.floor(fee / 2)
    card = F.col("source_type") == "CARD"
    return shop.payments.select(
        F.col("payment_id").alias("id"),
        "order_id", "location_id",
        stamp("created_at").alias("created_at"),
        stamp("updated_at").alias("updated_at"),
        "status",
        money(F.col("amount_cents")).alias("amount_money"),
        F.when(
            card,
            F.array(F.struct(money(half).alias("amount_money")), F.struct(money(fee - half).alias("amount_money"))),
        ).alias("processing_fee"),
        "source_type",
        F.when(
            card,
            F.struct(
                F.lit("KEYED").alias("entry_method"),
                F.struct(F.col("card_brand"), F.lit("CREDIT").alias("card_type")).alias("card"),
            ),
        ).alias("card_details"),
    )


def refund_payloads(shop: SampleShop) -> DataFrame:
    return shop.refunds.select(
        F.col("refund_id").alias("id"),
        F.concat(F.lit("P"), "order_id").alias("payment_id"),
        "order_id", "location_id",
        stamp("created_at").alias("created_at"),
        stamp("updated_at").alias("updated_at"),
        F.lit("COMPLETED").alias("status"),
        money(F.col("amount_cents")).alias("amount_money"),
        F.array(F.struct(money(F.lit(-3)).alias("amount_money"))).alias("processing_fee"),
        F.lit("returned").alias("reason"),
    )


def customer_payloads(shop: SampleShop) -> DataFrame:
    key = F.col("c_custkey")
    return shop.raw("customer").select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("given_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email_address"),
        F.when(key % 2 == 0, F.array(F.col("c_mktsegment"))).alias("group_ids"),
        F.struct((key % 3 == 0).alias("email_unsubscribed")).alias("preferences"),
        F.when(key % 4 != 0, F.struct(F.col("c_nationkey").cast("string").alias("postal_code"))).alias("address"),
    )


def shift_payloads(shop: SampleShop) -> DataFrame:
    return shop.shifts.select(
        F.col("shift_id").alias("id"),
        "team_member_id", "location_id",
        stamp("start_at").alias("start_at"),
        stamp("end_at").alias("end_at"),
        F.when(F.col("end_at").isNull(), "OPEN").otherwise("CLOSED").alias("status"),
        F.struct(F.lit("cook").alias("title"), money(F.col("hourly_rate_cents")).alias("hourly_rate")).alias("wage"),
    )


def catalog_payloads(shop: SampleShop) -> DataFrame:
    """One listing of ITEM and CATEGORY objects; part sizes decide where an item keeps its category."""
    part = shop.raw("part")
    category = F.concat(F.lit("CAT-"), F.col("p_type"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    items = part.select(
        F.lit("ITEM").alias("type"),
        F.concat(F.lit("ITEM"), key).alias("id"),
        F.struct(
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            F.when(size % 2 == 0, F.concat("p_brand", F.lit(" "), "p_name")).alias("description_plaintext"),
            F.when(size % 3 == 0, category).alias("category_id"),
            F.when(size % 3 == 1, F.array(F.struct(category.alias("id")))).alias("categories"),
            (size > 40).alias("is_archived"),
            F.array(
                F.struct(
                    F.concat(F.lit("VAR"), key).alias("id"),
                    F.struct(
                        F.lit("regular").alias("name"),
                        money(F.round(F.col("p_retailprice") * 100)).alias("price_money"),
                    ).alias("item_variation_data"),
                ),
                F.struct(
                    F.when(size % 5 == 0, F.concat(F.lit("VARL"), key)).alias("id"),
                    F.struct(
                        F.lit("large").alias("name"), F.lit(None).cast("struct<amount:bigint,currency:string>")
                        .alias("price_money"),
                    ).alias("item_variation_data"),
                ),
            ).alias("variations"),
        ).alias("item_data"),
    )
    categories = part.select("p_type").distinct().select(
        F.lit("CATEGORY").alias("type"), category.alias("id"),
        F.struct(F.initcap("p_type").alias("name")).alias("category_data"),
    )
    return items.unionByName(categories, allowMissingColumns=True)


def weather_payloads(shop: SampleShop) -> DataFrame:
    """One response per month: parallel daily series (one of them a day short) and hourly humidity.

    A month is gathered into arrays of at most 31 days.
    """
    day = F.unix_date("date")
    hourly = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.struct(
            F.concat(F.col("date").cast("string"), F.lit("T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00")).alias("t"),
            F.when((day + h) % 11 != 0, ((day * 3 + h * 7) % 100).cast("double")).alias("v"),
        ),
    )
    daily = shop.weather.select("date", "source", "temp_max_f", "precipitation_in", "snowfall_in", "wind_max_mph",
                                "weather_code", hourly.alias("hours"))
    months = daily.groupBy("source", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in daily.columns if c != "source"]))).alias("d")
    )
    d = F.col("d")
    readings = F.flatten(d["hours"])
    return months.select(
        F.lit(38.9).alias("latitude"), F.lit(-77.0).alias("longitude"), "source",
        F.struct(
            d["date"].cast("array<string>").alias("time"),
            d["temp_max_f"].alias("temperature_2m_max"),
            d["precipitation_in"].alias("precipitation_sum"),
            d["snowfall_in"].alias("snowfall_sum"),
            F.slice(d["wind_max_mph"], 1, F.greatest(F.size(d) - 1, F.lit(1))).alias("wind_speed_10m_max"),
            d["weather_code"].alias("weather_code"),
        ).alias("daily"),
        F.struct(readings["t"].alias("time"), readings["v"].alias("relative_humidity_2m")).alias("hourly"),
    )

"""The benchmark star schema seen as a point-of-sale history.

Every domain table is a projection or a keyed deduplication of a given table, so its size and the work on
it grow with the data. Nulls, late hours, unknown timezones, open shifts and stale versions are derived
from keys so that every rule of the operators has rows to act on.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.joins import Lookup
from tillcast.functions.trading_day import business_day, location_zones
from tillcast.operators.dims import calendar_days, expand_events, expand_promotions
from tillcast.operators.ingest import expand_modifiers, latest_by_key
from tillcast.operators.normalize import weather_flags
from tillcast.session import pin_utc

AS_OF = "2001-08-01"
HORIZON_DAYS = 14
SHIFT_OFFSET_DAYS = 9131  # puts the event log into January 1999

TABLES = (
    "locations", "calendar_days", "weather", "events", "promotions", "catalog_items", "catalog_variations",
    "orders", "order_items", "order_item_modifiers", "payments", "refunds", "shifts",
)


class _Tables(Mapping):
    """The domain tables by name, each built when it is asked for."""

    def __init__(self, shop: SampleShop, instead: Mapping[str, str] | None = None):
        self._shop = shop
        self._instead = instead or {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return getattr(self._shop, self._instead.get(name, name))

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


class SampleShop:
    """Domain tables over one folder of the star schema, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            stamps = {n: F.col(n).cast("timestamp") for n, k in df.dtypes if k == "timestamp_ntz"}
            self._raw[table] = df.withColumns(stamps) if stamps else df
        return self._raw[table]

    # -- dimensions

    @cached_property
    def locations(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "cast(r_regionkey as string) as location_id",
            "r_name as name",
            "case r_regionkey when 3 then 'INACTIVE' when 4 then null else 'ACTIVE' end as status",
            "case r_regionkey when 1 then 'America/New_York' when 2 then 'Asia/Tokyo' when 3 then 'Europe/Paris' "
            "when 4 then 'Mars/Base' end as timezone",
        )

    @cached_property
    def zones(self) -> Lookup:
        return location_zones(self.locations)

    @cached_property
    def span(self) -> DataFrame:
        """First and last calendar date: the order dates, one day earlier and the horizon later."""
        return self.raw("orders").agg(
            F.expr("date_sub(to_date(min(o_orderdate)), 1)").alias("first"),
            F.expr(f"date_add(to_date(max(o_orderdate)), {HORIZON_DAYS})").alias("last"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        """Fixed dates and the fourth Thursday of November, one day beyond the calendar on either side so
        that the eve of and the day after a holiday out of range are known."""
        days = self.span.selectExpr(
            "explode(sequence(date_sub(first, 1), date_add(last, 1), interval 1 day)) as date"
        )
        return days.selectExpr(
            "date",
            "case when month(date) = 1 and day(date) = 1 then 'New Years Day' "
            "when month(date) = 7 and day(date) = 4 then 'Independence Day' "
            "when month(date) = 11 and weekday(date) = 3 and day(date) between 22 and 28 then 'Thanksgiving' "
            "when month(date) = 12 and day(date) = 25 then 'Christmas Day' end as name",
        ).where("name is not null")

    @cached_property
    def school_terms(self) -> DataFrame:
        start = "date_add(date'1995-01-10', n_nationkey * 97)"
        return self.raw("nation").selectExpr(
            "n_name as label", f"{start} as start_date", f"date_add({start}, 110) as end_date",
            "n_nationkey as ordinal",
        )

    @cached_property
    def calendar_days(self) -> DataFrame:
        return calendar_days(self.span, self.holidays, self.school_terms)

    @cached_property
    def weather(self) -> DataFrame:
        """Daily weather with an outage on the 29th of every month."""
        days = self.span.selectExpr("explode(sequence(first, last, interval 1 day)) as date")
        rows = days.where("day(date) <> 29").selectExpr("date", "unix_date(date) as ep").selectExpr(
            "date",
            "case when ep % 40 = 0 then 'forecast' else 'archive' end as source",
            "case when ep % 53 <> 0 then 60.0D + ep % 15 end as temp_max_f",
            "40.0D + ep % 11 as temp_min_f",
            "50.0D + ep % 13 as temp_mean_f",
            "61.0D + ep % 15 as feels_like_max_f",
            "case when ep % 5 = 0 then 0.5D else 0.0D end as precipitation_in",
            "case when ep % 31 = 0 then 1.5D else 0.0D end as snowfall_in",
            "case when ep % 5 = 0 then 3.0D else 0.0D end as precipitation_hours",
            "5.0D + ep % 9 as wind_max_mph",
            "45.0D + ep % 40 as humidity_mean",
            "case when ep % 17 <> 0 then cast((ep * 7) % 100 as int) end as weather_code",
        )
        return weather_flags(rows)

    @cached_property
    def event_list(self) -> DataFrame:
        """Local happenings from the part list: one-day, multi-day, open-ended, reversed and undated."""
        start = "date_add(date'1994-12-20', cast((p_partkey * 13) % 2500 as int))"
        return self.raw("part").selectExpr(
            "concat(p_name, ' ', cast(p_partkey as string)) as name",
            "case p_type when 'ECONOMY' then 'sports' when 'PROMO' then 'concert' when 'LARGE' then 'festival' "
            "else 'civic' end as category",
            "p_brand as venue",
            f"case when p_size <> 50 then {start} end as start_date",
            f"case when p_size % 11 = 0 then date_sub({start}, 1) "
            f"when p_size % 7 <> 0 then date_add({start}, p_size % 5) end as end_date",
            "case when p_size % 3 = 0 then '19:00' end as start_time",
            "(p_partkey % 200) / 10.0D as distance_miles",
            "case when p_size % 9 <> 0 then cast(p_size as bigint) * 100 end as expected_attendance",
            "cast(null as string) as notes",
        )

    @cached_property
    def promotion_list(self) -> DataFrame:
        start = "date_add(date'1995-01-01', cast((s_suppkey * 37) % 2400 as int))"
        return self.raw("supplier").selectExpr(
            "s_name as name",
            "case s_nationkey % 4 when 0 then 'facebook_ads' when 1 then 'ubereats' when 2 then 'email' "
            "else 'in_store' end as channel",
            "case s_suppkey % 3 when 0 then 'percent' when 1 then 'amount' else 'none' end as discount_type",
            "(s_nationkey % 6) * 5.0D as discount_value",
            f"{start} as start_date",
            f"case when s_nationkey % 8 <> 0 then date_add({start}, s_nationkey % 10) end as end_date",
            "cast(floor(abs(s_acctbal)) as double) as spend_usd",
            "'all' as applies_to",
            "cast(null as string) as notes",
        )

    def _range(self) -> tuple[Column, Column]:
        return self.span.select("first").scalar(), self.span.select("last").scalar()

    @cached_property
    def events(self) -> DataFrame:
        return expand_events(self.event_list, *self._range())

    @cached_property
    def promotions(self) -> DataFrame:
        return expand_promotions(self.promotion_list, *self._range())

    @cached_property
    def catalog_items(self) -> DataFrame:
        """An item per part; some items have no category."""
        return self.raw("part").selectExpr(
            "concat('ITEM', cast(p_partkey as string)) as catalog_object_id",
            "p_name as item_name",
            "case when p_size % 23 <> 0 then p_type end as category_name",
        )

    @cached_property
    def catalog_variations(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('VAR', cast(p_partkey as string)) as variation_id",
            "concat('ITEM', cast(p_partkey as string)) as catalog_object_id",
            "p_brand as name",
            "cast(round(p_retailprice * 100) as bigint) as price_cents",
        )

    # -- facts

    @cached_property
    def orders_undated(self) -> DataFrame:
        """Orders before the trading day is known."""
        created = "timestampadd(MINUTE, cast((o_orderkey * 37) % 1440 as int), o_orderdate)"
        return self.raw("orders").selectExpr(
            "*", f"{created} as created_at", "cast(round(o_totalprice * 100) as bigint) as revenue_cents",
            "cast((o_orderkey % 4) * 150 as bigint) as tip_cents",
        ).selectExpr(
            "cast(o_orderkey as string) as order_id",
            "cast(o_orderkey % 5 as string) as location_id",
            "created_at",
            "timestampadd(MINUTE, cast(o_orderkey % 5000 as int), created_at) as updated_at",
            "case when o_orderkey % 9 <> 0 then timestampadd(MINUTE, 45, created_at) end as closed_at",
            "case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'CANCELED' "
            "when o_orderkey % 211 <> 0 then 'COMPLETED' end as state",
            "revenue_cents",
            "revenue_cents * 8 div 108 as tax_cents",
            "tip_cents",
            "cast(case when o_orderkey % 6 = 0 then 500 else 0 end as bigint) as discount_cents",
            "cast(case when o_orderkey % 8 = 0 then 200 else 0 end as bigint) as service_charge_cents",
            "revenue_cents - revenue_cents * 8 div 108 - tip_cents as net_sales_cents",
            "case o_orderpriority when '1-URGENT' then 'DELIVERY' when '2-HIGH' then 'PICKUP' end as fulfillment_type",
            "case when o_orderkey % 7 <> 0 then cast(o_custkey as string) end as customer_id",
            "cast(1 + o_orderkey % 6 as double) as item_quantity",
            "o_orderstatus as upstream_status",
            "o_orderpriority as upstream_priority",
            "o_orderkey as k",
        )

    @cached_property
    def orders_dated(self) -> DataFrame:
        return business_day(self.orders_undated, self.zones)

    @cached_property
    def orders(self) -> DataFrame:
        return self.orders_dated.drop("upstream_status", "upstream_priority", "k")

    # Later shipping wins; the remaining columns make the order total.
    LINE_VERSION = (
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )

    # Columns that follow from the key and the first columns of the version.
    LINE = {
        "order_id": "cast(l_orderkey as string)",
        "line_item_uid": "cast(l_linenumber as string)",
        "location_id": "cast(l_orderkey % 5 as string)",
        "created_at": "timestampadd(MINUTE, cast((l_orderkey * 37) % 1440 as int), l_shipdate)",
        "catalog_object_id": "case when l_partkey % 41 <> 0 then concat('VAR', cast(l_partkey as string)) end",
        "item_name": "concat('Dish ', cast(l_partkey % 64 as string))",
    }

    def _lines(self, rows: DataFrame) -> DataFrame:
        """Line items of some rows of the given table, with the columns that order their versions."""
        choice = "named_struct('uid', '{0}', 'catalog_object_id', 'MOD-{0}', 'name', '{1}', 'price_cents', {2}L)"
        picks = ", ".join(
            f"case when {condition} then {choice.format(*values)} end"
            for condition, values in (
                ("l_returnflag = 'R'", ("M1", "Extra spicy", 50)),
                ("l_linestatus = 'O'", ("M2", "No onions", 0)),
                ("l_returnflag = 'A'", ("M3", "Large", 150)),
            )
        )
        return rows.selectExpr(
            *[f"{made} as {c}" for c, made in self.LINE.items()],
            "l_quantity as quantity",
            "cast(round(l_extendedprice * 100) as bigint) as total_cents",
            f"array_compact(array({picks})) as modifiers",
            *[f"{c} as v_{c}" for c in self.LINE_VERSION],
        )

    @cached_property
    def line_versions(self) -> DataFrame:
        """Line items as landed: several versions of a (order, line) key, not yet deduplicated."""
        return self._lines(self.raw("lineitem"))

    def latest_lines(self, landed: DataFrame) -> DataFrame:
        """The latest version of every line item among some rows of the given table.

        Key and version columns say all the others, so these are made after the deduplication and never shuffled.
        """
        keys, version = ["l_orderkey", "l_linenumber"], list(self.LINE_VERSION)
        return self._lines(latest_by_key(landed.select(*keys, *version), keys, version))

    @cached_property
    def order_item_records(self) -> DataFrame:
        """Latest version of every line item with its nested modifiers."""
        newest = self.latest_lines(self.raw("lineitem"))
        return business_day(newest.drop(*[f"v_{c}" for c in self.LINE_VERSION]), self.zones)

    @cached_property
    def order_items(self) -> DataFrame:
        return self.order_item_records.drop("modifiers", "business_hour")

    @cached_property
    def items_sold(self) -> DataFrame:
        """(business_date, location_id, item_name) of every line item: all that a daily summary takes of ``order_items``.

        Versions are compared column by column, so the first columns of the latest one are the greatest of those columns
        alone, and the others need not be read, shuffled and sorted with them.
        """
        keys, head = ["l_orderkey", "l_linenumber"], list(self.LINE_VERSION[:2])
        newest = latest_by_key(self.raw("lineitem").select(*keys, *head), keys, head)
        named = newest.selectExpr(*[f"{self.LINE[c]} as {c}" for c in ("location_id", "created_at", "item_name")])
        return business_day(named, self.zones).select("business_date", "location_id", "item_name")

    @cached_property
    def summary_tables(self) -> Mapping[str, DataFrame]:
        """The tables of the daily summary, with of the line items what it takes of them."""
        return _Tables(self, {"order_items": "items_sold"})

    @cached_property
    def order_item_modifiers(self) -> DataFrame:
        return expand_modifiers(self.order_item_records)

    @cached_property
    def payments(self) -> DataFrame:
        return self.orders_dated.selectExpr(
            "concat('P', order_id) as payment_id",
            "case when k % 50 <> 0 then order_id end as order_id",
            "location_id", "created_at", "updated_at", "business_date",
            "case when k % 17 = 0 then 'FAILED' else 'COMPLETED' end as status",
            "revenue_cents as amount_cents",
            "case when k % 10 < 6 then 'CARD' when k % 10 < 9 then 'CASH' else 'GIFT_CARD' end as source_type",
            "case when k % 10 < 6 then case k % 3 when 0 then 'VISA' when 1 then 'MASTERCARD' "
            "else 'AMERICAN_EXPRESS' end end as card_brand",
            "cast(case when k % 10 < 6 then revenue_cents * 29 div 1000 + 30 else 0 end as bigint) "
            "as processing_fee_cents",
        )

    @cached_property
    def refunds(self) -> DataFrame:
        """Urgent orders that were fulfilled are refunded by a tenth."""
        refunded = self.orders_dated.where("upstream_status = 'F' and upstream_priority = '1-URGENT'")
        return refunded.selectExpr(
            "concat('R', order_id) as refund_id",
            "order_id", "location_id", "created_at", "updated_at", "business_date",
            "net_sales_cents div 10 as amount_cents",
        )

    @cached_property
    def shifts(self) -> DataFrame:
        """Every logged event is a shift; an error is one that was never closed."""
        rows = self.raw("events").selectExpr(
            "*", "cast(round(value * 60) as bigint) as secs", "event_type = 'error' as is_open",
            f"timestampadd(DAY, -{SHIFT_OFFSET_DAYS}, date_trunc('second', ts)) as start_at",
            "cast(1500 + (user_id % 7) * 125 as bigint) as rate",
        ).selectExpr(
            "*", "case when is_open then 0.0D else secs / 3600.0D end as hours"
        ).selectExpr(
            "cast(event_id as string) as shift_id",
            "cast(user_id as string) as team_member_id",
            "cast(user_id % 5 as string) as location_id",
            "start_at",
            "case when not is_open then timestampadd(SECOND, cast(secs as int), start_at) end as end_at",
            "hours",
            "rate as hourly_rate_cents",
            "cast(bround(rate * hours) as bigint) as labor_cost_cents",
        )
        return business_day(rows, self.zones, "start_at").drop("business_hour")

    @cached_property
    def tables(self) -> Mapping[str, DataFrame]:
        return _Tables(self)

"""Table contracts: landing schema, typed schema, key, defaults, and nested payload schemas.

Schemas are always declared and never inferred.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChildSpec:
    """Rows nested in a parent record that get a table of their own."""

    table: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    defaults: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EntitySpec:
    """One raw entity and the table it is loaded into."""

    entity: str
    table: str
    keys: tuple[str, ...]
    landing: str  # DDL of the raw JSON record
    columns: tuple[str, ...]  # columns kept in the table, in order
    defaults: dict = field(default_factory=dict)
    dated_by: str | None = None  # instant that decides the trading day
    child: ChildSpec | None = None

    @property
    def is_fact(self) -> bool:
        return self.dated_by is not None


def field_names(ddl: str) -> list[str]:
    """Top-level field names of a DDL string (nested types sit inside angle brackets)."""
    depth, flat = 0, []
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if depth == 0 and char != ">":
            flat.append(char)
    return [part.split()[0] for part in "".join(flat).split(",")]


def _names(ddl: str, drop: tuple[str, ...] = (), after: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """Column names of a DDL string, minus ``drop``, with extra names inserted after given ones."""
    out: list[str] = []
    for name in field_names(ddl):
        if name not in drop:
            out.append(name)
            out.extend((after or {}).get(name, ()))
    return tuple(out)


# Field names, types and defaults of the landed records.
_LOCATIONS = (
    "location_id string, name string, status string, currency string, country string, state string, "
    "city string, postal_code string, address_line_1 string, latitude double, longitude double, "
    "timezone string, business_name string, type string, created_at string"
)
_CALENDAR = (
    "date string, day_of_week int, day_name string, month int, month_name string, year int, "
    "day_of_month int, day_of_year int, week_of_year int, quarter int, is_weekend boolean, "
    "is_weekend_night boolean, is_holiday boolean, holiday_name string, is_holiday_eve boolean, "
    "is_day_after_holiday boolean, observance string, is_observance boolean, school_break string, "
    "is_school_break boolean, is_month_start boolean, is_month_end boolean, is_payday_window boolean"
)
_WEATHER = (
    "date string, latitude double, longitude double, source string, temp_max_f double, temp_min_f double, "
    "temp_mean_f double, feels_like_max_f double, feels_like_min_f double, precipitation_in double, "
    "rain_in double, snowfall_in double, precipitation_hours double, wind_max_mph double, "
    "wind_gust_mph double, humidity_mean double, weather_code int, sunrise string, sunset string, "
    "is_rainy boolean, is_snowy boolean, is_stormy boolean"
)
_EVENTS = (
    "date string, name string, category string, venue string, distance_miles double, "
    "expected_attendance bigint, start_time string, is_multi_day boolean, day_index int, notes string"
)
_PROMOTIONS = (
    "date string, name string, channel string, discount_type string, discount_value double, "
    "spend_usd double, applies_to string, day_index int, notes string"
)
_CATALOG = (
    "catalog_object_id string, item_name string, description string, category_id string, "
    "category_name string, product_type string, is_archived boolean, is_deleted boolean, "
    "updated_at string, version bigint, modifier_list_ids array<string>, "
    "variations array<struct<id: string, name: string, sku: string, price_cents: bigint>>"
)
_ORDERS = (
    "order_id string, location_id string, created_at string, updated_at string, closed_at string, "
    "state string, currency string, revenue_cents bigint, discount_cents bigint, tax_cents bigint, "
    "tip_cents bigint, service_charge_cents bigint, net_sales_cents bigint, source string, "
    "fulfillment_type string, fulfillment_state string, customer_id string, payment_types array<string>, "
    "tender_count int, line_item_count int, item_quantity double, has_returns boolean, "
    "ticket_name string, version bigint"
)
_ORDER_ITEMS = (
    "order_id string, line_item_uid string, line_number int, location_id string, created_at string, "
    "catalog_object_id string, item_name string, variation_name string, quantity double, unit string, "
    "base_price_cents bigint, gross_sales_cents bigint, discount_cents bigint, tax_cents bigint, "
    "total_cents bigint, item_type string, note string, modifiers array<struct<uid: string, "
    "catalog_object_id: string, name: string, price_cents: bigint>>, modifier_names array<string>"
)
_PAYMENTS = (
    "payment_id string, order_id string, location_id string, customer_id string, created_at string, "
    "updated_at string, status string, amount_cents bigint, tip_cents bigint, app_fee_cents bigint, "
    "refunded_cents bigint, approved_cents bigint, currency string, processing_fee_cents bigint, "
    "source_type string, card_brand string, card_type string, last_4 string, entry_method string, "
    "receipt_number string, team_member_id string"
)
_REFUNDS = (
    "refund_id string, payment_id string, order_id string, location_id string, created_at string, "
    "updated_at string, status string, amount_cents bigint, currency string, processing_fee_cents bigint, "
    "reason string, destination_type string, team_member_id string"
)
_CUSTOMERS = (
    "customer_id string, created_at string, updated_at string, given_name string, family_name string, "
    "email string, phone string, birthday string, reference_id string, company_name string, "
    "creation_source string, group_ids array<string>, segment_ids array<string>, "
    "email_unsubscribed boolean, postal_code string, note string"
)
_INVENTORY = (
    "catalog_object_id string, location_id string, state string, catalog_object_type string, "
    "quantity double, calculated_at string"
)
_TEAM = (
    "team_member_id string, reference_id string, status string, given_name string, family_name string, "
    "is_owner boolean, created_at string, updated_at string, assignment_type string, location_ids array<string>"
)
_SHIFTS = (
    "shift_id string, team_member_id string, location_id string, start_at string, end_at string, "
    "hours double, status string, job_id string, job_title string, hourly_rate_cents bigint, "
    "labor_cost_cents bigint, declared_tips_cents bigint, timezone string"
)

# Columns that default to zero instead of null.
_ORDER_ZEROS = {
    "revenue_cents": 0, "discount_cents": 0, "tax_cents": 0, "tip_cents": 0, "service_charge_cents": 0,
    "net_sales_cents": 0, "tender_count": 0, "line_item_count": 0, "item_quantity": 0.0, "has_returns": 0,
}
_ITEM_ZEROS = {
    "quantity": 0.0, "base_price_cents": 0, "gross_sales_cents": 0, "discount_cents": 0,
    "tax_cents": 0, "total_cents": 0,
}
_PAYMENT_ZEROS = {
    "amount_cents": 0, "tip_cents": 0, "app_fee_cents": 0, "refunded_cents": 0, "approved_cents": 0,
    "processing_fee_cents": 0,
}
_CALENDAR_ZEROS = {
    "is_weekend": 0, "is_weekend_night": 0, "is_holiday": 0, "is_holiday_eve": 0, "is_day_after_holiday": 0,
    "is_observance": 0, "is_school_break": 0, "is_month_start": 0, "is_month_end": 0, "is_payday_window": 0,
}

# Locations come first: the trading day of every later entity depends on their timezone.
ENTITIES: tuple[EntitySpec, ...] = (
    EntitySpec("locations", "locations", ("location_id",), _LOCATIONS, _names(_LOCATIONS)),
    EntitySpec("calendar", "calendar_days", ("date",), _CALENDAR, _names(_CALENDAR), _CALENDAR_ZEROS),
    EntitySpec(
        "weather", "weather", ("date",), _WEATHER, _names(_WEATHER),
        {"is_rainy": 0, "is_snowy": 0, "is_stormy": 0},
    ),
    EntitySpec(
        "events", "events", ("date", "name"), _EVENTS, _names(_EVENTS), {"is_multi_day": 0, "day_index": 0}
    ),
    EntitySpec(
        "promotions", "promotions", ("date", "name"), _PROMOTIONS, _names(_PROMOTIONS), {"day_index": 0}
    ),
    EntitySpec(
        "catalog", "catalog_items", ("catalog_object_id",), _CATALOG, _names(_CATALOG, drop=("variations",)),
        {"is_archived": 0, "is_deleted": 0},
        child=ChildSpec(
            "catalog_variations", ("variation_id",),
            ("variation_id", "catalog_object_id", "name", "sku", "price_cents"), {"price_cents": 0},
        ),
    ),
    EntitySpec(
        "orders", "orders", ("order_id",), _ORDERS,
        (*_names(_ORDERS, after={"closed_at": ("business_date", "business_hour")}), "ingested_at"),
        _ORDER_ZEROS, dated_by="created_at",
    ),
    EntitySpec(
        "order_items", "order_items", ("order_id", "line_item_uid"), _ORDER_ITEMS,
        _names(_ORDER_ITEMS, drop=("modifiers", "modifier_names"), after={"created_at": ("business_date",)}),
        _ITEM_ZEROS, dated_by="created_at",
        child=ChildSpec(
            "order_item_modifiers", ("order_id", "line_item_uid", "modifier_uid"),
            ("order_id", "line_item_uid", "modifier_uid", "catalog_object_id", "name", "price_cents"),
            {"price_cents": 0},
        ),
    ),
    EntitySpec(
        "payments", "payments", ("payment_id",), _PAYMENTS,
        _names(_PAYMENTS, after={"updated_at": ("business_date",)}), _PAYMENT_ZEROS, dated_by="created_at",
    ),
    EntitySpec(
        "refunds", "refunds", ("refund_id",), _REFUNDS,
        _names(_REFUNDS, after={"updated_at": ("business_date",)}),
        {"amount_cents": 0, "processing_fee_cents": 0}, dated_by="created_at",
    ),
    EntitySpec("customers", "customers", ("customer_id",), _CUSTOMERS, _names(_CUSTOMERS)),
    EntitySpec(
        "inventory", "inventory_counts", ("catalog_object_id", "location_id", "state"), _INVENTORY,
        _names(_INVENTORY), {"quantity": 0.0},
    ),
    EntitySpec(
        "team_members", "team_members", ("team_member_id",), _TEAM, _names(_TEAM), {"is_owner": 0}
    ),
    EntitySpec(
        "shifts", "shifts", ("shift_id",), _SHIFTS, _names(_SHIFTS, after={"end_at": ("business_date",)}),
        {"hours": 0.0, "hourly_rate_cents": 0, "labor_cost_cents": 0, "declared_tips_cents": 0},
        dated_by="start_at",
    ),
)

BY_ENTITY = {spec.entity: spec for spec in ENTITIES}
BY_TABLE = {spec.table: spec for spec in ENTITIES}

# Fields that are instants (text in the landed record, TIMESTAMP in the table).
INSTANT_FIELDS = ("created_at", "updated_at", "closed_at", "start_at", "end_at", "calculated_at")

# Shape of the nested upstream payloads, as far as fields are read from them.
_MONEY = "struct<amount: bigint, currency: string>"
_RECIPIENT = "struct<recipient: struct<customer_id: string>>"
ORDER_PAYLOAD = (
    f"""id string, location_id string, created_at string, updated_at string, closed_at string, state string,
    customer_id string, ticket_name string, version bigint, source struct<name: string>,
    total_money {_MONEY}, total_discount_money {_MONEY}, total_tax_money {_MONEY}, total_tip_money {_MONEY},
    total_service_charge_money {_MONEY}, tenders array<struct<type: string>>,
    returns array<struct<uid: string>>,
    fulfillments array<struct<type: string, state: string, pickup_details: {_RECIPIENT},
      delivery_details: {_RECIPIENT}>>,
    line_items array<struct<uid: string, catalog_object_id: string, name: string, variation_name: string,
      quantity: string, quantity_unit: struct<measurement_unit: struct<type: string>>,
      base_price_money: {_MONEY}, gross_sales_money: {_MONEY}, total_discount_money: {_MONEY},
      total_tax_money: {_MONEY}, total_money: {_MONEY}, item_type: string, note: string,
      modifiers: array<struct<uid: string, catalog_object_id: string, name: string,
        base_price_money: {_MONEY}>>>>"""
)
PAYMENT_PAYLOAD = (
    f"""id string, order_id string, location_id string, customer_id string, created_at string,
    updated_at string, status string, amount_money {_MONEY}, tip_money {_MONEY}, app_fee_money {_MONEY},
    refunded_money {_MONEY}, approved_money {_MONEY},
    processing_fee array<struct<amount_money: {_MONEY}>>, source_type string,
    card_details struct<entry_method: string,
      card: struct<card_brand: string, card_type: string, last_4: string>>,
    receipt_number string, team_member_id string"""
)
REFUND_PAYLOAD = (
    f"""id string, payment_id string, order_id string, location_id string, created_at string,
    updated_at string, status string, amount_money {_MONEY},
    processing_fee array<struct<amount_money: {_MONEY}>>, reason string, destination_type string,
    team_member_id string"""
)
CUSTOMER_PAYLOAD = (
    """id string, created_at string, updated_at string, given_name string, family_name string,
    email_address string, phone_number string, birthday string, reference_id string, company_name string,
    creation_source string, group_ids array<string>, segment_ids array<string>,
    preferences struct<email_unsubscribed: boolean>, address struct<postal_code: string>, note string"""
)
CATALOG_PAYLOAD = (
    f"""type string, id string, is_deleted boolean, updated_at string, version bigint,
    category_data struct<name: string>,
    item_data struct<name: string, description: string, description_plaintext: string, category_id: string,
      categories: array<struct<id: string>>, product_type: string, is_archived: boolean,
      modifier_list_info: array<struct<modifier_list_id: string>>,
      variations: array<struct<id: string,
        item_variation_data: struct<name: string, sku: string, price_money: {_MONEY}>>>>"""
)
INVENTORY_PAYLOAD = (
    """catalog_object_id string, catalog_object_type string, location_id string, state string,
    quantity string, calculated_at string"""
)
TEAM_PAYLOAD = (
    """id string, reference_id string, status string, given_name string, family_name string,
    is_owner boolean, created_at string, updated_at string,
    assigned_locations struct<assignment_type: string, location_ids: array<string>>"""
)
LOCATION_PAYLOAD = (
    """id string, name string, status string, currency string, timezone string, business_name string,
    type string, created_at string, coordinates struct<latitude: double, longitude: double>,
    address struct<country: string, administrative_district_level_1: string, locality: string,
      postal_code: string, address_line_1: string>"""
)
SHIFT_PAYLOAD = (
    f"""id string, team_member_id string, location_id string, start_at string, end_at string, status string,
    timezone string, wage struct<title: string, job_id: string, hourly_rate: {_MONEY}>,
    declared_cash_tip_money {_MONEY}"""
)
WEATHER_PAYLOAD = (
    """latitude double, longitude double, source string,
    daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>,
      temperature_2m_mean: array<double>, apparent_temperature_max: array<double>,
      apparent_temperature_min: array<double>, precipitation_sum: array<double>, rain_sum: array<double>,
      snowfall_sum: array<double>, precipitation_hours: array<double>, wind_speed_10m_max: array<double>,
      wind_gusts_10m_max: array<double>, weather_code: array<int>, sunrise: array<string>,
      sunset: array<string>>,
    hourly struct<time: array<string>, relative_humidity_2m: array<double>>"""
)
EVENT_CSV = (
    """name string, category string, venue string, start_date string, end_date string, start_time string,
    distance_miles string, expected_attendance string, notes string"""
)
PROMOTION_CSV = (
    """name string, channel string, discount_type string, discount_value string, start_date string,
    end_date string, spend_usd string, applies_to string, notes string"""
)
SCHOOL_CSV = "label string, start_date string, end_date string, notes string"

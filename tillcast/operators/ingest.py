"""Typed loading: trading-day assignment, defaults, child rows, keyed upsert, retention, watermarks."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import count_if, flag, instant
from tillcast.functions.joins import Lookup
from tillcast.functions.trading_day import CUTOFF_HOUR, business_day
from tillcast.schemas import INSTANT_FIELDS, ChildSpec, EntitySpec

OVERLAP = timedelta(hours=6)
BACKFILL_DAYS = 730
MIN_TRADING_DAYS = 60


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Null becomes the declared default, only in columns that declare one."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items() if c in types}
    )


def flags_to_ints(df: DataFrame) -> DataFrame:
    """Booleans become 0/1, since arithmetic is done on them downstream."""
    return df.withColumns({name: F.col(name).cast("int") for name, kind in df.dtypes if kind == "boolean"})


def typed_rows(
    landed: DataFrame, spec: EntitySpec, zones: Lookup | None, cutoff_hour: int = CUTOFF_HOUR,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Landed records of one entity as table rows; file-position columns and ``keep`` are carried along."""
    kinds = dict(landed.dtypes)
    typed = landed.withColumns(
        {c: instant(F.col(c)) for c in INSTANT_FIELDS if kinds.get(c) == "string" and c in spec.columns}
        | ({"date": F.col("date").try_cast("date")} if kinds.get("date") == "string" else {})
    )
    if spec.dated_by:
        typed = business_day(typed, zones, spec.dated_by, cutoff_hour)
    if "ingested_at" in spec.columns:
        typed = typed.withColumn("ingested_at", F.current_timestamp())
    typed = with_defaults(flags_to_ints(typed), spec.defaults)
    extra = [c for c in typed.columns if c.startswith("_") or c in keep]
    return typed.select(*spec.columns, *extra)


def expand_modifiers(items: DataFrame, *carry: str) -> DataFrame:
    return items.select("order_id", "line_item_uid", *carry, F.explode("modifiers").alias("m")).select(
        "order_id", "line_item_uid",
        F.col("m.uid").alias("modifier_uid"),
        F.col("m.catalog_object_id").alias("catalog_object_id"),
        F.col("m.name").alias("name"),
        F.coalesce(F.col("m.price_cents"), F.lit(0).cast("bigint")).alias("price_cents"),
        *carry,
    )


def expand_variations(catalog: DataFrame, *carry: str) -> DataFrame:
    """Variations without an id are left out."""
    rows = catalog.select("catalog_object_id", *carry, F.explode("variations").alias("v"))
    return rows.where(F.col("v.id").isNotNull() & (F.col("v.id") != "")).select(
        F.col("v.id").alias("variation_id"),
        "catalog_object_id",
        F.col("v.name").alias("name"),
        F.col("v.sku").alias("sku"),
        F.coalesce(F.col("v.price_cents"), F.lit(0).cast("bigint")).alias("price_cents"),
        *carry,
    )


def expand_children(landed: DataFrame, child: ChildSpec, *carry: str) -> DataFrame:
    expand = {"order_item_modifiers": expand_modifiers, "catalog_variations": expand_variations}[child.table]
    return expand(landed, *carry)


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column] | list[str]) -> DataFrame:
    """The last version of every key.

    ``max_by`` is combined on the map side, so a key that holds a third of all versions reaches the
    reducer as one row per map task; a ranking window would sort all of them in one task.
    ``order`` should be total over the versions of a key. Given as names of columns, these cross the shuffle once, as
    the head of the row, and not a second time beside it; the other columns then decide between equal versions.
    """
    if order and all(isinstance(o, str) for o in order):
        row = [*order, *[c for c in df.columns if c not in keys and c not in order]]
        newest = df.groupBy(*keys).agg(F.max(F.struct(*row)).alias("__row"))
        return newest.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    newest = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(newest.alias("__row")).select(*[
        F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns
    ])


def upsert_latest(existing: DataFrame, batch: DataFrame, keys: list[str], version_cols: list[str]) -> DataFrame:
    """Existing rows plus a batch: a key of the batch replaces the stored row, and inside the batch the
    highest ``version_cols`` wins. ``version_cols`` are columns of the batch that the table lacks."""
    columns = existing.columns
    newest = latest_by_key(batch, keys, [F.col(c) for c in version_cols]).select(*columns)
    kept = existing.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sales_span(daily_sales: DataFrame) -> DataFrame:
    return daily_sales.agg(
        F.min("business_date").alias("first_sales_date"),
        F.max("business_date").alias("last_sales_date"),
        F.count(F.lit(1)).alias("days_with_sales"),
    )


def retention_trim(tables: Mapping[str, DataFrame], cutoff: date | str) -> dict[str, DataFrame]:
    """Drop facts dated before the cutoff; undated rows stay. A modifier goes with its order, so an
    order_id is compared with the dropped orders, once per id."""
    limit = F.lit(str(cutoff)).cast("date")
    keep = F.col("business_date").isNull() | (F.col("business_date") >= limit)
    dated = ("orders", "order_items", "payments", "refunds", "shifts")
    out = {name: df.where(keep) if name in dated else df for name, df in tables.items()}
    if "order_item_modifiers" in tables and "orders" in tables:
        old = tables["orders"].where(F.col("business_date") < limit).select("order_id")
        out["order_item_modifiers"] = tables["order_item_modifiers"].join(old, "order_id", "left_anti")
    return out


def high_water_marks(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(entity, watermark, row_count): the newest value of each entity's watermark field."""
    parts = [
        df.agg(
            F.max(F.col(field)).cast("timestamp").alias("watermark"), F.count(F.lit(1)).alias("row_count")
        ).select(F.lit(entity).alias("entity"), "watermark", "row_count")
        for entity, (df, field) in sorted(sources.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def window_bounds(
    until: date, since: date | None = None, watermark: datetime | None = None,
    overlap: timedelta = OVERLAP, backfill_days: int = BACKFILL_DAYS,
) -> tuple[datetime, datetime]:
    """Start and end of the next pull: an explicit start, else the watermark less an overlap, else a
    fixed backfill. The end is the last instant of ``until``."""
    end = datetime.combine(until, time.max, timezone.utc)
    if since:
        return datetime.combine(since, time.min, timezone.utc), end
    if watermark:
        aware = watermark if watermark.tzinfo else watermark.replace(tzinfo=timezone.utc)
        return aware - overlap, end
    return end - timedelta(days=backfill_days), end


def incremental_window(
    df: DataFrame, ts_col: str, until: date, since: date | None = None, watermark: datetime | None = None,
    overlap: timedelta = OVERLAP, backfill_days: int = BACKFILL_DAYS,
) -> DataFrame:
    """Rows inside the next pull. The bounds are literals, so they reach the scan."""
    start, end = window_bounds(until, since, watermark, overlap, backfill_days)
    return df.where(F.col(ts_col).between(F.lit(start), F.lit(end)))


def account_preview(orders: DataFrame, minimum_days: int = MIN_TRADING_DAYS) -> DataFrame:
    """One row that says whether there is enough history. Days here are UTC dates of closing time, or
    of creation when an order was never closed."""
    canceled = "coalesce(state = 'CANCELED', false)"
    sale_day = F.expr(f"case when not {canceled} then to_date(coalesce(closed_at, created_at)) end")
    totals = orders.agg(
        F.count(F.lit(1)).alias("orders"),
        count_if(canceled, "cancelled_orders"),
        F.countDistinct(sale_day).alias("trading_days"),
        F.min(sale_day).alias("first_sale"),
        F.max(sale_day).alias("last_sale"),
        F.expr(f"coalesce(sum(case when not {canceled} then net_sales_cents end), 0) as cents"),
    )
    days = F.col("trading_days")
    need = F.lit(minimum_days).cast("bigint")
    return totals.select(
        "orders", "cancelled_orders",
        (F.col("orders") - F.col("cancelled_orders")).alias("sales_orders"),
        "trading_days", "first_sale", "last_sale",
        F.bround(F.col("cents") / 100.0, 2).alias("total_sales"),
        F.coalesce(
            F.when(days > 0, F.bround(F.col("cents") / 100.0 / days, 2)), F.lit(0.0)
        ).alias("average_day"),
        flag(days >= need).alias("enough_to_forecast"),
        F.greatest(need - days, F.lit(0).cast("bigint")).alias("days_needed"),
        need.alias("minimum_days"),
    )

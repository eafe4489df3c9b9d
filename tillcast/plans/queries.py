"""Every operator as a query over the sample tables: name -> (spark, sf_dir) -> DataFrame.

Doubles that are sums or statistics are rounded to four decimals, since two engines add them in different
orders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.trading_day import business_day
from tillcast.operators import dims, features, forecast, ingest, models, normalize, reads, ridge, rollups, splits
from tillcast.operators import summary as summaries
from tillcast.operators import validate
from tillcast.plans.daily_batch import ledger, load_all
from tillcast.schemas import (
    BY_ENTITY,
    CATALOG_PAYLOAD,
    CUSTOMER_PAYLOAD,
    ORDER_PAYLOAD,
    PAYMENT_PAYLOAD,
    REFUND_PAYLOAD,
    SHIFT_PAYLOAD,
    WEATHER_PAYLOAD,
    EntitySpec,
)
from tillcast.session import materialize, work_dir
from tillcast.sources import payloads
from tillcast.sources.landing import land, parse_lines, read_rejected
from tillcast.sources.sample import AS_OF, SampleShop
from tillcast.sources.tables import PART_KEY, Layout, merge_parts, read_parts, trim_parts
from tillcast.streaming.derived import read_summary, stored_first_seen
from tillcast.streaming.incremental import current_daily_sales, ingest_orders, run_ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ROLLING_7 = "sales_roll_mean_7"
CUTOFF = "1998-01-01"
# The sample spreads few rows over seven years, so its tables are partitioned by year.
YEARS = Layout("yyyy")


def query(fn: Callable[[SampleShop], DataFrame]) -> Callable[[SampleShop], DataFrame]:
    """Register a function of the sample tables under its own name."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(SampleShop(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n, kind in df.dtypes if kind == "double"})


def listed(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.withColumns({n: F.array_join(n, ",") for n, kind in df.dtypes if kind == "array<string>"})


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return parse_lines(payloads.as_lines(lines), schema)[0]


# -- normalizers


@query
def normalize_orders(shop):
    return listed(normalize.normalize_orders(_parsed(payloads.order_payloads(shop), ORDER_PAYLOAD))).withColumn(
        "has_returns", F.col("has_returns").cast("int")
    )


@query
def normalize_order_items(shop):
    rows = normalize.normalize_order_items(_parsed(payloads.order_payloads(shop), ORDER_PAYLOAD))
    return listed(rows.withColumn("modifier_count", F.size("modifiers")).drop("modifiers", "item_type", "note", "unit"))


@query
def normalize_payments(shop):
    rows = normalize.normalize_payments(_parsed(payloads.payment_payloads(shop), PAYMENT_PAYLOAD))
    return rows.select(
        "payment_id", "order_id", "location_id", "created_at", "status", "amount_cents", "tip_cents", "currency",
        "processing_fee_cents", "source_type", "card_brand", "card_type", "entry_method",
    )


@query
def normalize_refunds(shop):
    rows = normalize.normalize_refunds(_parsed(payloads.refund_payloads(shop), REFUND_PAYLOAD))
    return rows.select(
        "refund_id", "payment_id", "order_id", "location_id", "created_at", "status", "amount_cents",
        "processing_fee_cents", "reason",
    )


@query
def normalize_customers(shop):
    rows = normalize.normalize_customers(_parsed(payloads.customer_payloads(shop), CUSTOMER_PAYLOAD))
    return listed(
        ingest.flags_to_ints(
            rows.select("customer_id", "given_name", "email", "group_ids", "segment_ids", "email_unsubscribed",
                        "postal_code")
        )
    )


@query
def normalize_catalog(shop):
    rows = normalize.normalize_catalog(_parsed(payloads.catalog_payloads(shop), CATALOG_PAYLOAD))
    return ingest.flags_to_ints(
        rows.select(
            "catalog_object_id", "item_name", "description", "category_id", "category_name", "is_archived",
            "is_deleted", F.size("variations").alias("variation_count"),
        )
    )


@query
def expand_variations(shop):
    return ingest.expand_variations(
        normalize.normalize_catalog(_parsed(payloads.catalog_payloads(shop), CATALOG_PAYLOAD))
    )


@query
def normalize_shifts(shop):
    rows = normalize.normalize_shifts(_parsed(payloads.shift_payloads(shop), SHIFT_PAYLOAD))
    return rounded(
        rows.select("shift_id", "team_member_id", "location_id", "start_at", "end_at", "hours", "status",
                    "job_title", "hourly_rate_cents", "labor_cost_cents")
    )


@query
def weather_daily(shop):
    rows = normalize.daily_weather(_parsed(payloads.weather_payloads(shop), WEATHER_PAYLOAD))
    return rows.select(
        "date", "source", "temp_max_f", "precipitation_in", "snowfall_in", "wind_max_mph", "humidity_mean",
        "weather_code", "rain_in", "is_rainy", "is_snowy", "is_stormy",
    )


@query
def humidity_daily(shop):
    return normalize.daily_humidity(_parsed(payloads.weather_payloads(shop), WEATHER_PAYLOAD))


@query
def weather_flags(shop):
    return shop.weather.select("date", "weather_code", "precipitation_in", "snowfall_in", "is_rainy", "is_snowy",
                               "is_stormy")


# -- ingest


def _broken_lines(shop: SampleShop) -> DataFrame:
    """Order payloads as lines of which some are cut short and some are blank."""
    body = F.to_json(F.struct("order_id", "location_id", "revenue_cents", "customer_id"))
    k = F.col("k")
    text = F.when(k % 97 == 0, F.expr("left(body, length(body) - 9)")).when(k % 89 == 0, "  ").otherwise(F.col("body"))
    return shop.orders_undated.withColumn("body", body).select(text.alias("value"))


@query
def ingest_quarantine(shop):
    schema = "order_id string, location_id string, revenue_cents bigint, customer_id string"
    good, bad = parse_lines(_broken_lines(shop), schema)
    kept = good.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue_cents").alias("revenue_cents")
    )
    lost = bad.agg(F.count(F.lit(1)).alias("lines")).select(
        F.lit("quarantined").alias("location_id"), "lines", F.lit(None).cast("bigint").alias("revenue_cents")
    )
    return kept.unionByName(lost)


@query
def business_day_of(shop):
    return shop.orders.select("order_id", "location_id", "created_at", "business_date", "business_hour")


@query
def ingest_defaults(shop):
    k = F.col("k")
    gaps = shop.orders_undated.select(
        "order_id", "customer_id",
        F.when(k % 3 != 0, F.col("revenue_cents")).alias("revenue_cents"),
        F.when(k % 5 != 0, F.col("tip_cents")).alias("tip_cents"),
        F.when(k % 4 != 0, F.col("item_quantity")).alias("item_quantity"),
        F.when(k % 6 != 0, k % 2 == 0).alias("has_returns"),
    )
    return ingest.with_defaults(ingest.flags_to_ints(gaps), BY_ENTITY["orders"].defaults)


@query
def upsert_latest(shop):
    """Latest version of every line item."""
    return shop.order_items.drop("created_at")


def _line_runs(shop: SampleShop) -> tuple[DataFrame, DataFrame]:
    """Line versions as two runs, finished lines first and open ones later, one version per key in each."""
    lines = shop.raw("lineitem")
    finished = F.col("l_linestatus").eqNullSafe("F")
    return shop.latest_lines(lines.where(finished)), shop.latest_lines(lines.where(~finished))


@query
def upsert_merge(shop):
    """A stored run and a later batch: the batch wins whatever its shipping date."""
    stored, batch = _line_runs(shop)
    columns = ["order_id", "line_item_uid", "item_name", "quantity", "total_cents"]
    return ingest.upsert_latest(
        stored.select(*columns), batch.select(*columns, "v_l_shipdate"), columns[:2], ["v_l_shipdate"]
    )


@query
def expand_modifiers(shop):
    return shop.order_item_modifiers


@query
def ingest_ledger(shop):
    """Two runs of orders landed and loaded twice; the second load finds nothing new."""
    spark, root = shop.spark, work_dir(shop.spark, "ledger")
    orders = _landing_orders(shop)
    early = F.col("created_at") < CUTOFF
    land(orders.where(early), f"{root}/raw", "orders", "run1", "updated_at")
    land(orders.where(~early), f"{root}/raw", "orders", "run2", "updated_at")
    for _ in range(2):
        load_all(spark, f"{root}/raw", f"{root}/tables", only=["orders"], layout=YEARS)
    run = F.regexp_extract("path", "^(orders-run[0-9]+)", 1)
    return ledger(spark, f"{root}/tables").groupBy("entity", run.alias("run")).agg(F.sum("rows").alias("rows"))


@query
def table_counts(shop):
    return ingest.table_counts(shop.tables)


@query
def sales_span(shop):
    return ingest.sales_span(rollups.daily_sales(shop.orders))


@query
def retention_trim(shop):
    return ingest.table_counts(ingest.retention_trim(shop.tables, CUTOFF))


@query
def high_water_marks(shop):
    return ingest.high_water_marks(
        {
            "orders": (shop.orders, "updated_at"),
            "payments": (shop.payments, "updated_at"),
            "shifts": (shop.shifts, "start_at"),
            "weather": (shop.weather, "date"),
        }
    )


@query
def incremental_window(shop):
    rows = ingest.incremental_window(
        shop.orders, "updated_at", date(2001, 7, 31), watermark=datetime(2001, 7, 1, 12)
    )
    return rows.select("order_id", "location_id", "updated_at", "revenue_cents")


@query
def account_preview(shop):
    return ingest.account_preview(shop.orders)


# -- dimensions


@query
def calendar_days(shop):
    return shop.calendar_days


@query
def calendar_holidays(shop):
    return shop.calendar_days.where(
        (F.col("is_holiday") + F.col("is_holiday_eve") + F.col("is_day_after_holiday") + F.col("is_observance")) > 0
    ).select("date", "is_holiday", "holiday_name", "is_holiday_eve", "is_day_after_holiday", "observance")


@query
def school_break(shop):
    return dims.school_breaks(shop.school_terms)


@query
def expand_events(shop):
    return shop.events.drop("notes")


@query
def expand_promotions(shop):
    return shop.promotions.drop("notes")


# -- rollups


@query
def daily_sales(shop):
    return rollups.daily_sales(shop.orders)


@query
def daily_item_sales(shop):
    return rollups.daily_item_sales(shop.order_items, shop.catalog_variations, shop.catalog_items)


@query
def daily_labor(shop):
    return rounded(rollups.daily_labor(shop.shifts))


@query
def daily_payments(shop):
    return rollups.daily_payments(shop.payments)


@query
def daily_refunds(shop):
    return rollups.daily_refunds(shop.refunds)


@query
def daily_events(shop):
    return rollups.daily_events(shop.events)


@query
def daily_promotions(shop):
    return rollups.daily_promotions(shop.promotions)


# -- summary


@query
def daily_spine(shop):
    return summaries.daily_spine(shop.calendar_days, shop.locations, shop.orders)


@query
def customer_first_seen(shop):
    return summaries.customer_first_seen(shop.orders)


@query
def new_vs_returning(shop):
    return summaries.new_vs_returning(shop.orders)


@query
def dayparts(shop):
    return summaries.dayparts(shop.orders)


@query
def peak_hour(shop):
    return summaries.peak_hour(shop.orders)


@query
def distinct_items(shop):
    return summaries.distinct_items(shop.order_items)


@query
def daily_summary(shop):
    return rounded(summaries.daily_summary(shop.summary_tables))


@query
def daily_summary_since(shop):
    return rounded(summaries.daily_summary(shop.summary_tables, since="2000-06-15"))


# -- reads


@query
def forecast_features(shop):
    return rounded(reads.forecast_features(shop.tables))


@query
def feature_frame(shop):
    return rounded(reads.feature_frame(reads.forecast_features(shop.tables), drop_warmup=True))


@query
def prediction_rows(shop):
    return rounded(reads.prediction_rows(reads.forecast_features(shop.tables)))


@query
def latest_daily_sales(shop):
    return reads.latest_daily_sales(rollups.daily_sales(shop.orders), limit=30)


@query
def top_items(shop):
    return reads.top_items(daily_item_sales(shop), days=30, limit=20)


@query
def data_quality(shop):
    return reads.data_quality(shop.tables)


@query
def modifier_frequency(shop):
    return reads.modifier_frequency(shop.order_item_modifiers, shop.order_items)


# -- gate


@query
def validation_report(shop):
    return validate.validation_report(shop.tables, AS_OF).drop("detail")


@query
def validation_report_strict(shop):
    return validate.validation_report(shop.tables, AS_OF, strict=True).drop("detail")


@query
def zero_sales_runs(shop):
    return validate.zero_sales_runs(shop.calendar_days, rollups.daily_sales(shop.orders))


@query
def validation_isolated(shop):
    """The report without the line items: one check cannot run, thirteen do."""
    tables = {name: df for name, df in shop.tables.items() if name != "order_items"}
    return validate.checked_report(tables, AS_OF).drop("detail")


@query
def outlier_days(shop):
    return validate.outlier_days(rollups.daily_sales(shop.orders), sigma=3.0)


# -- features


def _summary(shop: SampleShop) -> DataFrame:
    """The summary as a stored table: feature building reads it several times."""
    return materialize(summaries.daily_summary(shop.summary_tables), "summary")


def _rows(shop: SampleShop) -> DataFrame:
    return splits.feature_table(shop.tables, _summary(shop))


def _scaled(shop: SampleShop) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = _rows(shop)
    columns = features.feature_columns(rows.columns)
    scaled = splits.apply_scaler(rows, splits.fit_scaler(rows, columns), columns)
    return rows, materialize(scaled, "dataset"), columns


@query
def feature_source(shop):
    return rounded(features.feature_source(shop.tables, _summary(shop)))


@query
def cyclical_features(shop):
    dates = shop.calendar_days.select("date", "day_of_week", "month", "day_of_year")
    return rounded(features.cyclical_features(dates))


@query
def holiday_distance(shop):
    dates = shop.calendar_days.select(F.col("date").alias("business_date"), "is_holiday")
    return features.holiday_distance(dates)


def _engineered(shop: SampleShop) -> DataFrame:
    return features.engineered(shop.tables, _summary(shop))


@query
def lag_features(shop):
    return rounded(
        _engineered(shop).select(
            "business_date", "location_id", *[f"sales_lag_{n}" for n in features.SALES_LAGS], "orders_lag_1",
            "orders_lag_7", "customers_lag_1", "customers_lag_7", "avg_ticket_lag_7", "labor_hours_lag_7",
        )
    )


@query
def rolling_features(shop):
    return rounded(
        _engineered(shop).select(
            "business_date", "location_id", "sales_roll_mean_7", "sales_roll_mean_28", "sales_roll_std_7",
            "sales_roll_max_7", "same_dow_mean_4", "momentum_7_28",
        )
    )


@query
def interaction_features(shop):
    return rounded(
        _engineered(shop).select(
            "business_date", "location_id", "rain_x_weekend", "promotion_active", "promo_x_weekend",
            "temp_vs_normal_f", "days_since_start",
        )
    )


@query
def feature_table(shop):
    return rounded(_rows(shop))


@query
def split_sizes(shop):
    return splits.split_sizes(features.complete_rows(_engineered(shop)))


@query
def time_split(shop):
    return _rows(shop).select("business_date", "location_id", "split")


@query
def scaler_stats(shop):
    rows = _rows(shop)
    return rounded(splits.fit_scaler(rows, features.feature_columns(rows.columns)))


@query
def scaled_features(shop):
    _, scaled, columns = _scaled(shop)
    return rounded(scaled.select("business_date", "location_id", "split", *columns))


@query
def unscaled_features(shop):
    """Scaling undone: the original values come back."""
    rows = _rows(shop)
    columns = features.feature_columns(rows.columns)
    stats = splits.fit_scaler(rows, columns)
    back = splits.unscale(splits.apply_scaler(rows, stats, columns), stats, columns)
    return rounded(back.select("business_date", "location_id", "sales_lag_1", "sales_roll_mean_28", "temp_max_f"), 3)


@query
def feature_manifest(shop):
    return splits.feature_manifest(_rows(shop))


@query
def feature_payload(shop):
    """The JSON payload, read back."""
    rows = _rows(shop)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in features.feature_columns(rows.columns))
    stored = splits.feature_payload(rows)
    return stored.withColumn("p", F.from_json("payload", schema)).select(
        "business_date", "location_id", "split", features.TARGET, "p.sales_lag_1", "p.sales_roll_mean_7",
        "p.temp_max_f", "p.dow_sin", "p.is_holiday", "p.days_to_holiday",
    )


# -- forecast


@query
def feature_contract(shop):
    rows = _rows(shop)
    columns = features.feature_columns(rows.columns)
    return splits.feature_contract(rows, columns, splits.fit_scaler(rows, columns))


@query
def target_scaler(shop):
    return rounded(forecast.target_scaler(_rows(shop)))


@query
def baseline_predictions(shop):
    return rounded(forecast.baseline_predictions(_rows(shop)))


def _scores(rows: DataFrame) -> DataFrame:
    return forecast.score(forecast.baseline_predictions(rows))


@query
def baseline_scores(shop):
    return _scores(_rows(shop))


@query
def baseline_verdict(shop):
    return forecast.verdict(_scores(_rows(shop)), "baseline_rolling_7")


@query
def residual_band(shop):
    return rounded(forecast.residual_band(_rows(shop), predicted_col=ROLLING_7))


@query
def forecast_rows(shop):
    rows = _rows(shop)
    return forecast.forecast_rows(rows, ROLLING_7, forecast.residual_band(rows, predicted_col=ROLLING_7))


@query
def next_day_forecast(shop):
    rows = _rows(shop)
    return forecast.next_day_forecast(rows, ROLLING_7, forecast.residual_band(rows, predicted_col=ROLLING_7))


@query
def forecast_history(shop):
    return forecast.forecast_history(_rows(shop), ROLLING_7, days=30)


@query
def test_metrics(shop):
    scores = _scores(_rows(shop))
    return forecast.test_metrics(scores, forecast.verdict(scores, "baseline_rolling_7"), "baseline_rolling_7")


@query
def model_predictions(shop):
    """Ridge regression on all features, the penalty chosen on the validation split."""
    _, scaled, columns = _scaled(shop)
    predicted = ridge.predict(ridge.fit_path(scaled, columns), scaled)
    return predicted.select("business_date", "location_id", "split", features.TARGET, "predicted")


RIDGE_COLUMNS = ["sales_lag_7", "sales_roll_mean_7"]


def _ridge(shop: SampleShop) -> tuple[DataFrame, DataFrame, ridge.Ridge]:
    """Rows, scaled rows, and the fit on two features, whose equations SQL can solve."""
    rows, scaled, _ = _scaled(shop)
    return rows, scaled, ridge.fit_path(scaled, RIDGE_COLUMNS)


def _ridge_scores(shop: SampleShop) -> DataFrame:
    rows, scaled, model = _ridge(shop)
    guess = ridge.predict(model, scaled).select(*rollups.DAY, "predicted")
    named = forecast.BASELINES | {"model": "predicted"}
    return materialize(forecast.score(forecast.baseline_predictions(rows.join(guess, rollups.DAY), named)), "scores")


@query
def ridge_path(shop):
    """Every penalty with its error on train and validation; the best on validation is chosen."""
    _, scaled, model = _ridge(shop)
    return rounded(ridge.path_table(scaled, model), 6).withColumn("penalty", F.col("penalty"))


@query
def ridge_predictions(shop):
    _, scaled, model = _ridge(shop)
    return ridge.predict(model, scaled).select(
        "business_date", "location_id", "split", features.TARGET, F.round("predicted", 2).alias("predicted")
    )


@query
def ridge_scores(shop):
    """The model beside both baselines on every split."""
    return _ridge_scores(shop)


@query
def model_verdict(shop):
    return forecast.verdict(_ridge_scores(shop), "model")


@query
def model_metrics(shop):
    scores = _ridge_scores(shop)
    return forecast.test_metrics(scores, forecast.verdict(scores, "model"), "model")


@query
def ridge_uncertainty(shop):
    """A hundred bootstrap refits from one pass over the train rows."""
    _, scaled, _ = _scaled(shop)
    return ridge.forecast_uncertainty(scaled, RIDGE_COLUMNS).select(
        "business_date", "location_id", F.round("model_uncertainty", 2).alias("model_uncertainty")
    )


@query
def ridge_explanation(shop):
    """What moved the next day's forecast."""
    rows, scaled, model = _ridge(shop)
    chosen = forecast.next_day_rows(rows).select(*rollups.DAY)
    part = [df.join(chosen, rollups.DAY, "left_semi") for df in (scaled, rows)]
    return forecast.explain(model.slopes, *part, RIDGE_COLUMNS).select("name", "direction", "contribution")


@query
def forecast_uncertainty(shop):
    _, scaled, columns = _scaled(shop)
    return models.forecast_uncertainty(scaled, columns).select(
        "business_date", "location_id", F.round("model_uncertainty", 2).alias("model_uncertainty")
    )


@query
def explain_forecast(shop):
    """What moved the forecast of the next day, over the locations that trade."""
    rows, scaled, columns = _scaled(shop)
    chosen = forecast.next_day_rows(rows).select(*rollups.DAY)
    part = [df.join(chosen, rollups.DAY, "left_semi") for df in (scaled, rows)]
    return forecast.explain(ridge.fit_path(scaled, columns).slopes, *part, columns)


# -- streaming


def _landing_orders(shop: SampleShop) -> DataFrame:
    stamps = ("created_at", "updated_at", "closed_at")
    return shop.orders_undated.drop("upstream_status", "upstream_priority", "k").withColumns(
        {c: payloads.stamp(c) for c in stamps}
    )


def _stream_orders(shop: SampleShop, summary: bool = False) -> tuple[str, EntitySpec]:
    """Orders landed as a first state and a later correction, streamed into tables."""
    root, spec = work_dir(shop.spark, "stream"), BY_ENTITY["orders"]
    orders = _landing_orders(shop)
    # The first run knows every order at half its revenue and a day early; the second corrects it.
    early = orders.withColumns(
        {
            "revenue_cents": F.floor(F.col("revenue_cents") / 2).cast("bigint"),
            "created_at": F.date_format(F.date_sub("created_at", 1), payloads.RFC),
        }
    )
    others = None
    if summary:
        # Both runs read the line items, so these are deduplicated once; the summary takes the names sold on a day.
        items = materialize(shop.order_items.select(*rollups.DAY, "item_name"), "order-items")
        others = lambda: {**shop.tables, "order_items": items}
    for run, rows in (("run1", early), ("run2", orders)):
        land(rows, f"{root}/raw", "orders", run)
        ingest_orders(shop.spark, f"{root}/raw", f"{root}/tables", spec, shop.zones, layout=YEARS, others=others)
    return f"{root}/tables", spec


@query
def stream_ingest(shop):
    tables, spec = _stream_orders(shop)
    stored = read_parts(shop.spark, f"{tables}/orders", list(spec.keys)).drop(PART_KEY)
    return stored.select("order_id", "location_id", "business_date", "business_hour", "state", "revenue_cents",
                         "net_sales_cents", "customer_id", "item_quantity")


@query
def stream_upsert(shop):
    """Line versions streamed as two runs: the later run wins."""
    root, spec = work_dir(shop.spark, "stream"), BY_ENTITY["order_items"]
    for name, run in zip(("run1", "run2"), _line_runs(shop)):
        rows = run.withColumn("created_at", payloads.stamp("created_at"))
        land(rows.drop(*[f"v_{c}" for c in shop.LINE_VERSION]), f"{root}/raw", "order_items", name)
        run_ingest(shop.spark, f"{root}/raw", f"{root}/tables", spec, shop.zones, layout=YEARS)
    stored = read_parts(shop.spark, f"{root}/tables/order_items", list(spec.keys))
    return stored.select("order_id", "line_item_uid", "item_name", "quantity", "total_cents")


@query
def stream_daily_sales(shop):
    tables, _ = _stream_orders(shop)
    return current_daily_sales(shop.spark, tables)


@query
def stream_first_seen(shop):
    """First days kept as a table through two runs, of which the second moves every order by a day."""
    tables, _ = _stream_orders(shop, summary=True)
    return stored_first_seen(shop.spark, tables)


@query
def stream_daily_summary(shop):
    """The summary kept fresh through the same two runs."""
    tables, _ = _stream_orders(shop, summary=True)
    return rounded(read_summary(shop.spark, tables))


@query
def retention_stored(shop):
    """Orders per year in a stored table after its old partitions were dropped."""
    root, spec = work_dir(shop.spark, "retention"), BY_ENTITY["orders"]
    keys = list(spec.keys)
    merge_parts(shop.spark, f"{root}/orders", shop.orders.drop("k"), keys, YEARS)
    trim_parts(shop.spark, f"{root}/orders", keys, date.fromisoformat(CUTOFF), YEARS)
    kept = read_parts(shop.spark, f"{root}/orders", keys)
    return kept.groupBy(F.year("business_date").alias("order_year")).agg(F.count(F.lit(1)).alias("orders"))


@query
def quarantine_lines(shop):
    """Orders landed with lines that are cut short and records without a key, loaded twice."""
    spark, root, spec = shop.spark, work_dir(shop.spark, "rejected"), BY_ENTITY["orders"]
    k = F.col("k")
    orders = shop.orders_undated.select("k", "order_id", "location_id", "revenue_cents", "customer_id")
    body = F.to_json(F.struct(F.when(k % 89 != 0, F.col("order_id")).alias("order_id"), "location_id", "revenue_cents"))
    text = F.when(k % 97 == 0, F.expr("left(body, length(body) - 9)")).otherwise(F.col("body"))
    orders.withColumn("body", body).select(text.alias("value")).write.text(f"{root}/raw/orders/orders-run1.jsonl")
    for _ in range(2):
        load_all(spark, f"{root}/raw", f"{root}/tables", only=[spec.entity], force=True, layout=YEARS)
    return read_rejected(spark, f"{root}/tables", "orders").groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query
def attach_business_day(shop):
    """Trading days of shifts, decided by their start."""
    return business_day(
        shop.shifts.select("shift_id", "location_id", "start_at"), shop.zones, "start_at"
    ).select("shift_id", "business_date", "business_hour")

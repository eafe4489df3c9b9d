"""Dimensions, normalizers, rollups, summary, gate and features: known answers on tiny inputs."""

import math
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.functions.quantiles import exact_quantiles
from tillcast.functions.ranks import with_rows_before
from tillcast.operators import dims, features, forecast, normalize, reads, rollups, splits, validate
from tillcast.operators import summary as summaries
from tillcast.schemas import CATALOG_PAYLOAD, ORDER_PAYLOAD, SHIFT_PAYLOAD

START = date(2026, 4, 1)
DAYS = 70


def day(n: int) -> date:
    return START + timedelta(days=n)


@pytest.fixture(scope="module")
def shop(spark):
    """Seventy days at one location, day 31 closed, busier weekends, one regular and a new guest a day."""
    orders, items = [], []
    for n in range(DAYS):
        if n == 31:
            continue
        for i in range(8 if day(n).isoweekday() >= 6 else 4):
            oid, guest = f"o{n}-{i}", "regular" if i == 0 else (f"new{n}" if i == 1 else None)
            orders.append((oid, "L1", day(n), 12 if i % 2 == 0 else 19, "COMPLETED", 1200 + n, 100, 100, 0, 0,
                           1000 + n, "PICKUP" if i == 0 else None, guest, 1.0))
            items.append((oid, "1", "L1", day(n), "V1", f"Dish {i % 3}", 1.0, 1000))
    orders.append(("void", "L1", day(5), 12, "CANCELED", 99999, 0, 0, 0, 0, 99999, None, "ghost", 1.0))
    holidays = spark.createDataFrame([(date(2026, 5, 25), "Memorial"), (date(2026, 4, 20), "Local")], "date date, name string")
    terms = spark.createDataFrame(
        [("first", date(2026, 6, 1), date(2026, 6, 30), 1), ("second", date(2026, 6, 5), date(2026, 6, 10), 2)],
        "label string, start_date date, end_date date, ordinal int",
    )
    calendar = dims.calendar_days(dims.date_span(spark, START, day(DAYS + 13)), holidays, terms)
    weather = calendar.select(
        "date", F.lit("archive").alias("source"), *[F.lit(50.0).alias(c) for c in reads.VIEW_WEATHER[:9]],
        *[F.lit(0).alias(c) for c in reads.VIEW_WEATHER[9:]],
    )
    return {
        "orders": spark.createDataFrame(
            orders,
            "order_id string, location_id string, business_date date, business_hour int, state string, "
            "revenue_cents long, tax_cents long, tip_cents long, discount_cents long, service_charge_cents long, "
            "net_sales_cents long, fulfillment_type string, customer_id string, item_quantity double",
        ),
        "order_items": spark.createDataFrame(
            items,
            "order_id string, line_item_uid string, location_id string, business_date date, catalog_object_id string, "
            "item_name string, quantity double, total_cents long",
        ),
        "locations": spark.createDataFrame([("L1", "ACTIVE", "America/New_York")], "location_id string, status string, timezone string"),
        "calendar_days": calendar,
        "weather": weather,
        "events": spark.createDataFrame([], "date date, name string, category string, expected_attendance long, distance_miles double"),
        "promotions": spark.createDataFrame([], "date date, name string, channel string, discount_type string, discount_value double, spend_usd double"),
        "payments": spark.createDataFrame([], "payment_id string, order_id string, location_id string, business_date date, status string, amount_cents long, source_type string, card_brand string, processing_fee_cents long"),
        "refunds": spark.createDataFrame([("r", "L1", day(3), 400)], "refund_id string, location_id string, business_date date, amount_cents long"),
        "shifts": spark.createDataFrame([("s", "t", "L1", day(3), 6.0, 9000)], "shift_id string, team_member_id string, location_id string, business_date date, hours double, labor_cost_cents long"),
    }


@pytest.fixture(scope="module")
def summary(shop):
    return summaries.daily_summary(shop).cache()


def test_summary_is_dense_and_closed_day_is_zero(summary):
    rows = {r.business_date: r for r in summary.collect()}
    assert len(rows) == DAYS
    closed = rows[day(31)]
    assert (closed.is_closed, closed.order_count, closed.net_sales_cents, closed.peak_hour) == (1, 0, 0, None)
    assert sum(r.is_closed for r in rows.values()) == 1


def test_new_and_returning_customers(summary):
    rows = {r.business_date: r for r in summary.collect()}
    first, second = rows[day(0)], rows[day(1)]
    assert (first.customer_count, first.new_customer_count, first.returning_customer_count) == (2, 2, 0)
    assert (second.customer_count, second.new_customer_count, second.returning_customer_count) == (2, 1, 1)


def test_dayparts_peak_and_ratios(summary):
    r = {x.business_date: x for x in summary.collect()}[day(3)]  # a Saturday
    assert (r.order_count, r.lunch_orders, r.dinner_orders, r.late_orders, r.peak_hour) == (8, 4, 4, 0, 12)
    net = 8 * 1003
    assert (r.net_sales_cents, r.sales_per_labor_hour_cents) == (net, net // 6)
    assert r.refund_rate_bps == int(400 / net * 10_000) and r.labor_cost_ratio_bps == int(9000 / net * 10_000)


def test_summary_matches_sales_and_since(shop, summary):
    assert summary.agg(F.sum("net_sales_cents")).first()[0] == (
        shop["orders"].where("state <> 'CANCELED'").agg(F.sum("net_sales_cents")).first()[0]
    )
    tail = summaries.daily_summary(shop, since=day(40)).collect()
    assert sorted(map(str, tail)) == sorted(map(str, summary.where(F.col("business_date") >= day(40)).collect()))


def test_canceled_order_of_last_day_extends_spine(spark, shop):
    late = shop["orders"].where("order_id = 'void'").withColumn("business_date", F.lit(day(DAYS + 2)))
    spine = summaries.daily_spine(shop["calendar_days"], shop["locations"], shop["orders"].unionByName(late))
    assert spine.count() == DAYS + 3


def test_hot_customer_and_hot_order_counts(spark):
    rows = spark.range(0, 900).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("customer_id"),
        (F.col("id") % 4).cast("string").alias("location_id"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("business_date"),
        F.lit("COMPLETED").alias("state"),
    )
    local = rows.toPandas()
    first = local.groupby("customer_id").business_date.min()
    want = {}
    for (d, loc), g in local.groupby(["business_date", "location_id"]):
        ids = set(g.customer_id)
        want[(d, loc)] = (len(ids), sum(first[c] == d for c in ids))
    got = {
        (r.business_date, r.location_id): (r.customer_count, r.new_customer_count)
        for r in summaries.new_vs_returning(rows).collect()
    }
    assert got == want
    facts = rows.select(F.when(F.col("customer_id") == "hot", "lost").otherwise(F.col("order_id")).alias("order_id"))
    assert reads.orphan_count(facts, rows).first()[0] == 300


def test_calendar_rules(shop):
    rows = {r.date: r for r in shop["calendar_days"].collect()}
    memorial = date(2026, 5, 25)
    assert rows[memorial].is_holiday == 1 and rows[memorial - timedelta(1)].is_holiday_eve == 1
    assert rows[memorial + timedelta(1)].is_day_after_holiday == 1
    assert rows[date(2026, 6, 6)].school_break == "first" and rows[date(2026, 5, 31)].is_month_end == 1
    assert rows[date(2026, 5, 5)].observance == "Cinco de Mayo"
    for d, r in rows.items():
        assert (r.day_of_week, r.week_of_year, r.day_name) == (d.isoweekday(), d.isocalendar().week, d.strftime("%A"))


def test_event_expansion(spark):
    d = date(2026, 8, 19)
    listed = spark.createDataFrame(
        [("fair", d, d + timedelta(4)), ("one", d, None), ("undated", None, d), ("reversed", d, d - timedelta(1)),
         ("early", d - timedelta(3), d), ("late", d + timedelta(9), d + timedelta(30))],
        "name string, start_date date, end_date date",
    ).withColumns({c: F.lit(None).cast("string") for c in ("category", "venue", "start_time", "notes")}).withColumns(
        {"distance_miles": F.lit(1.0), "expected_attendance": F.lit(5).cast("bigint")}
    )
    first, last = F.lit(d), F.lit(d + timedelta(10))
    rows = dims.expand_events(listed, first, last).collect()
    by_name = {}
    for r in rows:
        by_name.setdefault(r.name, []).append((r.day_index, r.is_multi_day))
    assert sorted(by_name["fair"]) == [(i, 1) for i in range(5)]
    assert by_name["one"] == [(0, 0)] and by_name["early"] == [(3, 1)]
    assert sorted(by_name["late"]) == [(0, 1), (1, 1)] and set(by_name) == {"fair", "one", "early", "late"}


def test_weather_flags(spark):
    rows = spark.createDataFrame(
        [(0, 0.0, 0.0), (61, 0.4, 0.0), (73, 0.2, 1.5), (95, 0.8, 0.0), (None, None, None)],
        "weather_code int, precipitation_in double, snowfall_in double",
    )
    got = [(r.is_rainy, r.is_snowy, r.is_stormy) for r in normalize.weather_flags(rows).collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 0, 1), (0, 0, 0)]


def test_normalize_order_and_shift(spark):
    text = """{"id": "O1", "location_id": "L", "state": "COMPLETED", "total_money": {"amount": 5432, "currency": "USD"},
      "total_tax_money": {"amount": 432}, "total_tip_money": {"amount": 800}, "tenders": [{"type": "CASH"}, {"type": "CARD"}, {"type": "CARD"}, {}],
      "fulfillments": [{"type": "PICKUP", "pickup_details": {"recipient": {"customer_id": "CUST9"}}}],
      "line_items": [{"uid": "a", "quantity": "2"}, {"uid": "b", "quantity": "3", "modifiers": [{"uid": "m", "name": "Hot", "base_price_money": {"amount": 50}}, {"uid": "n"}]}]}"""
    lines = spark.createDataFrame([(text.replace("\n", " "),), ('{"id": "empty"}',)], "value string")
    payload = lines.select(F.inline(F.array(F.from_json("value", ORDER_PAYLOAD))))
    rows = {r.order_id: r for r in normalize.normalize_orders(payload).collect()}
    full, empty = rows["O1"], rows["empty"]
    assert (full.revenue_cents, full.net_sales_cents, full.customer_id, full.item_quantity) == (5432, 4200, "CUST9", 5.0)
    assert full.payment_types == ["CARD", "CASH"] and full.tender_count == 4 and full.fulfillment_type == "PICKUP"
    assert (empty.revenue_cents, empty.tip_cents, empty.payment_types, empty.line_item_count) == (0, 0, [], 0)
    items = {r.line_item_uid: r for r in normalize.normalize_order_items(payload).collect()}
    assert items["b"].line_number == 1 and items["b"].modifier_names == ["Hot"] and items["b"].modifiers[0].price_cents == 50
    shift = spark.createDataFrame(
        [('{"id": "s", "start_at": "2026-08-01T16:00:00Z", "end_at": "2026-08-01T22:30:00Z", "wage": {"hourly_rate": {"amount": 1501}}}',),
         ('{"id": "open", "start_at": "2026-08-01T16:00:00Z"}',)], "value string",
    ).select(F.inline(F.array(F.from_json("value", SHIFT_PAYLOAD))))
    hours = {r.shift_id: (r.hours, r.labor_cost_cents) for r in normalize.normalize_shifts(shift).collect()}
    assert hours == {"s": (6.5, round(1501 * 6.5)), "open": (0.0, 0)}


def test_gate_passes_and_blocks(spark, shop):
    report = {r.name: r for r in validate.validation_report(shop, day(DAYS)).collect()}
    assert len(report) == 14
    assert all(r.passed == 1 for r in report.values()), [n for n, r in report.items() if not r.passed]
    broken = dict(shop)
    broken["orders"] = shop["orders"].withColumn(
        "net_sales_cents", F.when(F.col("order_id") == "o0-0", -5).otherwise(F.col("net_sales_cents"))
    )
    with pytest.raises(validate.DataQualityError, match="totals reconcile"):
        validate.raise_if_blocked(validate.validation_report(broken, day(DAYS)))
    short = dict(shop)
    short["orders"] = shop["orders"].where(F.col("business_date") < day(20))
    validate.raise_if_blocked(validate.validation_report(short, day(DAYS)))
    with pytest.raises(validate.DataQualityError, match="history length"):
        validate.raise_if_blocked(validate.validation_report(short, day(DAYS), strict=True))
    gap = dict(shop)
    gap["calendar_days"] = shop["calendar_days"].where(F.col("date") != day(10))
    failed = {r.name for r in validate.validation_report(gap, day(DAYS)).where("passed = 0").collect()}
    assert {"calendar coverage", "calendar continuity"} <= failed


def test_zero_sales_run_lengths(spark, shop):
    orders = shop["orders"].where(~F.col("business_date").between(day(20), day(23)))
    runs = validate.zero_sales_runs(shop["calendar_days"], reads.daily_sales(orders)).collect()
    assert {(r.run_start, r.days) for r in runs} == {(day(20), 4), (day(31), 1)}


def test_feature_view_history(shop):
    view = {r.business_date: r for r in reads.forecast_features(shop).collect()}
    assert len(view) == DAYS + 14 and sum(r.is_observed for r in view.values()) == DAYS
    assert view[day(0)].sales_lag_1_cents is None and view[day(DAYS)].target_sales_cents is None
    past = [view[day(n)].target_sales_cents for n in range(43, 50)]
    assert view[day(50)].sales_avg_7_cents == sum(past) // 7
    assert view[day(31)].target_sales_cents == 0
    whole = reads.forecast_features(shop)
    assert reads.feature_frame(whole, "L1", drop_warmup=True).count() == DAYS - 14
    assert reads.feature_frame(whole, "elsewhere").count() == 0
    assert reads.feature_frame(whole, observed_only=False).count() == DAYS + 14
    assert reads.prediction_rows(whole, "L1").count() == 14


@pytest.fixture(scope="module")
def rows(shop, summary):
    return splits.feature_table(shop, summary).cache()


def test_feature_table(rows, summary):
    columns = features.feature_columns(rows.columns)
    assert len(columns) == 68
    spans = {r.split: r for r in splits.split_spans(rows).collect()}
    assert spans["train"].last_date < spans["val"].first_date and spans["val"].last_date < spans["test"].first_date
    assert spans["future"].rows == 1 and spans["future"].first_date == day(DAYS)
    stats = {r.feature: r for r in splits.fit_scaler(rows, columns).collect()}
    train = [r.sales_lag_1 for r in rows.where("split = 'train'").collect()]
    assert math.isclose(stats["sales_lag_1"].mean, statistics.mean(train))
    assert math.isclose(stats["sales_lag_1"].std, statistics.stdev(train))
    assert stats["temp_max_f"].std == 1.0 and "is_weekend" not in stats
    assert all(r.passed for r in splits.feature_contract(rows, columns, splits.fit_scaler(rows, columns)).collect())
    leaky = splits.feature_contract(rows, [*columns, "net_sales_cents"]).where("passed = 0").collect()
    assert [r.rule for r in leaky] == ["no outcome of the same day"]


def test_rolling_values(rows, summary):
    net = {r.business_date: r.net_sales_cents for r in summary.collect()}
    r = rows.where(F.col("business_date") == day(45)).first()
    week = [net[day(n)] for n in range(38, 45)]
    assert math.isclose(r.sales_roll_mean_7, statistics.mean(week)) and r.sales_roll_max_7 == max(week)
    assert math.isclose(r.sales_roll_std_7, statistics.stdev(week))
    assert math.isclose(r.same_dow_mean_4, (net[day(38)] + net[day(31)] + net[day(17)]) / 3)


def test_no_leakage(shop, rows):
    """Changing the sales of a day moves nothing on that day or before it."""
    target = day(50)
    bumped = dict(shop)
    bumped["orders"] = shop["orders"].withColumn(
        "net_sales_cents",
        F.when(F.col("business_date") == target, F.col("net_sales_cents") + 777).otherwise(F.col("net_sales_cents")),
    )
    again = features.complete_rows(features.engineered(bumped, summaries.daily_summary(bumped)))
    columns = ["business_date", *features.feature_columns(again.columns)]
    upto = F.col("business_date") <= target
    assert sorted(map(str, again.where(upto).select(*columns).collect())) == sorted(
        map(str, rows.where(upto).select(*columns).collect())
    )
    assert again.where(~upto).select(*columns).subtract(rows.select(*columns)).count() > 0
    with pytest.raises(features.LeakageError):
        features.assert_no_leakage(["sales_lag_1", "order_count"])


@pytest.mark.parametrize("days,val,test,want", [(60, 0, 0, (9, 9)), (10, 0, 0, (7, 7)), (1000, 0, 0, (28, 28)), (500, 28, 28, (28, 28)), (60, 5, 0, (5, 9))])
def test_split_sizes(spark, days, val, test, want):
    frame = spark.range(days).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("business_date"), F.lit(0).alias("is_future"))
    r = splits.split_sizes(frame, val, test).first()
    assert (r.observed_days, r.val_days, r.test_days) == (days, *want)


def test_holiday_distance_against_brute_force(spark):
    marks = {3, 4, 150, 400}
    frame = spark.range(520).select(
        F.date_add(F.lit(START), F.col("id").cast("int")).alias("business_date"),
        F.col("id").isin(*marks).cast("int").alias("is_holiday"),
    )
    for r in features.holiday_distance(frame).collect():
        n = (r.business_date - START).days
        nxt = min((m - n for m in marks if m >= n), default=99)
        since = min((n - m for m in marks if m < n), default=99)
        assert (r.days_to_holiday, r.days_since_holiday) == (min(nxt, 99), min(since, 99))


@pytest.mark.parametrize("n", [1, 2, 9, 95, 100, 101, 2000])
def test_exact_quantiles(spark, n):
    values = [float((i * 7919) % 613) for i in range(n)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(frame, "v", [0.1, 0.5, 0.9]).first()
    assert np.allclose(got[1:], np.quantile(values, [0.1, 0.5, 0.9])) and got.n == len(values)
    assert tuple(exact_quantiles(frame.where("v < -1"), "v", [0.1]).first()) == (0, None)


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 17 == 0 else int(rng.integers(0, 40)) ** 3, 1 + i % 3) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, v long, k int")
    for descending in (False, True):
        order = sorted(rows, key=lambda r: (r[1] is None, (-1 if descending else 1) * (r[1] or 0), r[0]))
        got = {r.id: r.before for r in with_rows_before(frame, "v", [F.col("id")], descending=descending).collect()}
        assert got == {r[0]: at for at, r in enumerate(order)}
        sums = np.cumsum([0] + [r[2] for r in order])
        counted = with_rows_before(frame, "v", [F.col("id")], count="k", descending=descending)
        assert {r.id: r.before for r in counted.collect()} == {r[0]: sums[at] for at, r in enumerate(order)}
    assert with_rows_before(frame.where("false"), "v").count() == 0


def test_scores(spark):
    frame = spark.createDataFrame(
        [("a", 10000, 11000.0), ("a", 20000, 19000.0), ("b", 0, 5000.0), ("b", 10000, 11000.0), ("c", 0, 1.0)],
        "split string, actual long, predicted double",
    )
    got = {r.split: r for r in forecast.score(frame, by=("split",)).collect()}
    assert got["a"].mae_dollars == 10.0 and got["b"].mape_percent == 10.0 and got["c"].mape_percent is None


def test_confidence(spark):
    frame = spark.createDataFrame([(10000.0, -50.0, 50.0), (1000.0, -500.0, 500.0), (100.0, -5000.0, 5000.0), (-5.0, 0.0, 1.0)], "p double, lo double, hi double")
    got = [r.c for r in frame.select(forecast.confidence(F.col("p"), F.col("lo"), F.col("hi")).alias("c")).collect()]
    assert got[0] > 0.98 and got[1:] == [0.0, 0.0, 0.0]


def test_next_day_forecast_sums_trading_locations(spark):
    d = date(2026, 8, 2)
    base = {"split": "future", "is_future": 1}
    frame = spark.createDataFrame(
        [(d, "a", 10000.0, 500.0, 90.0), (d, "b", 20000.0, 50.0, 80.0), (d, "shut", 700.0, 500.0, 0.0), (d + timedelta(1), "a", 1.0, 500.0, 1.0)],
        "business_date date, location_id string, p double, avg_ticket_lag_7 double, sales_roll_mean_28 double",
    ).withColumns({k: F.lit(v) for k, v in base.items()} | {c: F.lit(100.0) for c in forecast.CONTEXT[:3]})
    band = spark.createDataFrame([(-1000.0, 2000.0)], "low double, high double")
    r = forecast.next_day_forecast(frame, "p", band).first()
    assert (r.business_date, r.predicted_sales, r.interval_low, r.interval_high, r.locations) == (d, 300.0, 280.0, 340.0, 2)
    assert (r.confidence, r.estimated_orders) == (0.8, 20)
    none_trade = frame.withColumn("sales_roll_mean_28", F.lit(0.0))
    assert forecast.next_day_forecast(none_trade, "p", band).first().locations == 3


def test_an_empty_pickup_recipient_does_not_hide_the_delivery_recipient(spark):
    line = (
        '{"id": "o1", "fulfillments": [{"pickup_details": {"recipient": {}},'
        ' "delivery_details": {"recipient": {"customer_id": "c7"}}}]}'
    )
    payload = spark.createDataFrame([(line,)], "value string").select(F.from_json("value", ORDER_PAYLOAD).alias("p"))
    assert normalize.normalize_orders(payload.select("p.*")).first().customer_id == "c7"


def test_a_category_listed_twice_keeps_each_item_once(spark):
    lines = [
        '{"type": "CATEGORY", "id": "k", "version": 1, "category_data": {"name": "old"}}',
        '{"type": "CATEGORY", "id": "k", "version": 2, "category_data": {"name": "new"}}',
        '{"type": "ITEM", "id": "i", "version": 1, "item_data": {"name": "tea", "category_id": "k"}}',
    ]
    payload = spark.createDataFrame([(x,) for x in lines], "value string").select(
        F.from_json("value", CATALOG_PAYLOAD).alias("p")
    )
    rows = normalize.normalize_catalog(payload.select("p.*")).collect()
    assert [(r.catalog_object_id, r.category_name) for r in rows] == [("i", "new")]


def test_daily_sales_groups_customers_apart_from_the_sums(spark):
    day = date(2026, 1, 1)
    rows = [(day, place, who, "COMPLETED", 100) for place in ("L1", None) for who in ("a", "a", "b", None)]
    rows += [(day, "L2", None, "COMPLETED", 5), (day, "L1", "c", "CANCELED", 1), (None, "L1", "d", "COMPLETED", 1)]
    cents = ["revenue_cents", "net_sales_cents", "discount_cents", "tax_cents", "tip_cents", "service_charge_cents"]
    orders = spark.createDataFrame(rows, "business_date date, location_id string, customer_id string, state string, cents bigint")
    orders = orders.select("*", *[F.col("cents").alias(c) for c in cents], F.lit(1.0).alias("item_quantity"),
                           F.lit(None).cast("string").alias("fulfillment_type"))
    daily = rollups.daily_sales(orders)
    got = {(r.location_id, r.order_count, r.revenue_cents, r.known_customer_count) for r in daily.collect()}
    assert got == {("L1", 4, 400, 2), (None, 4, 400, 2), ("L2", 1, 5, 0)} and daily.columns[-1] == "known_customer_count"
    assert "distinct" not in daily._jdf.queryExecution().optimizedPlan().toString().lower()

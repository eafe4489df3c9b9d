"""The same queries as SQL for the second engine. Model fits have no SQL form and are left out."""

from __future__ import annotations

from tillcast.plans import oracle_models
from tillcast.plans.oracle_tables import CONTEXT, PARTS, with_parts


def _rounded(source: str, columns: str, digits: int = 4) -> str:
    swaps = ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())
    return f"select * replace ({swaps}) from {source}"


# The 68 inputs.
INPUTS = (
    "day_of_year", *CONTEXT,
    "event_count", "event_attendance", "sports_events", "nearest_event_miles",
    "promotion_count", "promotion_spend_usd", "max_percent_off", "has_facebook_ads", "has_delivery_promo",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos", "days_to_holiday", "days_since_holiday",
    "sales_lag_1", "sales_lag_2", "sales_lag_3", "sales_lag_7", "sales_lag_14", "sales_lag_28",
    "orders_lag_1", "orders_lag_7", "customers_lag_1", "customers_lag_7", "avg_ticket_lag_7", "labor_hours_lag_7",
    "sales_roll_mean_7", "sales_roll_mean_28", "sales_roll_std_7", "sales_roll_max_7",
    "same_dow_mean_4", "momentum_7_28",
    "rain_x_weekend", "promotion_active", "promo_x_weekend", "temp_vs_normal_f", "days_since_start",
)
_FLOATS = (
    "labor_hours_lag_7 sales_roll_mean_7 sales_roll_mean_28 sales_roll_std_7 same_dow_mean_4 momentum_7_28 "
    "dow_sin dow_cos month_sin month_cos doy_sin doy_cos temp_vs_normal_f labor_hours item_count"
)
_SCALED = [c for c in INPUTS if not c.startswith(("is_", "has_", "promotion_active"))]
_RFC = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

_STATS = "\nunion all\n".join(
    f"select '{c}' feature, round(avg({c}), 4) mean, round(case when stddev_samp({c}) > 1e-9 "
    f"then stddev_samp({c}) else 1 end, 4) std from f_rows where split = 'train'"
    for c in _SCALED
)
_SCALE_FIT = ", ".join(
    f"avg({c}) m_{c}, case when stddev_samp({c}) > 1e-9 then stddev_samp({c}) else 1 end s_{c}" for c in _SCALED
)
_SCALED_COLUMNS = ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 4) as {c}" if c in _SCALED else c for c in INPUTS
)

_LINES = """(select k, i, cast(k as varchar) order_id, location_id, created_at,
    case when (k + i) % 19 <> 0 then cast((k + i) % 5 + 1 as double) else 0::double end quantity
  from (select *, unnest(generate_series(0, k % 4 - 1)) i from d_orders_undated where k % 4 > 0) x)"""

_HUMIDITY = """(select case when ep % 40 = 0 then 'forecast' else 'archive' end source, date,
    round_even(avg(cast((ep * 3 + h * 7) % 100 as double)), 1) humidity_mean
  from (select date, date - date '1970-01-01' ep, unnest(generate_series(0, 23)) h from d_weather) x
  where (ep + h) % 11 <> 0 group by 1, 2)"""

# The checks as one row of counts, and the counts turned into rows.
_COUNTS = """
select * from
  (select count(*) orders, count(*) filter (business_date is null) undated,
          count(*) filter (least(revenue_cents, tax_cents) < 0) negative,
          count(*) filter (net_sales_cents not between revenue_cents - tax_cents - tip_cents - 1
                                                   and revenue_cents - tax_cents - tip_cents + 1) apart,
          count(*) filter (business_date >= date '2001-08-03') ahead from d_orders),
  (select count(*) trading, count(*) filter (day_of_week is null) off_calendar, count(*) filter (source is null) no_weather,
          count(*) filter (source = 'forecast' and business_date <= date '2001-07-25') stale,
          count(*) filter (abs(net_sales_cents - mean) > 5 * deviation) odd
   from v_sales left join x_dates on date = business_date,
        (select avg(net_sales_cents) mean, stddev_pop(net_sales_cents) deviation from v_sales)),
  (select max(business_date) - min(business_date) + 1 reach from v_sales),
  (select count(*) present from x_dates
   where date between (select min(business_date) from v_sales) and (select max(business_date) from v_sales)),
  (select coalesce(max(next - business_date - 1), 0) closed
   from (select business_date, lead(business_date) over (order by business_date) next from (select distinct business_date from v_sales))),
  (select count(*) loose from d_order_items anti join d_orders using (order_id)),
  (select count(*) unpaid from d_payments anti join d_orders using (order_id)),
  (select count(*) no_weather_days from v_sales anti join d_weather on date = business_date)"""
# name -> (severity, passes, value)
_RULES = {
    "orders present": ("'error'", "orders > 0", "orders"),
    "business dates": ("'error'", "undated = 0", "undated"),
    "money non-negative": ("'error'", "negative = 0", "negative"),
    "totals reconcile": ("'error'", "apart = 0", "apart"),
    "no future orders": ("'error'", "ahead = 0", "ahead"),
    "history length": ("if(trading = 0, 'error', 'warning')", "trading >= 60", "trading"),
    "calendar coverage": ("'error'", "off_calendar = 0", "off_calendar"),
    "weather coverage": ("'warning'", "coalesce(no_weather_days * 100.0 / nullif(trading, 0), 0) < 5", "no_weather_days"),
    "weather is observed": ("'warning'", "stale = 0", "stale"),
    "calendar continuity": ("'error'", "present >= coalesce(reach, 0)", "coalesce(reach, 0) - present"),
    "no long closures": ("'warning'", "closed <= 2", "closed"),
    "line items linked": ("'warning'", "loose = 0", "loose"),
    "daily outliers": ("if(trading >= 10, 'warning', 'info')", "trading < 10 or odd = 0", "if(trading >= 10, odd, 0)"),
    "raw files loaded": ("'info'", "true", "0"),
}
_CHECKS = "select unnest([" + ", ".join(
    f"{{'name': '{name}', 'severity': {severity}, 'ok': {passes}, 'v': ({value})::bigint}}"
    for name, (severity, passes, value) in _RULES.items()
) + f"], recursive := true) from ({_COUNTS}) counted"

_LATEST_RUN = """select order_id, line_item_uid, item_name, quantity, total_cents from (
  select 'Dish ' || (l_partkey % 64) item_name, cast(l_orderkey as varchar) order_id,
         cast(l_linenumber as varchar) line_item_uid, l_quantity quantity,
         cast(round(l_extendedprice * 100) as bigint) total_cents,
         row_number() over (partition by l_orderkey, l_linenumber order by l_linestatus desc, l_shipdate desc,
           l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc,
           l_returnflag desc) rn
  from lineitem) x where rn = 1"""

_TABLES = {
    "locations": "d_locations", "calendar_days": "d_calendar", "weather": "d_weather", "events": "d_events",
    "promotions": "d_promotions", "catalog_items": "d_catalog", "catalog_variations": "d_variations",
    "orders": "d_orders", "order_items": "d_order_items", "order_item_modifiers": "d_modifiers",
    "payments": "d_payments", "refunds": "d_refunds", "shifts": "d_shifts",
}
_FACTS = ("orders", "order_items", "payments", "refunds", "shifts")


def _trimmed(table: str, source: str) -> str:
    if table in _FACTS:
        return f"{source} where business_date is null or business_date >= date '1998-01-01'"
    if table == "order_item_modifiers":
        return (f"{source} where order_id not in "
                "(select order_id from d_orders where business_date < date '1998-01-01')")
    return source


_SALES = "select * from v_sales"

RAW: dict[str, str] = {
    "normalize_orders": f"""
select cast(o.k as varchar) order_id, location_id, {_RFC.format('created_at')} created_at,
       {_RFC.format('updated_at')} updated_at, {_RFC.format('closed_at')} closed_at, state,
       case when o.k % 13 <> 0 then 'USD' end currency, r.revenue_cents,
       cast(case when o.k % 6 = 0 then 500 else 0 end as bigint) discount_cents, tax_cents, tip_cents,
       cast(0 as bigint) service_charge_cents, r.revenue_cents - tax_cents - tip_cents net_sales_cents,
       'Register' source,
       case when o.k % 3 > 0 then case when o.k % 2 = 0 then 'PICKUP' else 'DELIVERY' end end fulfillment_type,
       case when o.k % 3 > 0 then 'COMPLETED' end fulfillment_state,
       coalesce(customer_id,
         case when o.k % 3 > 0 then case o.k % 3 when 0 then 'PU' || o.k when 1 then 'DE' || o.k end end,
         case when o.k % 3 > 1 then case (o.k + 1) % 3 when 0 then 'PU' || o.k when 1 then 'DE' || o.k end end)
         customer_id,
       coalesce(t.payment_types, '') payment_types, cast(o.k % 4 as integer) tender_count,
       cast(o.k % 4 as integer) line_item_count, coalesce(l.q, 0::double) item_quantity,
       cast(o.k % 10 = 0 as integer) has_returns, cast(null as varchar) ticket_name, cast(1 as bigint) as version
from d_orders_undated o
join (select k, case when k % 13 <> 0 then revenue_cents else 0 end revenue_cents from d_orders_undated) r
  on r.k = o.k
left join (select k, sum(quantity) q from {_LINES} i group by k) l on l.k = o.k
left join (select k, string_agg(kind, ',' order by kind) payment_types from (
  select distinct k, case (k + i) % 4 when 0 then 'CASH' when 1 then 'CARD' when 2 then 'GIFT_CARD' end kind
  from {_LINES} i) d where kind is not null group by k) t on t.k = o.k""",
    "normalize_order_items": f"""
select order_id, 'L' || i line_item_uid, cast(i as integer) line_number, location_id,
       {_RFC.format('created_at')} created_at, 'VAR' || ((k + i) % 200) catalog_object_id,
       'Dish ' || ((k + i) % 64) item_name, 'regular' variation_name, quantity,
       cast(k % 900 + i * 100 as bigint) base_price_cents, cast((k % 900) * 2 + i * 100 as bigint) gross_sales_cents,
       cast(case when i = 1 then 25 else 0 end as bigint) discount_cents, cast(k % 70 as bigint) tax_cents,
       cast((k % 900) * 2 + i * 100 + k % 70 as bigint) total_cents,
       case when i % 2 = 0 then 'Extra spicy' else '' end modifier_names,
       cast(case when i % 2 = 0 then 2 else 0 end as integer) modifier_count
from {_LINES} x""",
    "normalize_payments": f"""
select payment_id, order_id, location_id, {_RFC.format('created_at')} created_at, status, amount_cents,
       cast(0 as bigint) tip_cents, 'USD' currency, processing_fee_cents, source_type, card_brand,
       case when source_type = 'CARD' then 'CREDIT' end card_type,
       case when source_type = 'CARD' then 'KEYED' end entry_method
from d_payments""",
    "normalize_refunds": f"""
select refund_id, 'P' || order_id payment_id, order_id, location_id, {_RFC.format('created_at')} created_at,
       'COMPLETED' status, amount_cents, cast(-3 as bigint) processing_fee_cents, 'returned' reason
from d_refunds""",
    "normalize_customers": """
select cast(c_custkey as varchar) customer_id, c_name given_name, lower(c_mktsegment) || '@example.com' email,
       case when c_custkey % 2 = 0 then c_mktsegment else '' end group_ids, '' segment_ids,
       cast(c_custkey % 3 = 0 as integer) email_unsubscribed,
       case when c_custkey % 4 <> 0 then cast(c_nationkey as varchar) end postal_code
from customer""",
    "normalize_catalog": """
select 'ITEM' || p_partkey catalog_object_id, p_name item_name,
       case when p_size % 2 = 0 then p_brand || ' ' || p_name else p_brand end description,
       case when p_size % 3 <> 2 then 'CAT-' || p_type end category_id,
       case when p_size % 3 <> 2 then upper(left(p_type, 1)) || lower(substr(p_type, 2)) end category_name,
       cast(p_size > 40 as integer) is_archived, 0 is_deleted, 2 variation_count
from part""",
    "expand_variations": """
select 'VAR' || p_partkey variation_id, 'ITEM' || p_partkey catalog_object_id, 'regular' as name,
       cast(null as varchar) sku, cast(round(p_retailprice * 100) as bigint) price_cents from part
union all
select 'VARL' || p_partkey, 'ITEM' || p_partkey, 'large', null, 0 from part where p_size % 5 = 0""",
    "normalize_shifts": f"""
select shift_id, team_member_id, location_id, {_RFC.format('start_at')} start_at, {_RFC.format('end_at')} end_at,
       round(hours, 4) as hours, case when end_at is null then 'OPEN' else 'CLOSED' end status, 'cook' job_title,
       hourly_rate_cents, labor_cost_cents
from d_shifts""",
    "weather_daily": f"""
select cast(w.date as varchar) date, w.source, temp_max_f, precipitation_in, snowfall_in,
       case when w.date < m.last_date or m.n = 1 then wind_max_mph end wind_max_mph, h.humidity_mean, weather_code,
       cast(null as double) rain_in, is_rainy, is_snowy, is_stormy
from d_weather w
join (select source, year(date) y, month(date) m, max(date) last_date, count(*) n from d_weather group by 1, 2, 3) m
  on m.source = w.source and m.y = year(w.date) and m.m = month(w.date)
left join {_HUMIDITY} h on h.date = w.date and h.source = w.source""",
    "humidity_daily": f"select source, cast(date as varchar) date, humidity_mean from {_HUMIDITY} h",
    "weather_flags": """
select date, weather_code, precipitation_in, snowfall_in, is_rainy, is_snowy, is_stormy from d_weather""",
    "ingest_quarantine": """
select location_id, count(*) lines, cast(sum(revenue_cents) as bigint) revenue_cents
from d_orders_undated where k % 97 <> 0 and k % 89 <> 0 group by location_id
union all select 'quarantined', count(*), null from d_orders_undated where k % 97 = 0""",
    "business_day_of": "select order_id, location_id, created_at, business_date, business_hour from d_orders",
    "attach_business_day": "select shift_id, business_date, business_hour from d_shifts",
    "ingest_defaults": """
select order_id, customer_id, cast(case when k % 3 <> 0 then revenue_cents else 0 end as bigint) revenue_cents,
       cast(case when k % 5 <> 0 then tip_cents else 0 end as bigint) tip_cents,
       case when k % 4 <> 0 then item_quantity else 0::double end item_quantity,
       cast(k % 6 <> 0 and k % 2 = 0 as integer) has_returns
from d_orders_undated""",
    "upsert_latest": """
select order_id, line_item_uid, location_id, catalog_object_id, item_name, quantity, total_cents, business_date
from d_order_items""",
    "upsert_merge": _LATEST_RUN,
    "expand_modifiers": "select * from d_modifiers",
    "ingest_ledger": """
select 'orders' entity, case when created_at < timestamp '1998-01-01' then 'orders-run1' else 'orders-run2' end run,
       count(*) as rows from d_orders_undated group by 2""",
    "table_counts": " union all ".join(
        f"select '{table}' table_name, count(*) row_count from {source}" for table, source in _TABLES.items()
    ),
    "sales_span": """
select min(business_date) first_sales_date, max(business_date) last_sales_date, count(*) days_with_sales
from v_sales""",
    "retention_trim": " union all ".join(
        f"select '{table}' table_name, count(*) row_count from {_trimmed(table, source)}"
        for table, source in _TABLES.items()
    ),
    "high_water_marks": """
select 'orders' entity, max(updated_at) watermark, count(*) row_count from d_orders
union all select 'payments', max(updated_at), count(*) from d_payments
union all select 'shifts', max(start_at), count(*) from d_shifts
union all select 'weather', cast(max(date) as timestamp), count(*) from d_weather""",
    "incremental_window": """
select order_id, location_id, updated_at, revenue_cents from d_orders
where updated_at between timestamp '2001-07-01 06:00:00' and timestamp '2001-07-31 23:59:59.999999'""",
    "account_preview": """
select orders, cancelled_orders, orders - cancelled_orders sales_orders, trading_days, first_sale, last_sale,
       round_even(cents / 100.0::double, 2) total_sales,
       round_even(cents / 100.0::double / trading_days, 2) average_day,
       cast(trading_days >= 60 as integer) enough_to_forecast, greatest(60 - trading_days, 0) days_needed,
       cast(60 as bigint) minimum_days
from (select count(*) orders, count(*) filter (where state = 'CANCELED') cancelled_orders,
             count(distinct case when c = 0 then d end) trading_days, min(case when c = 0 then d end) first_sale,
             max(case when c = 0 then d end) last_sale,
             cast(sum(case when c = 0 then net_sales_cents end) as bigint) cents
      from (select *, cast(coalesce(state = 'CANCELED', false) as integer) c,
                   cast(coalesce(closed_at, created_at) as date) d from d_orders) x) y""",
    "calendar_days": "select * from d_calendar",
    "calendar_holidays": """
select date, is_holiday, holiday_name, is_holiday_eve, is_day_after_holiday, observance from d_calendar
where is_holiday + is_holiday_eve + is_day_after_holiday + is_observance > 0""",
    "school_break": """
select d as date, min_by(label, ordinal) school_break
from (select cast(unnest(generate_series(cast(start_date as timestamp), cast(end_date as timestamp),
             interval 1 day)) as date) d, label, ordinal from d_terms) x group by d""",
    "expand_events": "select * from d_events",
    "expand_promotions": "select * from d_promotions",
    "daily_sales": _SALES,
    "daily_item_sales": "select * from v_item_sales",
    "daily_labor": _rounded("v_labor", "labor_hours"),
    "daily_payments": "select * from v_payments",
    "daily_refunds": "select * from v_refunds",
    "daily_events": "select * from v_events",
    "daily_promotions": "select * from v_promotions",
    "daily_spine": "select * from s_spine",
    "customer_first_seen": "select * from s_first",
    "new_vs_returning": """
select *, customer_count - new_customer_count returning_customer_count from s_new where customer_count > 0""",
    "dayparts": "select * from s_dayparts",
    "peak_hour": "select * from s_peak",
    "distinct_items": "select * from s_items",
    "daily_summary": _rounded("s_summary", "labor_hours item_count"),
    "daily_summary_since": _rounded("s_summary", "labor_hours item_count")
    + " where business_date >= date '2000-06-15'",
    "forecast_features": _rounded("w_view", "labor_hours item_count"),
    "feature_frame": _rounded("w_view", "labor_hours item_count") + """
where is_observed = 1 and target_sales_cents is not null and sales_lag_14_cents is not null""",
    "prediction_rows": _rounded("w_view", "labor_hours item_count") + " where is_observed = 0",
    "latest_daily_sales": _SALES + " order by business_date desc, location_id limit 30",
    "top_items": """
select item_name, category_name, sum(quantity) quantity, cast(sum(revenue_cents) as bigint) revenue_cents,
       count(distinct business_date) days_sold
from v_item_sales where business_date >= (select max(business_date) from v_item_sales) - 30
group by item_name, category_name
order by quantity desc, item_name nulls last, category_name nulls last limit 20""",
    "data_quality": "select unnest([" + ", ".join(f"{{'metric': '{name}', 'value': {value}}}" for name, value in {
        "days in range": "present", "days with sales": "trading", "days missing weather": "no_weather_days",
        "orders without business_date": "undated", "order items without an order": "loose",
        "payments without an order": "unpaid",
    }.items()) + f"], recursive := true) from ({_COUNTS}) counted",
    "modifier_frequency": """
select i.item_name, m.name modifier_name, count(*) times_chosen, cast(sum(m.price_cents) as bigint) modifier_cents,
       sum(i.quantity) quantity
from d_modifiers m join d_order_items i on i.order_id = m.order_id and i.line_item_uid = m.line_item_uid
group by i.item_name, m.name""",
    "validation_report": f"""
select name, severity, cast(ok as integer) passed, cast(v as bigint) as value from ({_CHECKS}) c""",
    "validation_report_strict": f"""
select name, case when severity = 'warning' then 'error' else severity end severity, cast(ok as integer) passed,
       cast(v as bigint) as value from ({_CHECKS}) c""",
    "zero_sales_runs": """
select min(date) run_start, max(date) run_end, count(*) as days from (
  select date, date - cast(row_number() over (order by date) as integer) g
  from d_calendar c, (select min(business_date) a, max(business_date) b from d_orders
                      where state <> 'CANCELED') s
  where date between a and b and not exists (select 1 from d_orders d where d.business_date = c.date
    and d.state <> 'CANCELED')) r
group by g""",
    "outlier_days": """
select business_date, location_id, net_sales_cents
from v_sales, (select avg(net_sales_cents) m, stddev_pop(net_sales_cents) s from v_sales) x
where abs(net_sales_cents - m) > 3 * s""",
    "feature_source": _rounded("f_source", "labor_hours item_count"),
    "cyclical_features": """
select date, day_of_week, month, day_of_year,
       round(sin(2 * pi() * day_of_week / 7), 4) dow_sin, round(cos(2 * pi() * day_of_week / 7), 4) dow_cos,
       round(sin(2 * pi() * month / 12), 4) month_sin, round(cos(2 * pi() * month / 12), 4) month_cos,
       round(sin(2 * pi() * day_of_year / 365.25::double), 4) doy_sin,
       round(cos(2 * pi() * day_of_year / 365.25::double), 4) doy_cos
from d_calendar""",
    "holiday_distance": """
select d.date business_date, is_holiday,
       cast(least(coalesce((select min(h.date - d.date) from d_calendar h
            where h.is_holiday = 1 and h.date >= d.date), 99), 99) as integer) days_to_holiday,
       cast(least(coalesce((select min(d.date - h.date) from d_calendar h
            where h.is_holiday = 1 and h.date < d.date), 99), 99) as integer) days_since_holiday
from d_calendar d""",
    "lag_features": """
select business_date, location_id, sales_lag_1, sales_lag_2, sales_lag_3, sales_lag_7, sales_lag_14, sales_lag_28,
       orders_lag_1, orders_lag_7, customers_lag_1, customers_lag_7, avg_ticket_lag_7,
       round(labor_hours_lag_7, 4) labor_hours_lag_7
from f_all""",
    "rolling_features": """
select business_date, location_id, round(sales_roll_mean_7, 4) sales_roll_mean_7,
       round(sales_roll_mean_28, 4) sales_roll_mean_28, round(sales_roll_std_7, 4) sales_roll_std_7,
       sales_roll_max_7, round(same_dow_mean_4, 4) same_dow_mean_4, round(momentum_7_28, 4) momentum_7_28
from f_all""",
    "interaction_features": """
select business_date, location_id, rain_x_weekend, promotion_active, promo_x_weekend,
       round(temp_vs_normal_f, 4) temp_vs_normal_f, days_since_start
from f_all""",
    "feature_table": _rounded("f_rows", _FLOATS),
    "split_sizes": "select observed_days, held val_days, held test_days from f_sizes",
    "time_split": "select business_date, location_id, split from f_rows",
    "scaler_stats": _STATS,
    "scaled_features": f"""
select business_date, location_id, split, {_SCALED_COLUMNS}
from f_rows, (select {_SCALE_FIT} from f_rows where split = 'train') s""",
    "unscaled_features": """
select business_date, location_id, round(cast(sales_lag_1 as double), 3) sales_lag_1,
       round(sales_roll_mean_28, 3) sales_roll_mean_28, round(temp_max_f, 3) temp_max_f
from f_rows""",
    "feature_manifest": f"""
select split, count(*) as rows, min(business_date) first_date, max(business_date) last_date,
       {len(INPUTS)} feature_count, {len(INPUTS) - len(_SCALED)} binary_count, 'target_sales_cents' target
from f_rows group by split""",
    "feature_payload": """
select business_date, location_id, split, target_sales_cents, sales_lag_1,
       round_even(sales_roll_mean_7, 4) sales_roll_mean_7, round_even(temp_max_f, 4) temp_max_f,
       round_even(dow_sin, 4) dow_sin, is_holiday, days_to_holiday
from f_rows""",
    "feature_contract": """
select unnest(['target is not an input', 'no outcome of the same day', 'no key among the inputs',
               'three splits present', 'inputs are finite', 'every learned row has a target',
               'splits are in time order', 'scaler present']) as rule,
       unnest([1, 1, 1, cast(splits = 3 as integer), 1, cast(no_target = 0 as integer),
               cast(a < b and c < d as integer), 1]) passed
from (select count(distinct split) filter (where split <> 'future') splits,
             count(*) filter (where split <> 'future' and target_sales_cents is null) no_target,
             max(business_date) filter (where split = 'train') a, min(business_date) filter (where split = 'val') b,
             max(business_date) filter (where split = 'val') c, min(business_date) filter (where split = 'test') d
      from f_rows) x""",
    "target_scaler": """
select round(avg(target_sales_cents), 4) mean, round(stddev_pop(target_sales_cents), 4) std
from f_rows where split = 'train'""",
    "baseline_predictions": _rounded("p_long", "predicted"),
    "baseline_scores": "select * from p_scores",
    "baseline_verdict": "select * from p_verdict",
    "residual_band": _rounded("p_band", "low high std"),
    "forecast_rows": """
select * replace (round_even(sales_lag_1 / 100, 2) as sales_lag_1, round_even(sales_lag_7 / 100, 2) as sales_lag_7,
                  round_even(sales_roll_mean_7 / 100, 2) as sales_roll_mean_7,
                  round_even(sales_roll_mean_28 / 100, 2) as sales_roll_mean_28)
from p_rows""",
    "next_day_forecast": """
select business_date, round_even(p, 2) predicted_sales, round_even(lo, 2) interval_low,
       round_even(hi, 2) interval_high,
       case when p > 0 then round_even(greatest(least(1 - greatest(hi - lo, 0) / p, 1), 0), 3) else 0 end confidence,
       0::double model_uncertainty, estimated_orders, round_even(a / 100, 2) sales_lag_1,
       round_even(b / 100, 2) sales_lag_7, round_even(c / 100, 2) sales_roll_mean_7,
       round_even(d / 100, 2) sales_roll_mean_28, locations
from (select business_date, sum(predicted_sales) p, sum(interval_low) lo, sum(interval_high) hi,
             cast(sum(case when estimated_orders >= 0 then estimated_orders end) as bigint) estimated_orders,
             sum(sales_lag_1) a, sum(sales_lag_7) b, sum(sales_roll_mean_7) c, sum(sales_roll_mean_28) d,
             count(*) locations
      from p_rows r
      where business_date = (select min(business_date) from p_rows)
        and (sales_roll_mean_28 > 0 or not exists (select 1 from p_rows q where q.sales_roll_mean_28 > 0
             and q.business_date = (select min(business_date) from p_rows)))
      group by business_date) x""",
    "forecast_history": """
select split, business_date, round_even(sum(target_sales_cents / 100.0::double), 2) actual,
       round_even(sum(sales_roll_mean_7 / 100.0::double), 2) predicted
from f_rows where split in ('val', 'test') group by split, business_date
order by business_date desc, split limit 30""",
    "test_metrics": """
select s.split, mae_dollars mae, rmse_dollars rmse, mape_percent mape, mean_actual_dollars mean_actual, n_days,
       'last week' baseline, baseline_mae_dollars baseline_mae, improvement_dollars improvement, model_wins,
       beats_all_baselines
from p_scores s, p_verdict v where s.split = 'test' and s.predictor = 'baseline_rolling_7'""",
    "stream_ingest": """
select order_id, location_id, business_date, business_hour, state, revenue_cents, net_sales_cents, customer_id,
       item_quantity from d_orders""",
    "stream_upsert": _LATEST_RUN,
    "stream_daily_sales": _SALES,
    "stream_first_seen": "select * from s_first",
    "stream_daily_summary": _rounded("s_summary", "labor_hours item_count"),
    "retention_stored": """
select cast(year(business_date) as integer) as order_year, count(*) as orders from d_orders
where business_date is null or business_date >= date '1998-01-01' group by 1""",
    "validation_isolated": f"""
select name, severity, cast(ok as integer) passed, cast(v as bigint) as value from ({_CHECKS}) c
where name <> 'line items linked'
union all select 'line items linked', 'error', 0, null""",
    "quarantine_lines": """
select reason, count(*) as lines from (
  select case when k % 97 = 0 then 'unreadable' else 'no key' end reason from d_orders_undated
  where k % 97 = 0 or k % 89 = 0) x group by reason""",
}

PARTS.update(oracle_models.PARTS)
SQL: dict[str, str] = {name: with_parts(text) for name, text in (RAW | oracle_models.RAW).items()}

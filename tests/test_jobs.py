"""Loading, streaming and the daily job: idempotence, late corrections, stream = batch."""

import json
import shutil
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillcast.functions.trading_day import business_day, location_zones
from tillcast.operators import models, splits
from tillcast.operators.features import feature_columns
from tillcast.operators.rollups import daily_sales
from tillcast.plans import daily_batch, queries
from tillcast.plans.daily_batch import ledger, load_all, load_dataset, load_tables, run_daily
from tillcast.plans.oracle import SQL
from tillcast.plans.queries import REGISTRY
from tillcast.schemas import BY_ENTITY
from tillcast.sources import tables as stored_tables
from tillcast.sources.tables import PART_KEY, Layout, merge_parts, read_parts
from tillcast.streaming.incremental import current_daily_sales, ingest_orders, run_ingest


def write(folder, entity, run, records):
    target = folder / entity
    target.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    (target / f"{entity}-{run}.jsonl").write_text("\n".join(lines) + "\n")


def order(oid, created, revenue, **more):
    return {
        "order_id": oid, "location_id": "L1", "created_at": created, "state": "COMPLETED", "revenue_cents": revenue,
        "tax_cents": 0, "tip_cents": 0, "net_sales_cents": revenue, **more,
    }


@pytest.fixture
def zones(spark):
    return location_zones(spark.createDataFrame([("L1", "America/New_York")], "location_id string, timezone string"))


def test_load_all_is_idempotent_and_later_file_wins(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    write(raw, "locations", "r1", [{"location_id": "L1", "timezone": "America/New_York", "status": "ACTIVE"}])
    write(raw, "orders", "r1", [order("o1", "2026-08-01T16:00:00Z", 100), "", "{broken", order("o2", "2026-08-01T05:30:00Z", 200), {"order_id": "o3"}])
    write(raw, "order_items", "r1", [{"order_id": "o1", "line_item_uid": "a", "location_id": "L1", "created_at": "2026-08-01T16:00:00Z", "modifiers": [{"uid": "m", "name": "Hot"}]}])
    write(raw, "catalog", "r1", [{"catalog_object_id": "I", "item_name": "Naan", "is_archived": True, "variations": [{"id": "V", "price_cents": 5}, {"name": "no id"}]}])
    done = load_all(spark, str(raw), out)
    assert done["orders"] == 3 and done["payments"] == 0
    before = sorted(map(str, load_tables(spark, out)["orders"].drop("ingested_at").collect()))
    assert load_all(spark, str(raw), out)["orders"] == 0
    load_all(spark, str(raw), out, only=["orders"], force=True)
    tables = load_tables(spark, out)
    assert sorted(map(str, tables["orders"].drop("ingested_at").collect())) == before and len(before) == 3
    assert ledger(spark, out).count() == 4
    # a later run moves an order to another day and changes its total
    write(raw, "orders", "r2", [order("o1", "2026-08-03T16:00:00Z", 1), order("o1", "2026-08-03T16:00:00Z", 111)])
    load_all(spark, str(raw), out)
    rows = {r.order_id: r for r in load_tables(spark, out)["orders"].collect()}
    assert len(rows) == 3 and rows["o1"].revenue_cents == 111 and rows["o1"].business_date == date(2026, 8, 3)
    assert rows["o2"].business_date == date(2026, 7, 31) and rows["o2"].business_hour == 1
    assert rows["o3"].revenue_cents == 0 and rows["o3"].business_date is None
    tables = load_tables(spark, out)
    assert [r.name for r in tables["order_item_modifiers"].collect()] == ["Hot"]
    assert [r.variation_id for r in tables["catalog_variations"].collect()] == ["V"]
    assert tables["catalog_items"].first().is_archived == 1


def test_merge_empties_a_partition_whose_rows_moved(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, x int, business_date date"
    d = date(2026, 1, 1)
    merge_parts(spark, path, spark.createDataFrame([("a", 1, d), ("b", 1, d + timedelta(1)), ("c", 1, None)], schema), ["k"])
    touched = merge_parts(spark, path, spark.createDataFrame([("a", 2, d + timedelta(1))], schema), ["k"])
    assert {r[0] for r in touched.collect()} == {"d2026-01-01", "d2026-01-02"}
    rows = {(r.k, r.x, r.business_date) for r in read_parts(spark, path, ["k"]).drop(PART_KEY).collect()}
    assert rows == {("a", 2, d + timedelta(1)), ("b", 1, d + timedelta(1)), ("c", 1, None)}


def test_merge_survives_a_loss_between_delete_and_rename(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k string, x int, business_date date"
    d = date(2026, 1, 1)
    merge_parts(spark, path, spark.createDataFrame([("a", 1, d), ("b", 1, d)], schema), ["k"])
    batch = spark.createDataFrame([("a", 2, d)], schema)

    def lost(session, at):
        if (tmp_path / "t" / "_pending" / "_SUCCESS").exists():
            shutil.rmtree(tmp_path / "t" / f"{PART_KEY}=d2026-01-01")
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stored_tables, "replay_pending", lost)
        with pytest.raises(RuntimeError, match="lost"):
            merge_parts(spark, path, batch, ["k"])
    merge_parts(spark, path, batch, ["k"])
    assert {(r.k, r.x) for r in read_parts(spark, path, ["k"]).collect()} == {("a", 2), ("b", 1)}


def test_rollup_is_right_after_a_failure_behind_the_merge(spark, tmp_path, zones):
    raw, out, spec = tmp_path / "raw", str(tmp_path / "out"), BY_ENTITY["orders"]
    write(raw, "orders", "r1", [order("o1", "2026-08-01T16:00:00Z", 100), order("o2", "2026-08-01T17:00:00Z", 50)])
    ingest_orders(spark, str(raw), out, spec, zones)
    write(raw, "orders", "r2", [order("o1", "2026-08-03T16:00:00Z", 100)])

    def fails(touched):
        raise RuntimeError("lost before the rollup")

    with pytest.raises(Exception, match="lost before the rollup"):
        run_ingest(spark, str(raw), out, spec, zones, after=fails)
    ingest_orders(spark, str(raw), out, spec, zones)
    rows = {r.business_date.day: r.revenue_cents for r in current_daily_sales(spark, out).collect()}
    assert rows == {1: 50, 3: 100}


def test_stream_equals_batch_with_late_corrections(spark, tmp_path, zones):
    raw, out, spec = tmp_path / "raw", str(tmp_path / "out"), BY_ENTITY["orders"]
    stamp = lambda n, h=16: (datetime(2026, 5, 1, h) + timedelta(days=n)).strftime("%Y-%m-%dT%H:%M:%SZ")
    first = [order(f"o{i}", stamp(i % 5), 100 + i, customer_id=f"c{i % 3}") for i in range(20)]
    write(raw, "orders", "r1", [*first, "{bad"])
    ingest_orders(spark, str(raw), out, spec, zones)
    # an old order is canceled, another moves to an earlier day, and the only order of a new day appears
    second = [order("o0", stamp(0), 100, state="CANCELED"), order("o1", stamp(-3), 900), order("o99", stamp(9), 5)]
    write(raw, "orders", "r2", second)
    ingest_orders(spark, str(raw), out, spec, zones)
    # the only order of that day moves away again: its day must vanish from the rollup
    third = [order("o99", stamp(2), 5)]
    write(raw, "orders", "r3", third)
    ingest_orders(spark, str(raw), out, spec, zones)
    ingest_orders(spark, str(raw), out, spec, zones)  # nothing new
    batch_out = str(tmp_path / "batch")
    write(tmp_path / "raw", "locations", "r1", [{"location_id": "L1", "timezone": "America/New_York"}])
    load_all(spark, str(raw), batch_out, only=["locations", "orders"])
    want = daily_sales(load_tables(spark, batch_out)["orders"])
    got = current_daily_sales(spark, out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert date(2026, 5, 10) not in {r.business_date for r in got.collect()}
    bad = spark.read.parquet(f"{out}/_quarantine/orders")
    assert [r.line for r in bad.collect()] == ["{bad"]


def test_weather_forecast_is_superseded(spark, tmp_path):
    raw, out, spec = tmp_path / "raw", str(tmp_path / "out"), BY_ENTITY["weather"]
    write(raw, "weather", "r1", [{"date": "2026-05-01", "source": "forecast", "temp_max_f": 60.0, "is_rainy": True}])
    run_ingest(spark, str(raw), out, spec, None)
    write(raw, "weather", "r2", [{"date": "2026-05-01", "source": "archive", "temp_max_f": 58.5, "is_rainy": False}])
    run_ingest(spark, str(raw), out, spec, None)
    rows = load_tables(spark, out)["weather"].collect()
    assert [(r.date, r.source, r.temp_max_f, r.is_rainy) for r in rows] == [(date(2026, 5, 1), "archive", 58.5, 0)]


def test_daily_job_and_model(spark, tmp_path):
    raw, out, start, days = tmp_path / "raw", str(tmp_path / "out"), date(2026, 1, 1), 90
    write(raw, "locations", "r1", [{"location_id": "L1", "timezone": "America/New_York", "status": "ACTIVE"}])
    write(raw, "orders", "r1", [
        order(f"o{n}-{i}", f"{start + timedelta(days=n)}T{17 + i}:00:00Z", 1000 + 37 * (n % 7) + n, customer_id=f"c{i}")
        for n in range(days) for i in range(3)
    ])
    span = [start + timedelta(days=n) for n in range(days + 14)]
    write(raw, "weather", "r1", [
        {"date": str(d), "source": "archive", "is_rainy": d.day % 5 == 0, **{
            c: float(40 + d.day) for c in ("temp_max_f", "temp_min_f", "temp_mean_f", "feels_like_max_f", "precipitation_in",
                                           "snowfall_in", "precipitation_hours", "wind_max_mph", "humidity_mean")}}
        for d in span
    ])
    write(raw, "calendar", "r1", [
        {"date": str(d), "day_of_week": d.isoweekday(), "month": d.month, "year": d.year, "day_of_month": d.day,
         "day_of_year": d.timetuple().tm_yday, "week_of_year": d.isocalendar().week, "quarter": (d.month + 2) // 3,
         "is_weekend": d.isoweekday() > 5}
        for d in span
    ])
    built = run_daily(spark, str(raw), out, start + timedelta(days=days), layout=Layout("yyyy-MM"))
    assert built["report"].where("passed = 0").count() == 0 and built["summary"].count() == days
    columns = feature_columns(built["features"].columns)
    assert json.loads(built["manifest"].first()[0])["feature_count"] == 68 == len(columns)
    dataset = load_dataset(spark, out)
    assert load_dataset(spark, out, "future").count() == 1
    model = models.fit_model(dataset, columns)
    predicted = models.predict(model, dataset)
    assert predicted.where("predicted is null or isnan(predicted)").count() == 0
    top = models.explain_forecast(model, dataset.where("split = 'future'"), built["features"].where("split = 'future'"), columns)
    shares = [r.contribution for r in top.collect()]
    assert len(shares) == 6 and shares == sorted(shares, reverse=True) and 0 < sum(shares) <= 1.0001
    trees = models.predict(models.fit_model(dataset, columns, estimator="gbt"), dataset)
    assert trees.where("split = 'test'").count() == 9
    a, b = (models.forecast_uncertainty(dataset, columns, refits=2).first()["model_uncertainty"] for _ in range(2))
    assert a == b and a >= 0
    back = splits.unscale(dataset, built["scaler"], columns).where("split = 'test'").agg(F.sum("sales_lag_1")).first()[0]
    assert abs(back - built["features"].where("split = 'test'").agg(F.sum("sales_lag_1")).first()[0]) < 1e-6


def test_uncertainty_query_makes_the_default_refits(spark, monkeypatch):
    asked = []

    def captured(scaled, columns, refits=models.REFITS, **rest):
        asked.append(refits)
        return spark.createDataFrame([], "business_date date, location_id long, model_uncertainty double")

    monkeypatch.setattr(queries, "_scaled", lambda shop: (None, None, []))
    monkeypatch.setattr(models, "forecast_uncertainty", captured)
    REGISTRY["forecast_uncertainty"](spark, "/root/testdata/sf0.001")
    assert asked == [100]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(REGISTRY)
    assert set(REGISTRY) - set(SQL) == {"model_predictions", "forecast_uncertainty", "explain_forecast"}


def test_zones_that_never_landed_move_no_orders(spark):
    """Without stored locations the default zone applies to every order where it lies."""
    zones = location_zones(daily_batch.empty_table(spark, BY_ENTITY["locations"]))
    rows = spark.range(5000).selectExpr("cast(id % 5 as string) as location_id", "timestamp'2026-04-02 07:30:00' as created_at")
    dated = business_day(rows, zones)
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [tuple(r) for r in dated.select("business_date", "business_hour").distinct().collect()] == [(date(2026, 4, 1), 3)]

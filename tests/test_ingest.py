"""Landing, trading day, defaults, upsert, retention, watermarks: known answers on tiny inputs."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tillcast.functions.joins import Lookup
from tillcast.functions.trading_day import business_day, location_zones
from tillcast.operators import ingest
from tillcast.schemas import BY_ENTITY, ENTITIES
from tillcast.sources.landing import events_csv, land, parse_lines, read_landed, school_csv
from tillcast.sources.sample import SampleShop


@pytest.fixture(scope="module")
def zones(spark):
    rows = [("NY", "America/New_York"), ("LA", "America/Los_Angeles"), ("X", "Mars/Base"), ("N", None)]
    return location_zones(spark.createDataFrame(rows, "location_id string, timezone string"))


def test_trading_day_known_answers(spark, zones):
    cases = [
        ("NY", "2026-08-01T05:30:00Z", date(2026, 7, 31), 1),
        ("NY", "2026-08-01T16:00:00Z", date(2026, 8, 1), 12),
        ("NY", "2026-08-01T06:00:00Z", date(2026, 7, 31), 2),
        ("LA", "2026-08-01T06:00:00Z", date(2026, 7, 31), 23),
        ("X", "2026-08-01T03:59:00Z", date(2026, 7, 31), 3),  # unknown zone is UTC
        ("N", "2026-08-01T16:00:00Z", date(2026, 8, 1), 12),  # missing zone is the default
        ("unlisted", "2026-08-01T16:00:00+02:00", date(2026, 8, 1), 10),
        (None, "2026-08-01T16:00:00", date(2026, 8, 1), 12),  # naive is UTC
        ("NY", None, None, None),
        ("NY", "garbage", None, None),
        ("NY", "12:30", None, None),
        ("NY", "2026-13-01T00:00:00Z", None, None),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, location_id string, t string")
    stamped = rows.withColumn("created_at", ingest.instant(F.col("t")))
    got = {r.i: (r.business_date, r.business_hour) for r in business_day(stamped, zones).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}


def test_lookup_agrees_with_and_without_broadcast(spark):
    fact = spark.range(0, 5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = Lookup(spark.createDataFrame([("hot", 1), ("3", 2), ("6", 3)], "k string, v int"), ["k"])
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = sorted(map(str, lookup.attach(fact, how).collect()))
        try:
            for name in names:
                spark.conf.set(name, "-1")
            large = sorted(map(str, lookup.attach(fact, how).collect()))
        finally:
            for name in names:
                spark.conf.unset(name)
        assert small == large


def test_a_hot_key_of_a_lookup_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    pad = F.sha2(F.col("id").cast("string"), 256)
    hot = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.substring(pad, 1, 12))
    fact = spark.range(0, 100_000, 1, 8).select(hot.alias("k"), "id", pad.alias("pad"))
    dim = fact.where("k <> 'hot'").select("k", F.lit(1).alias("v")).distinct().union(spark.createDataFrame([("hot", 7)], "k string, v int"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = Lookup(dim, ["k"]).attach(fact)
        assert joined.where("v = 7").count() == 90_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_quarantine_keeps_good_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ("   ",), ('{"a": ',), ('{"b": 2}',)], "value string")
    good, bad = parse_lines(lines, "a int")
    assert sorted((r.a for r in good.collect()), key=str) == [1, None]
    assert [r.line for r in bad.collect()] == ['{"a": ']


def test_land_and_read_back(spark, tmp_path):
    raw, spec = str(tmp_path), BY_ENTITY["customers"]
    assert land(spark.createDataFrame([], spec.landing), raw, "customers", "r0") == {"rows": 0, "watermark": None}
    good, bad = read_landed(spark, raw, spec)
    assert good.count() == 0 and bad.count() == 0
    rows = spark.createDataFrame([("C1", "2026-01-01T00:00:00Z"), ("C2", "2026-02-01T00:00:00Z")], "customer_id string, updated_at string")
    assert land(rows, raw, "customers", "r1", "updated_at") == {"rows": 2, "watermark": "2026-02-01T00:00:00Z"}
    good, bad = read_landed(spark, raw, spec)
    assert good.count() == 2 and bad.count() == 0
    assert good.first()["_file"].startswith("customers-r1.jsonl")


def test_latest_by_key_takes_highest_version(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 3, "new"), ("a", 2, "old"), ("b", 1, "only")], "k string, v int, x string"
    )
    got = {(r.k, r.v, r.x) for r in ingest.latest_by_key(rows, ["k"], [F.col("v")]).collect()}
    assert got == {("a", 3, "new"), ("b", 1, "only")}


def test_upsert_replaces_and_keeps(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "kept")], "k string, x string")
    batch = spark.createDataFrame([("a", "mid", 1), ("a", "new", 2), ("c", "added", 1)], "k string, x string, v int")
    once = ingest.upsert_latest(stored, batch, ["k"], ["v"])
    want = {("a", "new"), ("b", "kept"), ("c", "added")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in ingest.upsert_latest(once, batch, ["k"], ["v"]).collect()} == want


def test_window_bounds():
    end = datetime(2026, 8, 1, 23, 59, 59, 999999, tzinfo=timezone.utc)
    assert ingest.window_bounds(date(2026, 8, 1), since=date(2026, 1, 1)) == (datetime(2026, 1, 1, tzinfo=timezone.utc), end)
    mark = datetime(2026, 7, 1, 12, tzinfo=timezone.utc)
    assert ingest.window_bounds(date(2026, 8, 1), watermark=mark) == (mark - timedelta(hours=6), end)
    assert ingest.window_bounds(date(2026, 8, 1))[0] == end - timedelta(days=730)


def test_retention_keeps_undated_rows(spark):
    d = date(2026, 1, 1)
    orders = spark.createDataFrame([("o1", d), ("o2", date(2026, 3, 1)), ("o3", None)], "order_id string, business_date date")
    mods = spark.createDataFrame([("o1",), ("o2",), ("gone",)], "order_id string")
    out = ingest.retention_trim({"orders": orders, "order_item_modifiers": mods}, "2026-02-01")
    assert {r.order_id for r in out["orders"].collect()} == {"o2", "o3"}
    assert {r.order_id for r in out["order_item_modifiers"].collect()} == {"o2", "gone"}


def test_account_preview_counts_utc_days(spark):
    t = datetime(2026, 8, 1, 3)
    rows = spark.createDataFrame(
        [("COMPLETED", 1000, t, t), ("COMPLETED", 500, None, t), ("CANCELED", 900, t, t), (None, 500, t + timedelta(days=1), t)],
        "state string, net_sales_cents long, closed_at timestamp, created_at timestamp",
    )
    r = ingest.account_preview(rows).first()
    assert (r.orders, r.cancelled_orders, r.sales_orders, r.trading_days) == (4, 1, 3, 2)
    assert (r.total_sales, r.average_day, r.enough_to_forecast, r.days_needed) == (20.0, 10.0, 0, 58)


def test_specs_cover_every_entity():
    assert [s.entity for s in ENTITIES][0] == "locations" and len(ENTITIES) == 14
    for spec in ENTITIES:
        assert set(spec.keys) <= set(spec.columns)
        assert not spec.is_fact or "business_date" in spec.columns


def test_reference_csv(spark, tmp_path):
    events = tmp_path / "events.csv"
    events.write_text(
        "name,category,venue,start_date,end_date,start_time,distance_miles,expected_attendance,notes\n"
        "Fair,festival,Park,2026-08-19,2026-08-23,11:00,1.4,50000,x\n,,,,,,,,\nBad,civic,Hall,soon,,,far,many,\n"
    )
    rows = {r.name: r for r in events_csv(spark, str(events)).collect()}
    assert set(rows) == {"Fair", "Bad"}
    assert rows["Fair"].end_date == date(2026, 8, 23) and rows["Fair"].expected_attendance == 50000
    assert rows["Bad"].start_date is None and rows["Bad"].distance_miles is None
    school = tmp_path / "school.csv"
    school.write_text("label,start_date,end_date,notes\nsummer,2026-06-19,2026-08-31,\nbad,x,y,\n")
    assert [r.label for r in school_csv(spark, str(school)).collect()] == ["summer"]


def test_latest_by_key_carries_named_versions_once(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z"), ("a", 2, "w")], "k string, v int, x string")
    newest = ingest.latest_by_key(rows, ["k"], ["v"])
    assert newest.columns == ["k", "v", "x"]
    assert {(r.k, r.v, r.x) for r in newest.collect()} == {("a", 3, "y"), ("b", None, "z")}
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("v, v#") == 1 and "max_by" not in plan


def test_lines_are_shuffled_as_given(spark):
    """Of a line, key and version columns cross the shuffle; names, modifiers and stamps are made behind it."""
    shop = SampleShop(spark, "/root/testdata/sf0.001")
    plan = shop.order_item_records._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1]
    assert "Extra spicy" not in plan and "timestampadd" not in plan and plan.count("l_extendedprice") < 5
    versions = shop.line_versions
    order = [F.col(f"v_{c}") for c in shop.LINE_VERSION]
    slow = ingest.latest_by_key(versions, ["order_id", "line_item_uid"], order)
    fast = shop.latest_lines(shop.raw("lineitem"))
    assert fast.dtypes == slow.dtypes and sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_items_sold_are_the_summary_s_columns_of_the_latest_lines(spark, tmp_path):
    rows = [  # order, line, shipped, part: versions that differ in the date, in the part only, and not at all
        (1, 1, "1998-01-01", 5), (1, 1, "1998-03-01", 2), (1, 1, "1998-03-01", 70), (1, 1, "1998-02-01", 99),
        (1, 2, None, 7), (1, 2, "1998-01-05", None), (2, 1, None, 3), (2, 1, None, 4), (3, 1, "1998-01-01", 9), (3, 1, "1998-01-01", 9),
    ]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, d string, l_partkey long").selectExpr(
        "l_orderkey", "l_linenumber", "cast(d as timestamp) as l_shipdate", "l_partkey", "l_partkey as l_suppkey",
        "10.0D as l_quantity", "2.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'A' as l_returnflag",
        "'F' as l_linestatus",
    )
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    shop = SampleShop(spark, str(tmp_path))
    want = shop.order_items.select("business_date", "location_id", "item_name")
    got = shop.summary_tables["order_items"]
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "l_extendedprice" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]

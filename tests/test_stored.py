"""Stored tables: hash buckets, key index, first days with change propagation, retention, refreshed summary."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillcast.operators.summary import customer_first_seen, daily_summary
from tillcast.plans.daily_batch import ledger, load_all, load_tables, refresh_derived, retain
from tillcast.schemas import BY_ENTITY
from tillcast.sources import buckets, landing, tables
from tillcast.sources.landing import read_rejected
from tillcast.sources.tables import INDEX, PART_KEY, Layout, merge_parts, read_parts, trim_parts
from tillcast.streaming import derived

DAY0 = date(2026, 1, 10)
MONTHS = Layout("yyyy-MM")


def land(folder, entity, run, records):
    target = folder / entity
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{entity}-{run}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def order(oid, n, customer, revenue=100, **more):
    stamp = (datetime.combine(DAY0, datetime.min.time()) + timedelta(days=n, hours=17)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"order_id": oid, "location_id": "L1", "created_at": stamp, "state": "COMPLETED", "revenue_cents": revenue,
            "tax_cents": 0, "tip_cents": 0, "net_sales_cents": revenue, "customer_id": customer, **more}


def rows(df):
    return sorted(map(str, df.collect()))


def files_under(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, at int"
    first = spark.createDataFrame([(i, f"a{i}", 0) for i in range(60)], schema)
    assert len(buckets.merge_buckets(spark, path, first, ["k"], ["at"], count=8)) == 8
    before = files_under(tmp_path / "t" / "data")
    touched = buckets.merge_buckets(spark, path, spark.createDataFrame([(7, "old", 1), (7, "new", 2)], schema), ["k"], ["at"])
    assert len(touched) == 1
    after = files_under(tmp_path / "t" / "data")
    assert {k: v for k, v in after.items() if k in before} == before
    assert {name.split("/")[1] for name in set(after) - set(before)} == {f"{buckets.BUCKET}={touched[0]}"}
    assert {(r.k, r.v) for r in buckets.read_buckets(spark, path).collect()} == {
        (i, "new" if i == 7 else f"a{i}") for i in range(60)
    }
    assert buckets.merge_buckets(spark, path, first.where("false"), ["k"], ["at"]) == []


def test_a_half_written_bucket_is_never_read(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k long, v string"
    buckets.merge_buckets(spark, path, spark.createDataFrame([(1, "a"), (2, "a")], schema), ["k"], count=4)
    with monkeypatch.context() as m:
        m.setattr(buckets, "folders", lambda *_: (_ for _ in ()).throw(RuntimeError("lost before the manifest")))
        with pytest.raises(RuntimeError):
            now = buckets.State(1, 4, {})
            part = spark.createDataFrame([(1, "b")], schema).withColumn(buckets.BUCKET, F.lit(0))
            buckets.replace_buckets(spark, path, part, [0], 4, now)
    assert {r.v for r in buckets.read_buckets(spark, path).collect()} == {"a"}
    for n in range(6):  # the next merges take the version over, and old ones go
        buckets.merge_buckets(spark, path, spark.createDataFrame([(1, f"c{n}")], schema), ["k"])
    assert {(r.k, r.v) for r in buckets.read_buckets(spark, path).collect()} == {(1, "c5"), (2, "a")}
    assert len(buckets.folders(spark, f"{path}/_manifest")) == buckets.KEPT


def test_a_merge_reads_the_index_and_not_the_keys_of_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, x int, business_date date"
    start = [(i, 0, DAY0 + timedelta(days=i % 5)) for i in range(50)]
    merge_parts(spark, path, spark.createDataFrame(start, schema), ["k"])
    # A partition that no key of the batch is in can be unreadable: nothing looks into it.
    for file in (tmp_path / "t" / f"{PART_KEY}=d{DAY0 + timedelta(days=4)}").glob("*.parquet"):
        file.write_bytes(b"not parquet")
    batch = spark.createDataFrame([(0, 1, DAY0 + timedelta(days=1)), (5, 2, DAY0), (99, 3, DAY0)], schema)
    touched = merge_parts(spark, path, batch, ["k"])
    assert {r[0] for r in touched.collect()} == {f"d{DAY0}", f"d{DAY0 + timedelta(days=1)}"}
    good = spark.read.schema(f"{schema}, {PART_KEY} string").parquet(
        *[str(p) for p in (tmp_path / "t").glob(f"{PART_KEY}=*") if not str(p).endswith(str(DAY0 + timedelta(days=4)))]
    ).where("k is not null")
    got = {r.k: (r.x, r.business_date) for r in good.select("k", "x", "business_date").collect()}
    want = {k: (x, d) for k, x, d in start if k % 5 != 4}
    assert got == want | {0: (1, DAY0 + timedelta(days=1)), 5: (2, DAY0), 99: (3, DAY0)}


def test_index_is_right_after_a_merge_is_lost_before_it_is_updated(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k long, x int, business_date date"
    merge_parts(spark, path, spark.createDataFrame([(1, 0, DAY0), (2, 0, DAY0)], schema), ["k"])
    with monkeypatch.context() as m:
        m.setattr(tables, "merge_buckets", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost before the index")))
        with pytest.raises(RuntimeError, match="index"):
            merge_parts(spark, path, spark.createDataFrame([(1, 1, DAY0 + timedelta(days=3))], schema), ["k"])
    # Another batch moves the key on; its row must leave the place that the lost merge has put it in.
    merge_parts(spark, path, spark.createDataFrame([(1, 2, DAY0 + timedelta(days=6))], schema), ["k"])
    assert {(r.k, r.x, r.business_date) for r in read_parts(spark, path, ["k"]).collect()} == {
        (1, 2, DAY0 + timedelta(days=6)), (2, 0, DAY0)
    }
    places = buckets.read_buckets(spark, f"{path}/{INDEX}").collect()
    assert {(r.k, r[PART_KEY]) for r in places} == {(1, f"d{DAY0 + timedelta(days=6)}"), (2, f"d{DAY0}")}


@pytest.mark.parametrize("pattern, dropped", [("yyyy-MM-dd", 2), ("yyyy-MM", 0)])
def test_retention_drops_partitions_and_cuts_the_one_at_the_edge(spark, tmp_path, pattern, dropped):
    path, schema, layout = str(tmp_path / "t"), "k long, x int, business_date date", Layout(pattern)
    data = [(i, 0, DAY0 + timedelta(days=i)) for i in range(5)] + [(9, 0, None)]
    merge_parts(spark, path, spark.createDataFrame(data, schema), ["k"], layout)
    cutoff = DAY0 + timedelta(days=2)
    assert len(trim_parts(spark, path, ["k"], cutoff, layout)) == dropped
    assert trim_parts(spark, path, ["k"], cutoff, layout) == []  # repeating it changes nothing
    assert trim_parts(spark, path, ["k"], DAY0, layout) == []  # an earlier date brings nothing back
    assert {r.k for r in read_parts(spark, path, ["k"]).collect()} == {2, 3, 4, 9}
    assert {r.k for r in spark.read.parquet(path).where("k is not null").collect()} == {2, 3, 4, 9}
    # A late record from before the date is not shown either.
    merge_parts(spark, path, spark.createDataFrame([(1, 5, DAY0)], schema), ["k"], layout)
    assert {r.k for r in read_parts(spark, path, ["k"]).collect()} == {2, 3, 4, 9}


def test_first_days_and_summary_follow_late_corrections(spark, tmp_path, monkeypatch):
    """Increments equal a full rebuild after every load; only the months that the changes reach are rebuilt."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    land(raw, "locations", "r1", [{"location_id": "L1", "timezone": "America/New_York", "status": "ACTIVE"}])
    land(raw, "calendar", "r1", [{"date": str(DAY0 + timedelta(days=n - 5))} for n in range(140)])
    land(raw, "orders", "r1", [order(f"o{n}", n, f"c{n % 4}") for n in range(0, 100, 7)] + ["{broken", {"location_id": "L1"}])
    steps = [
        None,
        [order("o7", 7, "c3", state="CANCELED")],  # the first visit of c3 (day 7) goes; a later day becomes its first
        # An earlier visit again, a first order that moves far ahead, and the last order moves back: the summary ends earlier.
        [order("new", 30, "c3"), order("o0", 65, "c0"), order("o98", 20, "c2"), order("walk", 3, None)],
    ]
    reached = []
    for n, change in enumerate(steps):
        if change:
            land(raw, "orders", f"r{n + 1}", change)
        load_all(spark, str(raw), out, layout=MONTHS)
        reached.append(refresh_derived(spark, out, MONTHS))
        stored = load_tables(spark, out)
        assert rows(derived.stored_first_seen(spark, out)) == rows(customer_first_seen(stored["orders"])), n
        full = daily_summary(stored)
        assert rows(derived.read_summary(spark, out).select(*full.columns)) == rows(full), n
    assert reached[0] is None and reached[1] == {"2026-01", "2026-02"}
    assert all(months is not None for months in reached[1:])
    assert {r.line for r in read_rejected(spark, out, "orders").collect()} == {"{broken", '{"location_id": "L1"}'}
    # Nothing new: nothing is read, touched or rebuilt.
    opened = []
    monkeypatch.setattr("tillcast.plans.daily_batch.raw_lines", lambda *a: opened.append(a))
    assert load_all(spark, str(raw), out, layout=MONTHS)["orders"] == 0 and opened == []
    assert refresh_derived(spark, out, MONTHS) == set()
    assert ledger(spark, out).where("entity = 'orders'").count() == len(steps)
    # Retention: the summary of trimmed tables.
    gone = retain(spark, out, date(2026, 2, 15), MONTHS)
    assert gone["orders"] == 1
    refresh_derived(spark, out, MONTHS)
    stored = load_tables(spark, out)
    assert stored["orders"].agg(F.min("business_date")).first()[0] >= date(2026, 2, 15)
    assert rows(derived.stored_first_seen(spark, out)) == rows(customer_first_seen(stored["orders"]))
    full = daily_summary(stored)
    assert rows(derived.read_summary(spark, out).select(*full.columns)) == rows(full)


def test_months_are_literals_in_the_scan(spark, tmp_path):
    path, schema = str(tmp_path / "orders"), "k long, business_date date"
    data = [(i, DAY0 + timedelta(days=10 * i)) for i in range(12)]
    merge_parts(spark, path, spark.createDataFrame(data, schema), ["k"])
    part = derived.in_months(read_parts(spark, path, ["k"]), {"2026-02", "2026-03"}, Layout())
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "d2026-02-01" in plan and "d2026-03-31" in plan
    assert {r.k for r in part.collect()} == {k for k, d in data if d.month in (2, 3)}


def test_the_keys_of_a_batch_are_not_broadcast(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k string, x int, business_date date"
    plans = []

    def seen(module, name):
        stored = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **more: (plans.append(a), stored(*a, **more))[1])

    seen(tables, "write_parts")
    seen(buckets, "replace_buckets")
    for x in (1, 2):
        rows = [(str(i), x, date(2026, 1, 1 + i % 3)) for i in range(20)]
        merge_parts(spark, path, spark.createDataFrame(rows, schema), ["k"])
    written = [next(v for v in a if hasattr(v, "schema")) for a in plans]
    assert len(written) == 4
    for df in written:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.x for r in read_parts(spark, path, ["k"]).collect()} == {2}


def test_a_merge_moves_its_partitions_and_writes_them_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, x int, business_date date"
    for x in (1, 2):
        merge_parts(spark, path, spark.createDataFrame([("a", x, DAY0), ("b", x, DAY0 + timedelta(days=x))], schema), ["k"])
        assert [p.name for p in (tmp_path / "t" / "_pending").iterdir() if not p.name.startswith((".", "_"))] == []
    assert {(r.k, r.x, r.business_date.day) for r in read_parts(spark, path, ["k"]).collect()} == {("a", 2, 10), ("b", 2, 12)}
    # A run lost among the moves: what is still pending is put in place, what is not stays.
    (tmp_path / "t" / f"{PART_KEY}=d2026-01-12").rename(tmp_path / "t" / "_pending" / f"{PART_KEY}=d2026-01-12")
    (tmp_path / "t" / "_pending" / "_SUCCESS").touch()
    tables.replay_pending(spark, path)
    assert {(r.k, r.x) for r in read_parts(spark, path, ["k"]).collect()} == {("a", 2), ("b", 2)}


def test_landed_files_are_compressed_and_only_rejected_lines_keep_their_text(spark, tmp_path):
    spec = BY_ENTITY["orders"]
    rows = spark.range(3).selectExpr("cast(id as string) as order_id", "'L1' as location_id")
    landing.land(rows, str(tmp_path), "orders", "r1")
    (tmp_path / "orders" / "orders-r2.jsonl").write_text("{broken\n")
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "orders" / "orders-r1.jsonl").glob("part-*"))
    judged = landing.judge_lines(landing.raw_lines(spark, str(tmp_path), "orders"), spec).collect()
    assert sorted((r.order_id or "", r._text or "") for r in judged) == [("", "{broken"), ("0", ""), ("1", ""), ("2", "")]


def test_what_is_stored_is_small(spark, tmp_path):
    merge_parts(spark, str(tmp_path / "t"), spark.createDataFrame([("a", 1, DAY0)], "k string, x int, business_date date"), ["k"])
    names = [p.name for p in (tmp_path / "t").rglob("part-*.parquet") if "_manifest" not in str(p)]
    assert names and all(name.endswith(".zstd.parquet") for name in names)

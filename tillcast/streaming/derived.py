"""Tables derived from stored facts, kept fresh from change sets.

A merge reports the partitions it touched. From there changes are carried on: the daily rollup of those partitions, the
days on which customers were seen there, the customers whose first day has moved, and with it the other days on which
they now count as new or no longer do, and at last the months of the daily summary that hold any of these days.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.rollups import DAY, daily_sales, is_sale
from tillcast.operators.summary import daily_summary
from tillcast.session import materialize
from tillcast.sources.buckets import (
    BUCKET,
    COUNT,
    bucket_of,
    read_buckets,
    read_if_present,
    remove,
    replace_buckets,
    state,
)
from tillcast.sources.tables import PART_KEY, UNDATED, Layout, of_parts, part_keys, read_parts, replay_pending, write_parts

ROLLUP, VISITS, CUSTOMER_DAYS, SUMMARY = "daily_sales", "customer_visits", "customer_days", "daily_summary"
MOVED = "_moved"


def refresh_daily_sales(spark: SparkSession, out_dir: str, touched: DataFrame, layout: Layout) -> None:
    """Recompute the daily rollup of the touched partitions only."""
    days = of_parts(read_parts(spark, f"{out_dir}/orders", ["order_id"]), touched)
    rollup = daily_sales(days).withColumn(PART_KEY, layout.key())
    write_parts(rollup, f"{out_dir}/{ROLLUP}", touched)


def current_daily_sales(spark: SparkSession, out_dir: str) -> DataFrame:
    return read_parts(spark, f"{out_dir}/{ROLLUP}", DAY).drop(PART_KEY)


def _visits(orders: DataFrame) -> DataFrame:
    """The days on which each customer bought something, at whatever location."""
    seen = is_sale() & F.col("customer_id").isNotNull() & F.col("business_date").isNotNull()
    return orders.where(seen).select("customer_id", "business_date").distinct()


def refresh_first_seen(spark: SparkSession, out_dir: str, touched: DataFrame, layout: Layout) -> DataFrame:
    """Bring the first day of every customer up to date and return the days (business_date) whose count of new
    customers changes although they may not have been touched.

    The visits of the touched partitions are compared with those stored for them; what differs is the change set. Each
    customer's days are kept as one sorted list in hash buckets, so an added day, and also a first day that is canceled
    or moves, needs the buckets of the changed customers and no other history. A list is as long as the days on which
    the shop was open, even for a customer number that stands for a third of all orders.

    The days are stored before the lists change and returned until ``forget_moved``, and the visits are replaced last: a
    run that is lost finds the same change set again.
    """
    replay_pending(spark, f"{out_dir}/{VISITS}")
    orders = of_parts(read_parts(spark, f"{out_dir}/orders", ["order_id"]), touched)
    now = materialize(_visits(orders), "visits")
    stored = read_parts(spark, f"{out_dir}/{VISITS}", ["customer_id"])
    keys = ["customer_id", "business_date"]
    before = now.where("false") if stored is None else of_parts(stored, touched).select(*keys)
    day, new = F.col("business_date"), F.col("new")
    both = now.select(*keys, F.lit(True).alias("new")).unionByName(before.select(*keys, F.lit(False).alias("new")))
    # One shuffle of both sides: a customer's days are gathered in any case.
    changes = both.groupBy("customer_id").agg(
        F.collect_set(F.when(new, day)).alias("now"), F.collect_set(F.when(~new, day)).alias("then")
    ).select(
        "customer_id", F.array_except("now", "then").alias("added"), F.array_except("then", "now").alias("gone")
    ).where((F.size("added") > 0) | (F.size("gone") > 0))
    at = f"{out_dir}/{CUSTOMER_DAYS}"
    kept = state(spark, at)
    count = kept.count or COUNT
    changes = materialize(changes.withColumn(BUCKET, bucket_of(["customer_id"], count)), "changes")
    buckets = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # at most ``count`` numbers
    if buckets:
        lists = read_buckets(spark, at, buckets, kept)
        if lists is None:
            lists = changes.select("customer_id", F.col("added").alias("days")).where("false")
        none = F.array().cast("array<date>")
        joined = lists.join(changes, "customer_id", "full").select(
            "customer_id", F.get("days", 0).alias("was"),
            F.array_sort(F.array_union(
                F.array_except(F.coalesce("days", none), F.coalesce("gone", none)), F.coalesce("added", none)
            )).alias("days"),
        )
        joined = materialize(joined, "customer-days")
        was, is_now = F.col("was"), F.get("days", 0)
        moved = joined.where(~was.eqNullSafe(is_now)).select(F.explode(F.array(was, is_now)).alias("business_date"))
        moved.where("business_date is not null").distinct().write.mode("append").parquet(f"{out_dir}/{MOVED}")
        rows = joined.where(F.size("days") > 0).select("customer_id", "days", bucket_of(["customer_id"], count).alias(BUCKET))
        replace_buckets(spark, at, rows, buckets, count, kept)
    write_parts(now.withColumn(PART_KEY, layout.key()), f"{out_dir}/{VISITS}", touched)
    return moved_days(spark, out_dir)


def moved_days(spark: SparkSession, out_dir: str) -> DataFrame:
    """Days on which customers began or ceased to be new since ``forget_moved``."""
    stored = read_if_present(spark, f"{out_dir}/{MOVED}")
    return spark.createDataFrame([], "business_date date") if stored is None else stored.distinct()


def forget_moved(spark: SparkSession, out_dir: str) -> None:
    """All that depends on the moved days is up to date."""
    remove(spark, f"{out_dir}/{MOVED}")


def stored_first_seen(spark: SparkSession, out_dir: str) -> DataFrame:
    """(customer_id, first_date), equal to ``customer_first_seen`` over all orders without reading any."""
    lists = read_buckets(spark, f"{out_dir}/{CUSTOMER_DAYS}")
    if lists is None:
        return spark.createDataFrame([], "customer_id string, first_date date")
    return lists.select("customer_id", F.get("days", 0).alias("first_date"))


def last_order_date(spark: SparkSession, out_dir: str) -> date | None:
    """The last dated order, canceled ones too: read from the newest partitions until one holds a row."""
    path = f"{out_dir}/orders"
    stored = read_if_present(spark, path)
    for key in [] if stored is None else sorted(set(part_keys(stored)) - {UNDATED}, reverse=True):
        newest = read_parts(spark, path, ["order_id"]).where(F.col(PART_KEY) == key).agg(F.max("business_date")).first()[0]
        if newest is not None:
            return newest
    return None


def _months(first: date, last: date) -> set[str]:
    out, day = set(), first.replace(day=1)
    while day <= last:
        out.add(str(day)[:7])
        day = (day + timedelta(days=32)).replace(day=1)
    return out


def months_of(touched: list[str], days: list[date]) -> set[str]:
    """Months that hold the touched partitions and the days. A partition by year stands for its twelve months."""
    out = {str(d)[:7] for d in days}
    for key in set(touched) - {UNDATED}:
        out |= {key[1:8]} if len(key) > 5 else {f"{key[1:]}-{m:02d}" for m in range(1, 13)}
    return out


def in_months(table: DataFrame, months: set[str], layout: Layout) -> DataFrame:
    """Rows of a stored fact table in ``months``: partitions first, by literals the scan can use, then dates."""
    parts = F.lit(False)
    for first, last in _runs(months):
        parts |= layout.reach(first, last)
    dates = F.lit(False)
    for first, last in _runs(months):
        dates |= F.col("business_date").between(F.lit(first), F.lit(last))
    return table.where(parts & dates) if PART_KEY in table.columns else table.where(dates)


def _runs(months: set[str]) -> list[tuple[date, date]]:
    """First and last day of each run of consecutive months."""
    out: list[tuple[date, date]] = []
    for month in sorted(months):
        first = date.fromisoformat(f"{month}-01")
        last = (first + timedelta(days=32)).replace(day=1) - timedelta(days=1)
        if out and out[-1][1] + timedelta(days=1) == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


FACTS = ("orders", "order_items", "payments", "refunds", "shifts")


def _write_months(summary: DataFrame, path: str, months: list[str] | None) -> None:
    """Replace whole months of the stored summary, or all of it; a listed month without rows becomes empty."""
    spark = summary.sparkSession
    rows = summary.withColumn("month", F.date_format("business_date", "yyyy-MM"))
    writer = rows
    if months is not None:
        blank = [F.lit(None).cast(kind).alias(name) for name, kind in summary.dtypes]
        marks = spark.createDataFrame([(m,) for m in months], "month string").select(*blank, "month")
        writer = rows.unionByName(marks)
    (
        writer.hint("rebalance", "month").write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if months is None else "dynamic").partitionBy("month").parquet(path)
    )


def read_summary(spark: SparkSession, out_dir: str) -> DataFrame | None:
    stored = read_if_present(spark, f"{out_dir}/{SUMMARY}")
    return None if stored is None else stored.where("location_id is not null").drop("month")


def build_summary(
    spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str, months: set[str] | None = None,
    layout: Layout = Layout(), since: date | None = None,
) -> DataFrame:
    """Rebuild the stored summary, or the months given, or those from ``since`` on; returns the stored table.

    Of the facts only the partitions of those months are read, which stand in the plan as literals; first days come
    from the stored lists where they are kept, and the end of the calendar from the newest partition.
    """
    last = last_order_date(spark, out_dir)
    if since is not None and last is not None:
        months = _months(since, max(since, last)) | (months or set())
    chosen = dict(tables)
    if months is not None:
        for name in FACTS:
            chosen[name] = in_months(tables[name], months, layout)
        dates = F.lit(False)
        for first, final in _runs(months):
            dates |= F.col("date").between(F.lit(first), F.lit(final))
        chosen["calendar_days"] = tables["calendar_days"].where(dates)
    known = read_buckets(spark, f"{out_dir}/{CUSTOMER_DAYS}")
    first_seen = None if known is None else stored_first_seen(spark, out_dir)
    if months is not None and first_seen is None:
        raise RuntimeError("rebuilding some months needs the stored first days; refresh_first_seen keeps them")
    summary = daily_summary(chosen, first_seen=first_seen, last=last)
    _write_months(summary, f"{out_dir}/{SUMMARY}", None if months is None else sorted(months))
    return read_summary(spark, out_dir)


def refresh_summary(
    spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str, touched: list[str], layout: Layout = Layout(),
) -> set[str] | None:
    """Rebuild the months of the summary that a change set reaches, and return them; None when all were rebuilt.

    Reached are the months of the touched partitions of any fact table, of the days that customers' first visits have
    moved from or to, and those between the old end of the summary and the new one. Where the summary does not exist
    yet, or calendar or locations have changed, everything is rebuilt.
    """
    spine = tables["locations"].select(F.concat(F.lit("l"), "location_id").alias("k")).unionByName(
        tables["calendar_days"].select(F.concat(F.lit("d"), F.col("date").cast("string")).alias("k"))
    ).agg(F.count("k"), F.sum(F.xxhash64("k").cast("decimal(38,0)"))).first()
    sign = f"{spine[0]}:{spine[1]}"
    mark = f"{out_dir}/_spine"
    seen = read_if_present(spark, mark)
    before = read_summary(spark, out_dir)
    end = None if before is None else before.agg(F.max("business_date")).first()[0]
    last = last_order_date(spark, out_dir)
    known = read_buckets(spark, f"{out_dir}/{CUSTOMER_DAYS}")
    if end is None or last is None or known is None or seen is None or seen.first()[0] != sign:
        months = None
    else:
        days = [r[0] for r in moved_days(spark, out_dir).collect()]  # at most one row for each day of the history
        months = months_of(touched, days)
        if end != last:
            months |= _months(min(end, last), max(end, last))
    if months is None or months:
        build_summary(spark, tables, out_dir, months, layout)
    spark.createDataFrame([(sign,)], "sign string").coalesce(1).write.mode("overwrite").parquet(mark)
    forget_moved(spark, out_dir)
    return months

"""Parquet tables with keyed upsert.

Fact tables are partitioned by trading day (or month, or year); a merge rewrites only the partitions it touches and finds
them in an index of key locations, of which it reads only the buckets of its own keys. Dimension tables are kept in
hash buckets, of which a merge rewrites those its rows fall into.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import STORED_AS, materialize
from tillcast.sources.buckets import (
    BUCKET,
    COUNT,
    bucket_of,
    file_system,
    folders,
    keys_of,
    merge_buckets,
    read_buckets,
    read_if_present,
    remove,
    replace_buckets,
    state,
)

PART_KEY = "part_key"
UNDATED = "undated"
# Folders inside a table's that readers skip.
PENDING, PENDING_KEYS, TOUCHED, INDEX, RETAINED = "_pending", "_pending_keys", "_touched", "_index", "_retained"


@dataclass(frozen=True)
class Layout:
    """How a fact table is cut: the date pattern of a partition.

    A large history is cut by day, so that a correction rewrites one day; a small one by month or year, so that files
    do not become tiny. The number of files inside a partition follows its size.
    """

    pattern: str = "yyyy-MM-dd"

    def key(self, column: str = "business_date") -> Column:
        """Partition value; rows without a date share a partition of their own. The leading letter keeps
        the value text when the partition column is read back."""
        return F.coalesce(F.concat(F.lit("d"), F.date_format(column, self.pattern)), F.lit(UNDATED))

    def of(self, day: date) -> str:
        """Partition value of one day."""
        return "d" + str(day)[: len(self.pattern)]

    def reach(self, first: date, last: date | None = None) -> Column:
        """The partitions of the days from ``first`` to ``last``, as a filter of literals on the partition column."""
        return F.col(PART_KEY).between(self.of(first), "e" if last is None else self.of(last))


def read_parts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """Rows of a partitioned table, without the markers of emptied partitions and without rows that retention has
    dropped."""
    stored = read_if_present(spark, path)
    if stored is None:
        return None
    rows = stored.where(F.col(keys[0]).isNotNull())
    kept = retained_from(spark, path)
    return rows if kept is None else rows.where(F.col("business_date").isNull() | (F.col("business_date") >= F.lit(kept)))


def part_keys(stored: DataFrame) -> list[str]:
    """The partitions of a table, from the file names its scan has listed already."""
    mark = f"/{PART_KEY}="
    return sorted({name.split(mark)[1].split("/")[0] for name in stored.inputFiles() if mark in name})


def of_parts(stored: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of some partitions, as literals that prune the scan: a join with a table of partitions does not."""
    listed = sorted(r[0] for r in parts.select(PART_KEY).distinct().collect())  # partitions, not rows
    return stored.where(F.col(PART_KEY).isin(listed) if listed else F.lit(False))


def write_parts(rows: DataFrame, path: str, parts: DataFrame, located: DataFrame | None = None) -> None:
    """Replace the partitions listed in ``parts`` with ``rows``; ``located`` are keys to enter in the table's index.

    Tasks follow the size of the data: a busy day is several, quiet ones share one. Every listed partition also gets a
    marker row of nulls: a partition whose rows have all moved elsewhere is thereby overwritten too, instead of
    keeping its stale rows.
    """
    markers = parts.select(
        *[F.lit(None).cast(kind).alias(name) for name, kind in rows.dtypes if name != PART_KEY], PART_KEY
    ).select(*rows.columns)
    spark = rows.sparkSession
    # Finished partitions are stored beside the table first, so a run that is lost while they replace the old ones
    # leaves them to be put in place by the next one, with the places of their keys.
    remove(spark, f"{path}/{PENDING_KEYS}")
    if located is not None:
        located.write.option("compression", STORED_AS).parquet(f"{path}/{PENDING_KEYS}")
    (
        rows.unionByName(markers)
        .hint("rebalance", PART_KEY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", STORED_AS)
        .partitionBy(PART_KEY)
        .parquet(f"{path}/{PENDING}")
    )
    replay_pending(spark, path)


def replay_pending(spark: SparkSession, path: str) -> None:
    """Move completed pending partitions to their place and enter their keys; repeating it changes nothing.

    They are moved as folders, not written again: one that is no longer pending is in its place.

    The index follows the table: a key whose old place is still listed is only looked for once more, while a key
    listed too early would be left in its old place.
    """
    files, mark = file_system(spark, f"{path}/{PENDING}/_SUCCESS")
    if files.exists(mark):
        for name in folders(spark, f"{path}/{PENDING}"):
            if name.startswith(f"{PART_KEY}="):
                _, done = file_system(spark, f"{path}/{PENDING}/{name}")
                _, place = file_system(spark, f"{path}/{name}")
                files.delete(place, True)
                if not files.rename(done, place):
                    raise RuntimeError(f"{name} of {path} could not be moved to its place")
        located = read_if_present(spark, f"{path}/{PENDING_KEYS}")
        if located is not None:
            merge_buckets(spark, f"{path}/{INDEX}", located, [c for c in located.columns if c != PART_KEY])
        files.delete(mark, False)


def forget_touched(spark: SparkSession, path: str) -> None:
    """All that depends on the touched partitions is up to date."""
    remove(spark, f"{path}/{TOUCHED}")


def _located(spark: SparkSession, path: str, stored: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame | None:
    """Where the keys of ``newest`` are stored: (keys, PART_KEY) from the buckets of the index they fall into.

    A table without an index gets one from its key columns, once.
    """
    at = f"{path}/{INDEX}"
    now = state(spark, at)
    if now.count is None:
        whole = stored.select(*keys, PART_KEY).withColumn(BUCKET, bucket_of(keys, COUNT))
        replace_buckets(spark, at, whole, list(range(COUNT)), COUNT, now)
        now = state(spark, at)
    buckets = newest.select(bucket_of(keys, now.count).alias("b")).distinct().collect()
    return read_buckets(spark, at, [r.b for r in buckets], now)


def merge_parts(
    spark: SparkSession, path: str, batch: DataFrame, keys: list[str], layout: Layout = Layout(),
    remember: bool = False,
) -> DataFrame:
    """Upsert ``batch`` (one row per key, typed, with business_date) and return the touched partitions.

    Touched are the partitions of the batch and those its keys were stored in before, found in the index. There is no
    lateness limit. Repeating a merge changes nothing.

    With ``remember`` the touched partitions are stored before the table changes and returned again by later merges
    until ``forget_touched``: a merge repeated after a failure no longer finds where its keys were before.
    """
    replay_pending(spark, path)
    newest = materialize(batch.withColumn(PART_KEY, layout.key()), "merge-batch")
    stored = read_parts(spark, path, keys)
    parts = newest.select(PART_KEY)
    if stored is not None:
        located = _located(spark, path, stored, newest, keys)
        if located is not None:
            moved = located.join(keys_of(newest, keys), keys, "left_semi").select(PART_KEY)
            parts = parts.unionByName(moved)
    touched = materialize(parts.distinct(), "merge-parts")
    if stored is None:
        rows = newest
    else:
        kept = of_parts(stored, touched).join(keys_of(newest, keys), keys, "left_anti")
        rows = kept.unionByName(newest, allowMissingColumns=True).select(*newest.columns)
    if remember:
        touched.write.mode("append").parquet(f"{path}/{TOUCHED}")
    write_parts(rows, path, touched, newest.select(*keys, PART_KEY))
    return remembered(spark, path) if remember else touched


def remembered(spark: SparkSession, path: str) -> DataFrame | None:
    """Partitions touched by merges since ``forget_touched``; None when there are none."""
    stored = read_if_present(spark, f"{path}/{TOUCHED}")
    return None if stored is None else stored.distinct()


def retained_from(spark: SparkSession, path: str) -> date | None:
    """The date from which a table's rows are kept; None without retention."""
    days = [name.split("=")[1] for name in folders(spark, f"{path}/{RETAINED}") if name.startswith("from=")]
    return date.fromisoformat(max(days)) if days else None


def trim_parts(spark: SparkSession, path: str, keys: list[str], cutoff: date, layout: Layout = Layout()) -> list[str]:
    """Drop the rows dated before ``cutoff`` from a stored table; returns the partitions that were dropped.

    The date is marked first, and readers leave older rows out from then on. Whole partitions are then removed as
    folders; the one that the date cuts is rewritten. A lost run is completed by the next one, and repeating it
    changes nothing. An earlier date than before does not bring rows back. Undated rows stay.
    """
    replay_pending(spark, path)
    stored = read_if_present(spark, path)
    if stored is None:
        return []
    before = retained_from(spark, path)
    cutoff = max(cutoff, before) if before else cutoff
    files, at = file_system(spark, f"{path}/{RETAINED}/from={cutoff}")
    files.mkdirs(at)
    edge, present = layout.of(cutoff), part_keys(stored)
    old = [k for k in present if k != UNDATED and k < edge]
    if edge in present and layout.of(cutoff - timedelta(days=1)) == edge:  # the date lies inside a partition
        rows = read_parts(spark, path, keys).where(F.col(PART_KEY) == edge)
        write_parts(rows, path, spark.createDataFrame([(edge,)], f"{PART_KEY} string"))
    for key in old:
        remove(spark, f"{path}/{PART_KEY}={key}")
    return old


def read_dimension(spark: SparkSession, path: str) -> DataFrame | None:
    return read_buckets(spark, path)


def merge_dimension(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str]) -> list[int]:
    """Upsert into a dimension; returns the buckets that were rewritten."""
    return merge_buckets(spark, path, batch, keys, order)

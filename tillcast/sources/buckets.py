"""Keyed tables in hash buckets, replaced bucket by bucket.

A table is cut by a hash of its key. A merge reads and rewrites only the buckets its batch falls into; each version of a
bucket has a folder of its own, and a manifest of one file lists which version of every bucket counts. The manifest is
written last and appears as a whole, so it is the mark of completion: what a lost run has left is never read, and a
reader that has begun keeps the versions it has seen. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.ingest import latest_by_key
from tillcast.session import STORED_AS, materialize

BUCKET = "__bucket"
COUNT = 64
DATA, MANIFEST = "data", "_manifest"
# Manifests, with the versions they list, that stay for readers that have begun.
KEPT = 3


def read_if_present(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def file_system(spark: SparkSession, path: str):
    """File system and path object of a name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside a folder."""
    files, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def bucket_of(keys: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def keys_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a batch as one side of a join that is sorted, never gathered by the driver.

    Spark takes the keys of a stored batch for their share of its compressed bytes, and would broadcast millions.
    """
    return rows.select(*keys).hint("merge")


@dataclass(frozen=True)
class State:
    """The newest manifest: its version, the number of buckets (None: no table yet), and bucket -> version of its rows."""

    version: int
    count: int | None
    buckets: dict[int, int]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete: it is one file, which is there or not."""
    return sorted(int(name.split("=")[1]) for name in folders(spark, f"{path}/{MANIFEST}"))


def _manifest(spark: SparkSession, path: str, version: int) -> State | None:
    stored = read_if_present(spark, f"{path}/{MANIFEST}/version={version}", schema="bucket int, data bigint, count int")
    rows = [] if stored is None else stored.collect()  # at most a row for each bucket
    if not rows:
        return None
    return State(version, rows[0]["count"], {r["bucket"]: r["data"] for r in rows if r["bucket"] is not None})


def state(spark: SparkSession, path: str) -> State:
    for version in reversed(_versions(spark, path)):
        found = _manifest(spark, path, version)
        if found is not None:
            return found
    return State(0, None, {})


def bucket_count(spark: SparkSession, path: str, wanted: int = COUNT) -> int:
    """The number of buckets a table has been made with, or ``wanted`` for a new one."""
    return state(spark, path).count or wanted


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None, at: State | None = None) -> DataFrame | None:
    """The table, or the listed buckets of it; None when there is nothing to read."""
    listed = (at or state(spark, path)).buckets
    chosen = sorted(listed if only is None else set(only) & listed.keys())
    if not chosen:
        return None
    return spark.read.parquet(*[f"{path}/{DATA}/version={listed[b]}/{BUCKET}={b}" for b in chosen])


def replace_buckets(
    spark: SparkSession, path: str, rows: DataFrame, touched: list[int], count: int, at: State | None = None
) -> None:
    """Make ``rows`` (with a column ``BUCKET``) the whole content of the buckets ``touched``."""
    now = at or state(spark, path)
    version = now.version + 1
    target = f"{path}/{DATA}/version={version}"
    rows.hint("rebalance", BUCKET).write.mode("overwrite").option("compression", STORED_AS).partitionBy(BUCKET).parquet(target)
    filled = {int(name.split("=")[1]) for name in folders(spark, target) if name.startswith(f"{BUCKET}=")}
    kept = {b: v for b, v in now.buckets.items() if b not in set(touched)} | {b: version for b in filled}
    entries = [(b, v, count) for b, v in sorted(kept.items())] or [(None, None, count)]
    spark.createDataFrame(entries, "bucket int, data bigint, count int").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/{MANIFEST}/version={version}"
    )
    _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove manifests beyond the last ones and the versions that none of those lists."""
    versions = _versions(spark, path)
    kept = versions[-KEPT:]
    if kept == versions:
        return
    needed = {v for m in kept for v in (_manifest(spark, path, m) or State(0, None, {})).buckets.values()}
    for m in versions[:-KEPT]:
        remove(spark, f"{path}/{MANIFEST}/version={m}")
    for name in folders(spark, f"{path}/{DATA}"):
        version = int(name.split("=")[1])
        if version not in needed and version <= kept[-1]:
            remove(spark, f"{path}/{DATA}/{name}")


def merge_buckets(
    spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str] = (), count: int = COUNT,
) -> list[int]:
    """Upsert ``batch`` and return the buckets it touched; inside the batch the highest ``order`` of a key wins.

    ``order`` columns are not stored. Merging a batch again changes nothing; an empty one writes nothing.
    """
    now = state(spark, path)
    count = now.count or count
    newest = latest_by_key(batch, keys, list(order) or [F.lit(1)]).drop(*order)
    newest = materialize(newest.withColumn(BUCKET, bucket_of(keys, count)), "bucket-batch")
    touched = sorted(r[0] for r in newest.select(BUCKET).distinct().collect())  # at most ``count`` numbers
    if not touched:
        return touched
    stored = read_buckets(spark, path, touched, now)
    rows = newest
    if stored is not None:
        kept = stored.join(keys_of(newest, keys), keys, "left_anti").withColumn(BUCKET, bucket_of(keys, count))
        rows = kept.unionByName(newest, allowMissingColumns=True).select(*newest.columns)
    replace_buckets(spark, path, rows, touched, count, now)
    return touched

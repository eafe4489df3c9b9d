"""Incremental ingest as Structured Streaming.

Landed files are the source and the checkpoint is the ledger: a file is read once, a restart repeats at
most one micro-batch, and every step of a micro-batch can be repeated without changing the result.
Corrections have no lateness limit, so there is no watermark on this path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.joins import Lookup
from tillcast.functions.trading_day import CUTOFF_HOUR
from tillcast.operators.ingest import expand_children, latest_by_key, typed_rows, with_defaults
from tillcast.schemas import EntitySpec
from tillcast.session import materialize
from tillcast.sources.landing import FILE_ORDER, RUN_FILE, judge_lines, store_rejected
from tillcast.sources.tables import Layout, forget_touched, merge_dimension, merge_parts, read_parts
from tillcast.streaming.derived import current_daily_sales, refresh_daily_sales, refresh_first_seen, refresh_summary

__all__ = ["current_daily_sales", "ingest_orders", "landed_stream", "merge_landed", "merge_rows", "run_ingest"]


def landed_stream(spark: SparkSession, raw_dir: str, entity: str, files_per_batch: int = 1000) -> DataFrame:
    """New landed lines with the file and block they come from."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(f"{raw_dir}/{entity}/{entity}-*.jsonl")
        .select(
            "value",
            F.regexp_extract("_metadata.file_path", RUN_FILE, 1).alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def merge_landed(
    spark: SparkSession, lines: DataFrame, out_dir: str, spec: EntitySpec, zones: Lookup | None,
    cutoff_hour: int = CUTOFF_HOUR, layout: Layout = Layout(), remember: bool = False,
) -> DataFrame | None:
    """Parse, type and upsert a set of landed lines; the last line of a key wins. Returns the touched partitions
    of a fact table. Lines that cannot be read or have no key go to the quarantine."""
    judged = materialize(judge_lines(lines, spec), "judged")
    store_rejected(judged, out_dir, spec.entity)
    return merge_rows(spark, judged, out_dir, spec, zones, cutoff_hour, layout, remember)


def merge_rows(
    spark: SparkSession, judged: DataFrame, out_dir: str, spec: EntitySpec, zones: Lookup | None,
    cutoff_hour: int = CUTOFF_HOUR, layout: Layout = Layout(), remember: bool = False,
) -> DataFrame | None:
    """Upsert the good ones of judged lines; see ``merge_landed``."""
    keyed = judged.where("_reason is null").drop("_reason", "_text")
    order = list(FILE_ORDER)
    if not spec.is_fact:
        rows = typed_rows(keyed, spec, zones, cutoff_hour)
        merge_dimension(spark, f"{out_dir}/{spec.table}", rows, list(spec.keys), list(FILE_ORDER))
        if spec.child:
            merge_dimension(
                spark, f"{out_dir}/{spec.child.table}", _child_rows(keyed, spec, *FILE_ORDER),
                list(spec.child.keys), list(FILE_ORDER),
            )
        return None
    nested = ("modifiers",) if spec.child else ()
    rows = typed_rows(keyed, spec, zones, cutoff_hour, keep=nested)
    newest = latest_by_key(rows.drop(*nested), list(spec.keys), order).drop(*FILE_ORDER)
    touched = merge_parts(spark, f"{out_dir}/{spec.table}", newest, list(spec.keys), layout, remember)
    if spec.child:
        # Children are stored under the day of their parent.
        child = _child_rows(rows, spec, "business_date", *FILE_ORDER)
        newest = latest_by_key(child, list(spec.child.keys), order).drop(*FILE_ORDER)
        merge_parts(spark, f"{out_dir}/{spec.child.table}", newest, list(spec.child.keys), layout)
    return touched


def _child_rows(parents: DataFrame, spec: EntitySpec, *carry: str) -> DataFrame:
    rows = expand_children(parents, spec.child, *carry).dropna(subset=list(spec.child.keys))
    return with_defaults(rows, spec.child.defaults)


def run_ingest(
    spark: SparkSession, raw_dir: str, out_dir: str, spec: EntitySpec, zones: Lookup | None,
    after: Callable[[DataFrame], None] | None = None, files_per_batch: int = 1000,
    layout: Layout = Layout(),
) -> None:
    """Process everything that landed since the last run, then stop.

    ``after`` receives the touched partitions of each micro-batch, for example to refresh a rollup.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # The line number inside a split; the batch reads each split in order.
        lines = batch.withColumn("_line", F.monotonically_increasing_id())
        touched = merge_landed(batch.sparkSession, lines, out_dir, spec, zones, layout=layout, remember=True)
        if after is not None and touched is not None:
            after(touched)
        if touched is not None:
            forget_touched(batch.sparkSession, f"{out_dir}/{spec.table}")

    query = (
        landed_stream(spark, raw_dir, spec.entity, files_per_batch)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{out_dir}/_checkpoints/{spec.entity}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_orders(
    spark: SparkSession, raw_dir: str, out_dir: str, spec: EntitySpec, zones: Lookup,
    files_per_batch: int = 1000, layout: Layout = Layout(),
    others: Callable[[], Mapping[str, DataFrame]] | None = None,
) -> None:
    """Orders with a rollup that is always fresh.

    With ``others``, which gives the other tables of the summary, the customers' first days and the daily summary are
    kept fresh as well: of the summary the months that a micro-batch reaches, not only those it touches.
    """

    def refresh(touched: DataFrame) -> None:
        refresh_daily_sales(spark, out_dir, touched, layout)
        if others is not None:
            refresh_first_seen(spark, out_dir, touched, layout)
            tables = dict(others()) | {"orders": read_parts(spark, f"{out_dir}/{spec.table}", list(spec.keys))}
            refresh_summary(spark, tables, out_dir, [r[0] for r in touched.collect()], layout)

    run_ingest(spark, raw_dir, out_dir, spec, zones, after=refresh, files_per_batch=files_per_batch, layout=layout)

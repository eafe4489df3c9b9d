"""The daily job: landed files to tables, summary, gate, features and forecasts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.trading_day import CUTOFF_HOUR, location_zones
from tillcast.operators import forecast, ridge
from tillcast.operators.features import assert_no_leakage, feature_columns
from tillcast.operators.ridge import REFITS
from tillcast.operators.rollups import DAY
from tillcast.operators.splits import apply_scaler, feature_table, fit_scaler, manifest_document
from tillcast.operators.validate import checked_report, raise_if_blocked, require_trading_days
from tillcast.schemas import BY_ENTITY, ENTITIES, INSTANT_FIELDS, EntitySpec, field_names
from tillcast.session import materialize, pin_utc
from tillcast.sources.landing import judge_lines, landed_files, raw_lines, store_rejected
from tillcast.sources.tables import (
    PART_KEY,
    TOUCHED,
    Layout,
    forget_touched,
    part_keys,
    read_dimension,
    read_if_present,
    read_parts,
    remembered,
    trim_parts,
)
from tillcast.streaming.derived import FACTS, read_summary, refresh_first_seen, refresh_summary
from tillcast.streaming.incremental import merge_rows

LEDGER = "ingested_files"
MIN_TRAIN_ROWS = 30
MODEL = "model"


def ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """(path, entity, rows, loaded_at), the newest entry of each file."""
    stored = read_if_present(spark, f"{out_dir}/{LEDGER}")
    if stored is None:
        return spark.createDataFrame([], "path string, entity string, rows bigint, loaded_at timestamp")
    return stored.groupBy("path", "entity").agg(F.max_by("rows", "loaded_at").alias("rows"),
                                               F.max("loaded_at").alias("loaded_at"))


def _pending(spark: SparkSession, raw_dir: str, out_dir: str, spec: EntitySpec, force: bool) -> DataFrame | None:
    """(path, run) of the files that are not in the ledger yet; None when there are none.

    Files are listed and compared by name, so a run without news opens none of them.
    """
    files = landed_files(spark, raw_dir, spec.entity)
    if files is None:
        return None
    if not force:
        files = files.join(ledger(spark, out_dir).select("path"), "path", "left_anti")
    files = materialize(files, "pending")
    return None if files.isEmpty() else files


def empty_table(spark: SparkSession, spec: EntitySpec) -> DataFrame:
    """An empty table of an entity that has never landed, with the types a load would give."""
    landed = spark.createDataFrame([], spec.landing)
    kinds = dict(landed.dtypes)
    dated = {"business_date": "date", "business_hour": "int", "ingested_at": "timestamp", "date": "date"}

    def kind(name: str) -> str:
        if name in dated:
            return dated[name]
        if name in INSTANT_FIELDS and name in field_names(spec.landing):
            return "timestamp"
        return "int" if kinds[name] == "boolean" else kinds[name]

    # The filter tells the planner that there are no rows. It would take a table of unknown size for a large one and sort all
    # orders by their few locations to look up zones that are not there.
    return spark.createDataFrame([], ", ".join(f"`{c}` {kind(c)}" for c in spec.columns)).where(F.lit(False))


def read_child(spark: SparkSession, out_dir: str, spec: EntitySpec) -> DataFrame | None:
    path, child = f"{out_dir}/{spec.child.table}", spec.child
    stored = read_parts(spark, path, list(child.keys)) if spec.is_fact else read_dimension(spark, path)
    return None if stored is None else stored.select(*child.columns)


def load_tables(spark: SparkSession, out_dir: str, parts: bool = False) -> dict[str, DataFrame]:
    """The stored tables; with ``parts`` facts keep their partition column, so that filters on it can prune."""
    tables = {}
    for spec in ENTITIES:
        path = f"{out_dir}/{spec.table}"
        if spec.is_fact:
            stored = read_parts(spark, path, list(spec.keys))
            tables[spec.table] = empty_table(spark, spec) if stored is None else stored
            if not parts:
                tables[spec.table] = tables[spec.table].drop(PART_KEY)
        else:
            stored = read_dimension(spark, path)
            tables[spec.table] = empty_table(spark, spec) if stored is None else stored
        if spec.child:
            stored = read_child(spark, out_dir, spec)
            if stored is None:
                columns = ", ".join(
                    f"{c} {'bigint' if c == 'price_cents' else 'string'}" for c in spec.child.columns
                )
                stored = spark.createDataFrame([], columns)
            tables[spec.child.table] = stored
    return tables


def load_all(
    spark: SparkSession, raw_dir: str, out_dir: str, only: list[str] | None = None, force: bool = False,
    cutoff_hour: int = CUTOFF_HOUR, layout: Layout = Layout(),
) -> dict[str, int]:
    """Load every entity, locations first, and return the records read per entity.

    A file is entered in the ledger after its rows are merged: a run that dies in between merges them
    again, which changes nothing.
    """
    pin_utc(spark)
    done: dict[str, int] = {}
    zones = None
    for spec in ENTITIES:
        if spec.entity != "locations" and zones is None:
            stored = read_dimension(spark, f"{out_dir}/locations")
            zones = location_zones(empty_table(spark, BY_ENTITY["locations"]) if stored is None else stored)
        if only and spec.entity not in only:
            continue
        files = _pending(spark, raw_dir, out_dir, spec, force)
        if files is None:
            done[spec.entity] = 0
            continue
        runs = [r["run"] for r in files.select("run").distinct().collect()]  # pulls since the last load, not files
        new = files.select(F.col("path").alias("_file"))
        lines = raw_lines(spark, raw_dir, spec.entity, runs).join(new, "_file", "left_semi")
        # Parsed once: the counts of the ledger, the quarantine and the merge read what is stored here.
        judged = materialize(judge_lines(lines, spec), "judged")
        store_rejected(judged, out_dir, spec.entity)
        merge_rows(spark, judged, out_dir, spec, zones, cutoff_hour, layout, remember=True)
        # Good records per file; a file without any is entered too, so that it is not read again.
        good = judged.where("_reason is null").groupBy(F.col("_file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
        entries = materialize(files.join(good, "path", "left").select(
            "path", F.lit(spec.entity).alias("entity"), F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"),
            F.current_timestamp().alias("loaded_at"),
        ), "entries")
        entries.coalesce(1).write.mode("append").parquet(f"{out_dir}/{LEDGER}")
        done[spec.entity] = entries.agg(F.sum("rows")).first()[0]
    return done


def retain(spark: SparkSession, out_dir: str, cutoff: date, layout: Layout = Layout()) -> dict[str, int]:
    """Drop facts dated before ``cutoff`` from the stored tables, with the modifiers of their items; returns how many
    partitions of each table went. What is derived from them counts as touched until it is refreshed."""
    gone: dict[str, int] = {}
    for spec in ENTITIES:
        if not spec.is_fact:
            continue
        path = f"{out_dir}/{spec.table}"
        stored = read_if_present(spark, path)
        if stored is None:
            continue
        edge = layout.of(cutoff)
        parts = [(k,) for k in part_keys(stored) if k <= edge]
        if parts:
            # Stored before anything is dropped: afterwards the partitions could not be listed any more.
            spark.createDataFrame(parts, f"{PART_KEY} string").coalesce(1).write.mode("append").parquet(f"{path}/{TOUCHED}")
        gone[spec.table] = len(trim_parts(spark, path, list(spec.keys), cutoff, layout))
        if spec.child:
            child = f"{out_dir}/{spec.child.table}"
            gone[spec.child.table] = len(trim_parts(spark, child, list(spec.child.keys), cutoff, layout))
    return gone


def refresh_derived(spark: SparkSession, out_dir: str, layout: Layout = Layout()) -> set[str] | None:
    """Bring first days and summary up to date with all merges since the last time; returns the months rebuilt."""
    touched: set[str] = set()
    for table in FACTS:
        parts = remembered(spark, f"{out_dir}/{table}")
        if parts is None:
            continue
        touched |= {r[0] for r in parts.collect()}  # partitions, not rows
        if table == "orders":
            refresh_first_seen(spark, out_dir, parts, layout)
    months = refresh_summary(spark, load_tables(spark, out_dir, parts=True), out_dir, sorted(touched), layout)
    for table in FACTS:
        forget_touched(spark, f"{out_dir}/{table}")
    return months


def build_features(
    spark: SparkSession, tables: Mapping[str, DataFrame], summary: DataFrame, out_dir: str,
    val_days: int = 0, test_days: int = 0, horizon_days: int = 14,
) -> dict[str, DataFrame]:
    """Write the scaled dataset by split, the unscaled table, the scaler and the manifest."""
    rows = feature_table(tables, summary, val_days, test_days, horizon_days)
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/features")
    rows = spark.read.schema(rows.schema).parquet(f"{out_dir}/features")
    columns = feature_columns(rows.columns)
    assert_no_leakage(columns)
    train = rows.where(F.col("split") == "train").limit(MIN_TRAIN_ROWS).count()
    if train < MIN_TRAIN_ROWS:
        raise RuntimeError(f"only {train} training rows; more history or smaller holdouts are needed")
    fit_scaler(rows, columns).write.mode("overwrite").parquet(f"{out_dir}/scaler")
    stats = spark.read.parquet(f"{out_dir}/scaler")
    apply_scaler(rows, stats, columns).write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/dataset")
    manifest_document(rows, stats).write.mode("overwrite").text(f"{out_dir}/manifest")
    return {
        "features": rows,
        "scaler": stats,
        "dataset": load_dataset(spark, out_dir),
        "manifest": spark.read.text(f"{out_dir}/manifest"),
    }


def load_dataset(spark: SparkSession, out_dir: str, split: str | None = None) -> DataFrame:
    """The scaled dataset, or one split of it (a partition filter)."""
    rows = spark.read.parquet(f"{out_dir}/dataset")
    return rows if split is None else rows.where(F.col("split") == split)


def build_forecast(
    spark: SparkSession, built: Mapping[str, DataFrame], out_dir: str, refits: int = REFITS, history_days: int = 30,
) -> dict[str, DataFrame]:
    """Fit, compare with the free guesses, forecast, explain; writes and returns the stored tables.

    The penalty is chosen on the validation split. ``scores`` holds the model beside both baselines on every split,
    ``verdict`` how it does against each on the test split, ``forecast`` and ``next_day`` the future with its band and
    spread, ``history`` the days that no fit has seen, ``explanation`` what moved the next day's forecast.
    """
    rows, scaled = built["features"], built["dataset"]
    columns = feature_columns(rows.columns)
    model = ridge.fit_path(scaled, columns)
    guess = ridge.predict(model, scaled).select(*DAY, "predicted")
    spread = ridge.forecast_uncertainty(scaled, columns, refits).select(*DAY, "model_uncertainty")
    joined = rows.join(guess, DAY).join(spread, DAY, "left")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out_dir}/{name}")

    predictions = stored(joined, "predictions")
    out = {"penalties": stored(ridge.path_table(scaled, model), "penalties"), "predictions": predictions}
    named = forecast.BASELINES | {MODEL: "predicted"}
    out["scores"] = stored(forecast.score(forecast.baseline_predictions(predictions, named)), "scores")
    out["verdict"] = stored(forecast.verdict(out["scores"], MODEL), "verdict")
    out["metrics"] = stored(forecast.test_metrics(out["scores"], out["verdict"], MODEL), "metrics")
    band = stored(forecast.residual_band(predictions), "band")
    out["forecast"] = stored(forecast.forecast_rows(predictions, "predicted", band, "model_uncertainty"), "forecast")
    out["next_day"] = stored(forecast.next_day_forecast(predictions, "predicted", band, "model_uncertainty"), "next_day")
    out["history"] = stored(forecast.forecast_history(predictions, "predicted", history_days), "history")
    chosen = forecast.next_day_rows(rows).select(*DAY)
    out["explanation"] = stored(
        forecast.explain(model.slopes, scaled.join(chosen, DAY, "left_semi"), rows.join(chosen, DAY, "left_semi"), columns),
        "explanation",
    )
    return out


def run_daily(
    spark: SparkSession, raw_dir: str, out_dir: str, as_of: date, strict: bool = False,
    layout: Layout = Layout(), keep_days: int | None = None, refits: int = REFITS,
) -> dict[str, DataFrame]:
    """Load, trim, check, summarise, build features, fit and forecast. Raises when the gate is closed.

    With ``keep_days`` facts older than that are dropped from the stored tables. The summary is rebuilt only for the
    months that the day's changes reach.
    """
    load_all(spark, raw_dir, out_dir, layout=layout)
    if keep_days is not None:
        retain(spark, out_dir, as_of - timedelta(days=keep_days), layout)
    tables = load_tables(spark, out_dir)
    report = checked_report(tables, as_of, ledger(spark, out_dir), strict)
    raise_if_blocked(report)
    require_trading_days(tables["orders"])
    months = refresh_derived(spark, out_dir, layout)
    summary = read_summary(spark, out_dir)
    built = {"report": report, "summary": summary, **build_features(spark, tables, summary, out_dir)}
    built["months"] = spark.createDataFrame([(m,) for m in sorted(months or [])], "month string")
    return built | build_forecast(spark, built, out_dir, refits)

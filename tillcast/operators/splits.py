"""Chronological split, train-only scaling, and the dataset outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.features import (
    BINARY_PREFIXES,
    KEYS_AND_TARGETS,
    SAME_DAY_OUTCOMES,
    TARGET,
    complete_rows,
    engineered,
    feature_columns,
)
from tillcast.session import materialize

SPLITS = ("train", "val", "test")
AUTO_SHARE = 0.15
AUTO_MIN, AUTO_MAX = 7, 28
TINY = 1e-9


def split_sizes(rows: DataFrame, val_days: int = 0, test_days: int = 0) -> DataFrame:
    """One row (observed_days, val_days, test_days). A size of 0 is chosen from the history: 15 % of the
    observed dates, at least 7 and at most 28."""
    days = rows.where(F.col("is_future") == 0).agg(
        F.countDistinct("business_date").cast("int").alias("observed_days")
    )
    auto = F.greatest(
        F.lit(AUTO_MIN), F.least(F.lit(AUTO_MAX), (F.col("observed_days") * F.lit(AUTO_SHARE)).cast("int"))
    )
    return days.select(
        "observed_days",
        (F.lit(val_days) if val_days else auto).cast("int").alias("val_days"),
        (F.lit(test_days) if test_days else auto).cast("int").alias("test_days"),
    )


def split_starts(rows: DataFrame, val_days: int = 0, test_days: int = 0) -> DataFrame:
    """One row (val_start, test_start), null where the history is too short for that split.

    The distinct dates are one short array: it grows with the calendar, not with locations or facts.
    """
    dates = (
        rows.where(F.col("is_future") == 0)
        .select("business_date")
        .distinct()
        .agg(F.sort_array(F.collect_list("business_date"), asc=False).alias("dates"))
    )
    sizes = split_sizes(rows, val_days, test_days)
    n = F.size("dates")
    held = F.col("val_days") + F.col("test_days")
    return dates.withColumns(
        {"val_days": sizes.select("val_days").scalar(), "test_days": sizes.select("test_days").scalar()}
    ).select(
        F.when(n > held, F.get("dates", held - 1)).alias("val_start"),
        F.when(n > F.col("test_days"), F.get("dates", F.col("test_days") - 1)).alias("test_start"),
    )


def time_split(rows: DataFrame, val_days: int = 0, test_days: int = 0) -> DataFrame:
    """Label rows by date, the same dates for every location, never at random."""
    starts = split_starts(rows, val_days, test_days)
    day = F.col("business_date")
    return (
        rows.withColumns(
            {"__val": starts.select("val_start").scalar(), "__test": starts.select("test_start").scalar()}
        )
        .withColumn(
            "split",
            F.when(F.col("is_future") == 1, "future")
            .when(day >= F.col("__test"), "test")
            .when(day >= F.col("__val"), "val")
            .otherwise("train"),
        )
        .drop("__val", "__test")
    )


def scaled_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.startswith(BINARY_PREFIXES)]


def fit_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) of the train split, one aggregation for all columns. A constant column (or a
    single row) gets a deviation of 1."""
    names = scaled_columns(columns)
    wide = rows.where(F.col("split") == "train").agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd"))
        for c in names
    ])
    return wide.select(F.inline(entries)).select(
        "feature", "mean", F.when(F.col("sd") > TINY, F.col("sd")).otherwise(F.lit(1.0)).alias("std")
    )


def _stats_row(stats: DataFrame, names: list[str]) -> Column:
    """The scaler as one struct value with a (mean, std) field per feature, read by position."""
    entry = F.struct("mean", "std")
    wide = stats.agg(F.struct(*[F.max(F.when(F.col("feature") == c, entry)).alias(c) for c in names]).alias("s"))
    return wide.scalar()


def apply_scaler(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std on the scaled columns; flags stay as they are."""
    names = scaled_columns(columns)
    fitted = rows.withColumn("__s", _stats_row(stats, names))
    return fitted.withColumns({
        c: (F.col(c).cast("double") - F.col(f"__s.{c}.mean")) / F.col(f"__s.{c}.std") for c in names
    }).drop("__s")


def unscale(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """x * std + mean, the inverse of :func:`apply_scaler`."""
    names = scaled_columns(columns)
    fitted = rows.withColumn("__s", _stats_row(stats, names))
    return fitted.withColumns({
        c: F.col(c) * F.col(f"__s.{c}.std") + F.col(f"__s.{c}.mean") for c in names
    }).drop("__s")


def split_spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("business_date").alias("first_date"),
        F.max("business_date").alias("last_date"),
    )


def feature_manifest(rows: DataFrame) -> DataFrame:
    """Counts and spans per split, with the number of features and of unscaled flags."""
    columns = feature_columns(rows.columns)
    flags = len(columns) - len(scaled_columns(columns))
    return split_spans(rows).withColumns(
        {"feature_count": F.lit(len(columns)), "binary_count": F.lit(flags), "target": F.lit(TARGET)}
    )


def manifest_document(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """The manifest as one JSON document: feature names, flags, scaler, counts and spans."""
    columns = feature_columns(rows.columns)
    spans = split_spans(rows).agg(
        F.map_from_entries(F.collect_list(F.struct("split", F.struct("rows", "first_date", "last_date")))).alias("s")
    )
    return spans.select(
        F.to_json(
            F.struct(
                F.lit(TARGET).alias("target"),
                F.lit(len(columns)).alias("feature_count"),
                F.array(*[F.lit(c) for c in columns]).alias("feature_names"),
                F.array(*[F.lit(c) for c in columns if c.startswith(BINARY_PREFIXES)]).alias("binary_features"),
                F.col("s").alias("splits"),
                _stats_row(stats, scaled_columns(columns)).alias("scaler"),
            )
        ).alias("manifest")
    )


def feature_payload(rows: DataFrame) -> DataFrame:
    """One JSON object of unscaled features per row, for inspection; doubles keep four decimals."""
    kinds = dict(rows.dtypes)
    values = [
        (F.bround(F.col(c), 4) if kinds[c] == "double" else F.col(c)).alias(c)
        for c in feature_columns(rows.columns)
    ]
    return rows.select(
        "business_date", "location_id", "split", TARGET, F.to_json(F.struct(*values)).alias("payload")
    )


def feature_table(
    tables: Mapping[str, DataFrame], summary: DataFrame, val_days: int = 0, test_days: int = 0,
    horizon_days: int = 14,
) -> DataFrame:
    """Complete feature rows with their split, unscaled.

    The split needs the surviving dates and the scaler needs the train rows, so the engineered table is
    written once to the shared folder and later passes scan it.
    """
    rows = materialize(complete_rows(engineered(tables, summary, horizon_days)), "features")
    return time_split(rows, val_days, test_days)


def feature_contract(rows: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(rule, passed): what must hold before anything is trained on the table."""
    leaked = set(columns) & {*SAME_DAY_OUTCOMES}
    bad = F.lit(False)
    for c in columns:
        value = F.col(c).cast("double")
        bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    learned = F.col("split").isin(*SPLITS)

    def edge(stat, split):
        return stat(F.when(F.col("split") == split, F.col("business_date")))

    facts = rows.agg(
        F.countDistinct(F.when(learned, F.col("split"))).alias("splits"),
        F.sum(F.when(learned & bad, 1).otherwise(0)).alias("not_finite"),
        F.sum(F.when(learned & F.col(TARGET).isNull(), 1).otherwise(0)).alias("no_target"),
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "val").alias("val_start"),
        edge(F.max, "val").alias("val_end"),
        edge(F.min, "test").alias("test_start"),
    )
    fitted = F.lit(True) if stats is None else (stats.agg(F.count(F.lit(1))).scalar() > 0)
    rules = {
        "target is not an input": F.lit(TARGET not in columns),
        "no outcome of the same day": F.lit(not leaked),
        "no key among the inputs": F.lit(not set(columns) & set(KEYS_AND_TARGETS)),
        "three splits present": F.col("splits") == len(SPLITS),
        "inputs are finite": F.col("not_finite") == 0,
        "every learned row has a target": F.col("no_target") == 0,
        "splits are in time order": F.coalesce(
            (F.col("train_end") < F.col("val_start")) & (F.col("val_end") < F.col("test_start")), F.lit(False)
        ),
        "scaler present": fitted,
    }
    entries = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.when(ok, 1).otherwise(0).alias("passed"))
        for rule, ok in rules.items()
    ])
    return facts.select(F.inline(entries))

"""JSONL landing files: scan with bad-line quarantine, append-only sink, CSV reference files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tillcast.functions.columns import iso_date
from tillcast.schemas import EVENT_CSV, PROMOTION_CSV, SCHOOL_CSV, EntitySpec
from tillcast.session import materialize
from tillcast.sources.buckets import read_if_present

CORRUPT = "_corrupt_record"
# "<entity>-<run>.jsonl", a plain file or a folder of part files.
RUN_FILE = r"/([^/]+\.jsonl(?:/[^/]+)?)$"
RUN = r"^([^/]+\.jsonl)"
FILE_ORDER = ("_file", "_block", "_line")
QUARANTINE = "_quarantine"
UNREADABLE, KEYLESS = "unreadable", "no key"
FILE_ROWS = 500_000


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split text lines into (good records, quarantined lines). Blank lines are neither.

    The record goes through a generator of one element, so that a line is parsed once and not again by
    the filter and by every field that is read.
    """
    record = F.from_json(
        column, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    extra = [c for c in lines.columns if c != column]
    parsed = lines.where(F.trim(column) != "").select(F.col(column).alias("__line"), *extra, F.inline(F.array(record)))
    broken = F.col(CORRUPT).isNotNull()
    good = parsed.where(~broken).drop(CORRUPT, "__line")
    bad = parsed.where(broken).select(F.col("__line").alias("line"), *extra)
    return good, bad


def judge_lines(lines: DataFrame, spec: EntitySpec) -> DataFrame:
    """Every line that is not blank with its record, ``_reason``: why it is not loaded, null if it is, and ``_text``: the
    line, of those that are not loaded.

    A line is unreadable when it is no JSON of the declared types, and without a key when a field of the key is null.
    """
    record = F.from_json(
        "value", f"{spec.landing}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    extra = [c for c in lines.columns if c != "value"]
    parsed = lines.where(F.trim("value") != "").select(F.col("value").alias("__line"), *extra, F.inline(F.array(record)))
    keyless = F.greatest(*[F.col(k).isNull().cast("int") for k in spec.keys], F.lit(0)) == 1
    reason = F.when(F.col(CORRUPT).isNotNull(), UNREADABLE).when(keyless, KEYLESS)
    judged = parsed.withColumn("_reason", reason).withColumn("_text", F.when(F.col("_reason").isNotNull(), F.col("__line")))
    return judged.drop(CORRUPT, "__line")


def store_rejected(judged: DataFrame, out_dir: str, entity: str) -> None:
    """Put the lines that are not loaded into the quarantine: reason, text, and where they stood.

    A file owns its folder there, so loading it again replaces its lines; one that has none any more is left with a
    marker row without a reason, which readers skip.
    """
    path = f"{out_dir}/{QUARANTINE}/{entity}"
    rejected = judged.where("_reason is not null").select(
        F.col("_reason").alias("reason"), F.col("_text").alias("line"), F.col("_block").alias("block"),
        F.col("_line").alias("position"), F.col("_file").alias("file"),
    )
    stored = read_if_present(judged.sparkSession, path)
    if stored is not None:
        again = judged.select(F.col("_file").alias("file")).distinct()
        known = materialize(stored.select("file").distinct().join(again, "file", "left_semi"), "quarantined")
        blank = [F.lit(None).cast(kind).alias(name) for name, kind in rejected.dtypes if name != "file"]
        rejected = rejected.unionByName(known.select(*blank, "file"))
    rejected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)


def read_rejected(spark: SparkSession, out_dir: str, entity: str) -> DataFrame:
    schema = "reason string, line string, block bigint, position bigint, file string"
    stored = read_if_present(spark, f"{out_dir}/{QUARANTINE}/{entity}")
    return spark.createDataFrame([], schema) if stored is None else stored.where("reason is not null")


def landed_files(spark: SparkSession, raw_dir: str, entity: str) -> DataFrame | None:
    """(path, run) of every landed file of an entity; None when nothing has landed.

    The files are listed by tasks and not opened: of a file's row only its name is asked for.
    """
    try:
        listed = spark.read.format("binaryFile").load(f"{raw_dir}/{entity}/{entity}-*.jsonl")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    files = listed.select(F.regexp_extract("path", RUN_FILE, 1).alias("path"))
    return files.select("path", F.regexp_extract("path", RUN, 1).alias("run"))


def raw_lines(
    reader: SparkSession | DataStreamReader, raw_dir: str, entity: str, runs: list[str] | None = None
) -> DataFrame:
    """Lines of the landed files of an entity, or of some runs, with their position: file name, block, line order.

    Names carry the run stamp, so (file, block, line) orders all versions of a record from oldest to
    newest. The line number is taken inside the scan, where each split is read in order.
    """
    source = reader if isinstance(reader, DataStreamReader) else reader.read
    names = [f"{entity}-*.jsonl"] if runs is None else runs
    return source.text([f"{raw_dir}/{entity}/{name}" for name in names]).select(
        "value",
        F.regexp_extract("_metadata.file_path", RUN_FILE, 1).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def read_landed(spark: SparkSession, raw_dir: str, spec: EntitySpec) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) records of all runs; both empty when nothing has landed yet."""
    try:
        lines = raw_lines(spark, raw_dir, spec.entity)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string, _file string, _block bigint, _line bigint")
    return parse_lines(lines, spec.landing)


def land(records: DataFrame, raw_dir: str, entity: str, run_id: str, watermark_field: str | None = None) -> dict:
    """Append one run's records as JSON lines and return {"rows", "watermark"}; writes nothing for no
    records. Row count and watermark are observed while writing, not by a second pass.

    A run owns its folder, so a repeated run replaces its own files and nothing else. Its files are compressed, and as
    such are read by one task each, so their length is bounded.
    """
    if records.isEmpty():
        return {"rows": 0, "watermark": None}
    seen = Observation(f"land-{entity}-{run_id}")
    newest = F.max(watermark_field) if watermark_field else F.max(F.lit(None).cast("string"))
    observed = records.observe(seen, F.count(F.lit(1)).alias("rows"), newest.alias("watermark"))
    (
        observed.write.mode("overwrite").option("ignoreNullFields", "false")
        .option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS)
        .json(f"{raw_dir}/{entity}/{entity}-{run_id}.jsonl")
    )
    return {"rows": seen.get["rows"], "watermark": seen.get["watermark"]}


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV as text columns; rows with nothing in them are dropped."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return rows.dropna("all")


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = read_reference_csv(spark, path, EVENT_CSV)
    return rows.withColumns(
        {
            "start_date": iso_date(F.col("start_date")),
            "end_date": iso_date(F.col("end_date")),
            "distance_miles": F.col("distance_miles").try_cast("double"),
            "expected_attendance": F.col("expected_attendance").try_cast("double").cast("bigint"),
        }
    )


def promotions_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = read_reference_csv(spark, path, PROMOTION_CSV)
    return rows.withColumns(
        {
            "start_date": iso_date(F.col("start_date")),
            "end_date": iso_date(F.col("end_date")),
            "discount_value": F.col("discount_value").try_cast("double"),
            "spend_usd": F.col("spend_usd").try_cast("double"),
        }
    )


def school_csv(spark: SparkSession, path: str) -> DataFrame:
    """School terms in list order; rows with a malformed date are skipped."""
    rows = read_reference_csv(spark, path, SCHOOL_CSV).withColumn("ordinal", F.monotonically_increasing_id())
    return rows.select(
        F.coalesce("label", F.lit("break")).alias("label"),
        iso_date(F.col("start_date")).alias("start_date"),
        iso_date(F.col("end_date")).alias("end_date"),
        "ordinal",
    ).where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())

"""Session setup and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What is written only to be read again, and stored tables: a third smaller than by the default codec.
STORED_AS = "zstd"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tillcast") -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return pin_utc(session)


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants; local time is always derived through an explicit zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without that setting: its executor is the driver, so a local folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillcast-")
    return f"{root.rstrip('/')}/tillcast/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several passes read the same derived table: the table survives the loss of
    executors and later passes scan Parquet instead of repeating the plan.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

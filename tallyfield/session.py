"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyfield", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; everything else stays at the cluster's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`.

    Where none is named, a local master (tests) gets a new folder of its own; on a cluster that is an error, as executors
    would write to disks that others cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyfield-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; `clear_work` removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Remove what this application has written below the shared folder. Frames that read it cannot be used any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    For reduced tables that several branches or jobs read: the inputs behind them are then scanned once, lost executors
    cost no recomputation, every branch sees the same rows, and the reader knows the table's real size.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

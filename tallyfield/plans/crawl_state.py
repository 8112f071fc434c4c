"""The crawl ledger kept over many runs: success is final, failed hosts are retried and counted.

Each run writes a whole new snapshot below the ledger's folder. A snapshot counts once its writer's success file stands, so
readers see either the state before a run or the one after it: a run that breaks off leaves the old snapshot in force and
is written anew, and a run that is complete is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "host string, status string, tries long, reason string, first_run long, last_run long"


def merged_state(state: DataFrame, attempts: DataFrame, run: int) -> DataFrame:
    """The state after a run's attempts (host, reason), reason NULL for a result that is complete.

    Several attempts at a host in one run count as one, complete if any is. Attempts without a host are left out. A host
    that had succeeded before stays as it was, whatever the run says.
    """
    results = attempts.where(F.col("host").isNotNull()).groupBy("host")
    results = results.agg(F.bool_or(F.col("reason").isNull()).alias("__done"), F.max("reason").alias("__reason"))
    both = state.join(results, "host", "full")
    settled = F.coalesce(F.col("status") == "success", F.lit(False))
    tried = F.col("__done").isNotNull() & ~settled
    now = F.when(tried, F.lit(run).cast("long"))
    return both.select(
        "host",
        F.when(settled | F.coalesce("__done", F.lit(False)), "success").otherwise("try").alias("status"),
        (F.coalesce("tries", F.lit(0)) + tried.cast("long")).alias("tries"),
        F.when(tried, F.when(~F.col("__done"), F.col("__reason"))).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("first_run", now).alias("first_run"),
        F.coalesce(now, F.col("last_run")).alias("last_run"),
    )


class CrawlState:
    """Snapshots of the ledger in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[int]:
        """Numbers of the complete runs, in order; one listing, as many entries as there are snapshots."""
        place, files = self._hadoop(f"{self.path}/run-*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().removeprefix("run-")) for f in files.globStatus(place) or [])

    def current(self) -> DataFrame:
        """The state after the last complete run."""
        done = self.runs()
        if not done:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/run-{done[-1]}")

    def open_hosts(self, hosts: DataFrame, most_tries: int | None = None) -> DataFrame:
        """Distinct listed hosts that have not succeeded yet, on request only those with fewer tries than `most_tries`."""
        closed = self.current().where(
            (F.col("status") == "success") | (F.lit(False) if most_tries is None else F.col("tries") >= most_tries)
        )
        return hosts.select("host").where(F.col("host").isNotNull()).distinct().join(closed.select("host"), "host", "left_anti")

    def record(self, run: int, attempts: DataFrame) -> bool:
        """Apply a run's attempts; False, and nothing happens, if this run or a later one is complete already."""
        done = self.runs()
        if done and run <= done[-1]:
            return False
        merged_state(self.current(), attempts, run).write.mode("overwrite").parquet(f"{self.path}/run-{run}")
        return True

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the last `keep` complete snapshots."""
        for run in self.runs()[: -max(1, keep)]:
            place, files = self._hadoop(f"{self.path}/run-{run}")
            files.delete(place, True)

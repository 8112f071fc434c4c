"""Ranking documents landed with a manifest: every file is read once, broken ones go to a side table.

A take lists the folder, reads the files whose path and modification time no earlier take holds, and writes its documents
and then its part of the manifest. It counts once that part's success file stands, so a take that breaks off changes nothing
and is done anew. A file that has changed since is read again, and its rows stand in for those of its former version. Files of zero bytes are passed over until they hold something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1_000
MANIFEST = "file string, modified timestamp, size long, status string, reason string, take long"


class Landing:
    """Documents below `data` of JSON files, one document per file; `row` is the DDL of one entry."""

    def __init__(self, spark: SparkSession, path: str, row: str):
        self.spark, self.path, self.row = spark, path.rstrip("/"), row

    def takes(self) -> list[int]:
        """Numbers of the complete takes, in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/take-*/files/_SUCCESS")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("take-")) for f in files.globStatus(place) or [])

    def manifest(self) -> DataFrame:
        """One row per file and version: `landed`, or `broken` with the reason."""
        done = [f"{self.path}/take-{n}/files" for n in self.takes()]
        return self.spark.read.schema(MANIFEST).parquet(*done) if done else self.spark.createDataFrame([], MANIFEST)

    def take(self, folder: str) -> int:
        """Read what is new in the folder; the number of files read.

        Spark lists the folder's files on the driver in any case. What is new is written as a table. Up to `FEW` new files
        are read by their paths; more are read from the folder, without the files older than all of them and, after the
        first take, without those that are not new.
        """
        number, parts = max(self.takes(), default=0) + 1, 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        listed = listed.select("path", F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).coalesce(parts)
        fresh = listed.join(self.manifest().select("file", "modified"), ["file", "modified"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/take-{number}/listed")
        new = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/take-{number}/listed")
        found, first = new.agg(F.count(F.lit(1)), F.min(F.unix_micros("modified"))).first()
        if not found:
            return 0
        schema = f"data array<struct<{self.row}>>, __unread string"
        reader = self.spark.read.schema(schema).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__unread")
        if found <= FEW:
            payload = reader.json([r["path"] for r in new.select("path").collect()])
            payload = payload.select("*", F.col("_metadata.file_path").alias("file"))
        else:
            payload = reader.option("recursiveFileLookup", "true").json(folder)
            payload = payload.where(F.unix_micros("_metadata.file_modification_time") >= first).select("*", F.col("_metadata.file_path").alias("file"))
            payload = payload.coalesce(max(parts, found // 512))  # Spark reads a few small files a task, and each would write a file of its own
            if number > 1:
                payload = payload.join(new.select("file"), "file", "left_semi")
        reason = F.when(F.col("__unread").isNotNull(), "not a document").when(F.col("data").isNull(), "no entries named data")
        documents = payload.select("file", F.when(reason.isNull(), F.col("data")).alias("data"), reason.alias("reason"))
        documents.write.mode("overwrite").parquet(f"{self.path}/take-{number}/documents")
        read = self.documents(number).groupBy("file").agg(F.max("reason").alias("reason"), F.lit(True).alias("__any"))
        files = new.join(read, "file", "left")
        why = F.when(F.col("__any").isNull(), "empty file").otherwise(F.col("reason"))
        files = files.select("file", "modified", "size", F.when(why.isNull(), "landed").otherwise("broken").alias("status"), why.alias("reason"), F.lit(number).cast("long").alias("take"))
        files.write.mode("overwrite").parquet(f"{self.path}/take-{number}/files")
        return found

    def documents(self, take: int) -> DataFrame:
        """What a take has read: (file, data, reason), one row per document."""
        return self.spark.read.schema(f"file string, data array<struct<{self.row}>>, reason string").parquet(f"{self.path}/take-{take}/documents")

    def latest(self) -> DataFrame:
        """The manifest row of each file's last version."""
        return self.manifest().groupBy("file").agg(F.max_by(F.struct("modified", "size", "status", "reason", "take"), "take").alias("v")).select("file", "v.*")

    def broken(self) -> DataFrame:
        """(file, modified, reason) of the files whose last version could not be read."""
        return self.latest().where("status = 'broken'").select("file", "modified", "reason")

    def rows(self) -> DataFrame:
        """Entries of all readable files with the file they come from."""
        parts = None
        for n in self.takes():
            part = self.documents(n).where("data IS NOT NULL").select("file", F.lit(n).cast("long").alias("take"), "data")
            parts = part if parts is None else parts.unionAll(part)
        if parts is None:
            return self.spark.createDataFrame([], f"file string, {self.row}")
        valid = self.latest().where("status = 'landed'").select("file", "take")
        return parts.join(valid, ["file", "take"], "left_semi").select("file", F.explode("data").alias("entry")).select("file", "entry.*")

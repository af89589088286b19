"""Writers: whole tables swapped in one step, revisions with a status, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import upsert


class VersionedTable:
    """A Parquet table that is replaced as a whole: each version has its own folder, and a manifest names the current one.

    A writer that is lost midway leaves a folder that nothing names, and readers keep the version
    they began with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        try:
            rows = self.spark.read.schema("version long").parquet(f"{self.root}/manifest")
            return rows.agg(F.max("version")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.version()}")

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        new = self.version() + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/v{new}")
        self.spark.range(1).select(F.lit(new).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return new

    def upsert(self, rows: DataFrame, key: list[str], update: bool = True) -> int:
        return self.write(upsert(self.read(), rows, key, update) if self.version() else rows.dropDuplicates(key))


def status_after(revisions: DataFrame, revision_id: int, status: str) -> DataFrame:
    """The revisions with one status changed; a failed revision can't be finished, and a finished one stays."""
    now = F.when((F.col("revision_id") == revision_id) & ~F.col("status").isin("Failed", "Ingested"), F.lit(status)).otherwise(F.col("status"))
    return revisions.withColumn("status", now)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

"""Incremental ingestion of snapshots and events with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import VersionedTable


def files(spark: SparkSession, path: str, schema: StructType, most_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind and window; windows are final once the watermark has passed them."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), kind, "n")


def once_each(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


class NewestRows:
    """A table of appended batches, of which the newest row of each key counts.

    A micro-batch writes its own rows alone, to a folder of its number that a repeated batch
    overwrites; nothing that is there already is read or written again. `compact` puts the batches
    together from time to time.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def put(self, rows: DataFrame, batch: int, order: str | None = None) -> None:
        """Adds a batch; of rows with equal keys in it the one that comes last by `order`, or else the greatest, so that a repeated batch is the same."""
        rest = [c for c in rows.columns if c not in self.key]
        row = F.struct(*rest)
        last = F.max_by(row, F.struct(order, F.to_json(row))) if order else F.max_by(row, F.to_json(row))
        rows.groupBy(*self.key).agg(last.alias("_s")).select(*self.key, *(F.col(f"_s.{c}").alias(c) for c in rest)).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.root).parquet(self.root)
        rest = [c for c in rows.columns if c not in (*self.key, "batch")]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
        return newest.select(*self.key, *(F.col(f"_s.{c}").alias(c) for c in rest))

    def compact(self, root: str) -> "NewestRows":
        """The table, written as one batch to a new place."""
        self.read().write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch=-1")
        return NewestRows(self.spark, root, self.key)


def append(stream: DataFrame, target: NewestRows, checkpoint: str) -> StreamingQuery:
    """Adds every micro-batch to a table of newest rows."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: target.put(rows, n) and None).start()


def ingest(stream: DataFrame, target: VersionedTable, key: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch into a versioned table, which is written anew each time: for small tables; `append` is for large ones."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: target.upsert(rows, key) and None).start()


def recent(laws: DataFrame, now: Column, days: int, modified: str = "last_modified") -> DataFrame:
    """The laws that were modified in the last days before `now`; a filter that reaches the scan, and as well for a stream."""
    return laws.where((F.col(modified) >= now - F.expr(f"make_dt_interval({int(days)})")) & (F.col(modified) <= now))

"""What each section's revisions add up to, kept up to date while they arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "title_number int, section_number string, versions long, live boolean, last_changed long"


class SectionHistory(StatefulProcessor):
    """Keeps what each revision says of a section, by its number, so that a late one falls into place.

    A revision changes a section if its text isn't what the one before it left, the first always.
    Two rows of one number count once, the one with the greater hash.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "sequence_number long", "text_hash string, is_deleted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for p in rows:
            for number, digest, deleted in zip(p["sequence_number"], p["text_hash"], p["is_deleted"], strict=True):
                at, new = (int(number),), (digest or "", bool(deleted))
                old = self.history.getValue(at) if self.history.containsKey(at) else None
                if old is None or tuple(old) < new:
                    self.history.updateValue(at, new)
        past = sorted((int(k[0]), (v[0], bool(v[1]))) for k, v in self.history.iterator())
        changed = [n for i, (n, v) in enumerate(past) if not i or v != past[i - 1][1]]
        yield pd.DataFrame({"title_number": [int(key[0])], "section_number": [key[1]], "versions": [len(past)], "live": [not past[-1][1][1]], "last_changed": [changed[-1]]})

    def close(self) -> None:
        pass


def live_sections(snapshots: DataFrame) -> DataFrame:
    """A stream of OUT, a row for each section that a batch has touched, out of a stream of snapshots (title_number, section_number, sequence_number, text_hash, is_deleted). Needs the state store of RocksDB."""
    rows = snapshots.select(F.col("title_number").cast("int").alias("title_number"), "section_number", F.col("sequence_number").cast("long").alias("sequence_number"), "text_hash", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))
    return rows.groupBy("title_number", "section_number").transformWithStateInPandas(statefulProcessor=SectionHistory(), outputStructType=OUT, outputMode="Update", timeMode="None")


def keep(snapshots: DataFrame, target, checkpoint: str) -> StreamingQuery:
    """Keeps a table of newest rows (streaming.incremental.NewestRows) of `live_sections` up to date, with what has come by now."""
    out = live_sections(snapshots).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.foreachBatch(lambda rows, n: target.put(rows, n) and None).start()


def live_sections_of(snapshots: DataFrame) -> DataFrame:
    """The same of a table: OUT for each section."""
    key = ["title_number", "section_number"]
    says = F.struct(F.coalesce("text_hash", F.lit("")).alias("h"), F.coalesce("is_deleted", F.lit(False)).alias("d"))
    once = snapshots.groupBy(*key, F.col("sequence_number").cast("long").alias("sequence_number")).agg(F.max(says).alias("_s"))
    before = F.lag("_s").over(Window.partitionBy(*key).orderBy("sequence_number"))
    rows = once.withColumn("_changed", F.when(~before.eqNullSafe(F.col("_s")), F.col("sequence_number")))
    newest = F.max_by("_s", "sequence_number")["d"]
    return rows.groupBy(F.col("title_number").cast("int").alias("title_number"), "section_number").agg(F.count(F.lit(1)).alias("versions"), (~newest).alias("live"), F.max("_changed").alias("last_changed"))


def title_counts(sections: DataFrame) -> DataFrame:
    """For each title: live sections, versions, and the revision that changed it last."""
    return sections.groupBy("title_number").agg(F.count_if("live").alias("live_sections"), F.sum("versions").alias("versions"), F.max("last_changed").alias("last_changed"))

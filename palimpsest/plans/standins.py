"""The driver's tables in the roles of the versioned-text entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a title, an event type a section, a day a revision; every seventh k is a tombstone."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("snapshot_id"), F.datediff(F.to_date("ts"), F.lit("2023-12-31").cast("date")).cast("long").alias("revision_id"), F.col("user_id").alias("title_number"),
        F.col("event_type").alias("section_number"), F.when(k != 3, F.sha2("props", 256)).alias("text_hash"), F.when(k % 2 == 0, F.sha2(k.cast("string"), 256)).alias("notes_hash"), (k % 7 == 0).alias("is_deleted"), F.col("ts"),
    )


#: The same in SQL, to go before a query.
SNAPSHOTS_SQL = """
snapshots AS (
  SELECT event_id AS snapshot_id, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS revision_id, user_id AS title_number, event_type AS section_number,
         CASE WHEN k <> 3 THEN sha256(props) END AS text_hash, CASE WHEN k % 2 = 0 THEN sha256(CAST(k AS VARCHAR)) END AS notes_hash, k % 7 = 0 AS is_deleted, ts
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days in events: each follows the day before, but for every tenth, which follows the one before that."""
    days = snapshots(spark, sf_dir).select("revision_id").distinct()
    return days.withColumn("parent_revision_id", F.when(F.col("revision_id") > 1, F.greatest(F.col("revision_id") - F.when(F.col("revision_id") % 10 == 0, 2).otherwise(1), F.lit(1))))


REVISIONS_SQL = """
revisions AS (
  SELECT revision_id, CASE WHEN revision_id > 1 THEN greatest(revision_id - CASE WHEN revision_id % 10 = 0 THEN 2 ELSE 1 END, 1) END AS parent_revision_id
  FROM (SELECT DISTINCT revision_id FROM snapshots)
),
chain AS (
  WITH RECURSIVE c AS (
    SELECT revision_id, parent_revision_id, CAST(0 AS BIGINT) AS chain_pos FROM revisions WHERE revision_id = {head}
    UNION ALL
    SELECT r.revision_id, r.parent_revision_id, c.chain_pos + 1 FROM revisions r JOIN c ON r.revision_id = c.parent_revision_id
  )
  SELECT revision_id, chain_pos FROM c
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as three levels of a tree."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(c)


NODES_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
)"""

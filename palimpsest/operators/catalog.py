"""Look-ups in the tables of release points, laws, patterns, discoveries, sessions and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import contains

PENDING = ("New", "Under_Review")


def one(rows: DataFrame, **key: object) -> DataFrame:
    """The rows whose columns have these values; filters that reach the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def law_by_number(laws: DataFrame, congress: int, law_number: str) -> DataFrame:
    """A law by its Congress and its number as text."""
    return one(laws, congress=congress, law_number=law_number)


def release_points_of(points: DataFrame, congress: int) -> DataFrame:
    return one(points, congress=congress).orderBy("publication_date", "identifier")


def titles_at(points: DataFrame, identifier: str) -> DataFrame:
    """The titles that a release point holds, a row each."""
    return one(points, identifier=identifier).select(F.explode("titles").alias("title_number")).distinct()


def structure_scan(sections: DataFrame) -> DataFrame:
    """What a table of contents needs of sections; texts are never read."""
    return sections.select("title_number", "section_number", "heading", "sort_order", "is_repealed")


def amended_by(sections: DataFrame, congress: int, law_number: int) -> DataFrame:
    """Sections whose notes list an amendment by a law."""
    return sections.where(F.exists("amendments", lambda a: (a["congress"] == congress) & (a["law_number"] == law_number)))


def escalated_sessions(sessions: DataFrame, now: Column, days: int, law_id: int | None = None) -> DataFrame:
    """Escalated sessions of the last days, of one law if given, newest first."""
    rows = sessions.where(F.col("escalated") & (F.col("started_at") >= F.expr(f"make_dt_interval({-days})") + now))
    return (rows if law_id is None else one(rows, law_id=law_id)).orderBy(F.desc("started_at"), "session_id")


def pending_discoveries(discoveries: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """Discoveries still to be reviewed, or of one status, newest first."""
    wanted = F.col("status").isin(*PENDING) if status is None else F.col("status") == status
    return discoveries.where(wanted).orderBy(F.desc("created_at"), F.desc("discovery_id")).limit(limit)


def similar_discoveries(discoveries: DataFrame, text: str, limit: int) -> DataFrame:
    """Discoveries whose text holds the first 50 characters of another."""
    return discoveries.where(F.col("text").contains(F.lit(text[:50]))).orderBy(F.desc("created_at"), F.desc("discovery_id")).limit(limit)


def promoted_patterns(discoveries: DataFrame) -> DataFrame:
    return one(discoveries, status="Promoted").orderBy(F.desc("reviewed_at"), F.desc("discovery_id"))


def patterns(spark_patterns: DataFrame, change_type: str | None = None, least: float = 0.0) -> DataFrame:
    """Extraction patterns of a kind, or of a confidence."""
    rows = spark_patterns.where(F.col("confidence") >= least)
    return rows if change_type is None else one(rows, change_type=change_type)


def is_valid(report: DataFrame, least: float = 0.95) -> DataFrame:
    """Adds match_rate and is_valid: enough sections match, and none failed."""
    rate = F.coalesce(F.try_divide(F.col("matched"), F.col("compared")), F.lit(0.0))
    return report.withColumns({"match_rate": rate, "is_valid": (rate >= least) & (F.col("errors") == 0)})


def notes_of(notes: Column, category: str) -> Column:
    """The notes of one category."""
    return F.filter(notes, lambda n: n["category"] == category)


def search(sections: DataFrame, query: str, titles: Sequence[int] | None = None, modified: tuple[str, str] | None = None, order: str = "position", limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): sections whose heading or text contains the query, in some titles, modified within some days; by position, newest or heading."""
    rows = sections.where(contains(F.col("heading"), query) | contains(F.col("text"), query))
    if titles:
        rows = rows.where(F.col("title_number").isin(*titles))
    if modified:
        rows = rows.where(F.col("last_modified").between(*(F.lit(d).cast("date") for d in modified)))
    orders = {"position": ["title_number", "sort_order"], "newest": [F.desc("last_modified"), "title_number", "sort_order"], "heading": ["heading", "title_number", "sort_order"]}
    return rows.orderBy(*orders[order], "section_number").offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))

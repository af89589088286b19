"""Taking in members, votes, sessions and release points: rows as stored, logs of a run, and what is finished or rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import described_difference
from ..functions.text import chamber, full_name, party
from .compare import diff_counts, diff_states
from .relations import split_known, upsert, upsert_outcome


def member_rows(details: DataFrame, terms: DataFrame, member: str = "bioguide_id") -> DataFrame:
    """Members as stored: display name, party, and chamber, state and district of the latest term with the years served."""
    latest = F.max_by(F.struct("chamber", "state", "district"), F.struct("start_year", F.coalesce("end_year", F.lit(9999))))
    own = terms.groupBy(member).agg(latest.alias("_t"), F.min("start_year").alias("first_year"), F.max("end_year").alias("last_year"))
    rows = details.join(own, member, "left")
    return rows.select(member, full_name(*(F.coalesce(c, F.lit("")) for c in ("first_name", "middle_name", "last_name")), F.lit("")).alias("full_name"), party(F.col("party")).alias("party"), chamber(F.col("_t.chamber")).alias("current_chamber"), F.col("_t.state").alias("current_state"), F.col("_t.district").alias("current_district"), "first_year", "last_year")


def taken_in(target: DataFrame, source: DataFrame, key: list[str], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, log): the target with the source's rows, known ones only if they differ or are forced; and how many were created, updated and skipped."""
    rest = [c for c in source.columns if c not in key]
    digest = F.xxhash64(*rest)
    outcome = upsert_outcome(target.withColumn("_d", digest), source.withColumn("_d", digest), key, "_d").drop("_d")
    if force:
        outcome = outcome.withColumn("outcome", F.when(F.col("outcome") == "skipped", "updated").otherwise(F.col("outcome")))
    log = outcome.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "skipped")))
    return upsert(target, outcome.where("outcome <> 'skipped'").drop("outcome"), key), log


def finalized(revisions: DataFrame) -> DataFrame:
    """The revisions with the newest ground truth that is being ingested marked as ingested."""
    newest = revisions.where("is_ground_truth and status = 'Ingesting'").agg(F.max_by("revision_id", "sequence_number").alias("_done"))
    done = F.col("revision_id").eqNullSafe(F.col("_done"))
    return revisions.crossJoin(F.broadcast(newest)).withColumn("status", F.when(done & F.col("_done").isNotNull(), "Ingested").otherwise(F.col("status"))).drop("_done")


def ingested_point(parent: DataFrame, states: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshots, counts): what a release point changes against its parent's state, tombstones for what is gone, and its counts."""
    diff = diff_states(parent, states, key)
    changed = diff.where("change_type <> 'unchanged'").select(*key, "change_type")
    rest = [c for c in states.columns if c not in key and c != "is_deleted"]
    rows = changed.join(states.select(*key, *rest), key, "left").withColumn("is_deleted", F.col("change_type") == "deleted")
    return rows, diff_counts(diff)


def validated_titles(stored: DataFrame, given: DataFrame, text: str = "text_content") -> DataFrame:
    """Each title's stored sections against those of a release point: matched, differing, missing and extra ones, with the first difference."""
    key = ["title_number", "section_number"]
    a, b = stored.select(*key, F.col(text).alias("_a"), F.lit(True).alias("_in_a")), given.select(*key, F.col(text).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full")
    here = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    said = F.when(here, described_difference(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit(""))))
    rows = both.withColumn("_said", said)
    return rows.groupBy("title_number").agg(
        F.count_if(here & F.col("_said").isNull()).alias("matched"), F.count_if(F.col("_said").isNotNull()).alias("differing"), F.count_if(F.col("_in_a").isNull()).alias("missing"),
        F.count_if(F.col("_in_b").isNull()).alias("extra"), F.min_by("_said", F.when(F.col("_said").isNotNull(), F.col("section_number"))).alias("first_difference"),
    )


def verifications(known: DataFrame, new: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All verifications in the order of their dates within a session, and the new ones whose session is unknown."""
    good, bad = split_known(new, sessions, ["session_id"])
    w = Window.partitionBy("session_id").orderBy("verified_at", "verifier")
    return known.unionByName(good).withColumn("position", F.row_number().over(w)), bad


def linked(content: Column, shown: Column) -> tuple[Column, Column]:
    """(links, text): the display texts found in a content, longest first where they overlap, and the content with each in double brackets."""
    plain = F.filter(F.array_distinct(shown), lambda x: x != "")
    longest = F.transform(F.array_sort(F.transform(plain, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: F.concat(F.lit("\\Q"), s["x"], F.lit("\\E")))
    pattern = F.concat(F.lit("("), F.array_join(longest, "|"), F.lit(")"))
    some = F.size(plain) > 0
    return F.when(some, F.regexp_extract_all(content, pattern, F.lit(1))).otherwise(F.array().cast("array<string>")), F.when(some, F.regexp_replace(content, pattern, F.lit("[[$1]]"))).otherwise(content)

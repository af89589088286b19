"""Playing the timeline forward: where the head stands, what comes next, what each law does, and the revisions that come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .apply import play_forward
from .compare import checkpoint, checkpoint_summary
from .relations import TIMELINE_ORDER, not_deferred

OUTCOMES = ("deferred", "missing", "failed", "applied")


def _place() -> Column:
    return F.struct(*TIMELINE_ORDER)


def head_event(events: DataFrame, head: str) -> DataFrame:
    """The event that made the head revision, found by its identifier; no row if the timeline doesn't have it."""
    return events.where(F.col("identifier") == head).orderBy(*TIMELINE_ORDER).limit(1)


def pending_events(events: DataFrame, head: str) -> DataFrame:
    """All events after the head's; without it in the timeline, all events."""
    at = head_event(events, head).agg(F.max(_place()).alias("_at"))
    return events.join(F.broadcast(at), F.col("_at").isNull() | (_place() > F.col("_at"))).drop("_at")


def next_events(events: DataFrame, head: str, count: int) -> DataFrame:
    """The `count` events that follow the head's."""
    return pending_events(events, head).orderBy(*TIMELINE_ORDER).limit(count)


def events_until(events: DataFrame, head: str, release_point: str) -> DataFrame:
    """The events after the head's up to a release point, it included; an error if that isn't ahead."""
    ahead = pending_events(events, head)
    end = ahead.where((F.col("identifier") == release_point) & (F.col("event_type") == "release_point")).agg(F.max(_place()).alias("_end"))
    if end.first()["_end"] is None:
        raise KeyError(f"no such release point ahead: {release_point}")
    return ahead.join(F.broadcast(end), _place() <= F.col("_end")).drop("_end")


def law_outcomes(events: DataFrame, deferred: DataFrame, texts: DataFrame, changes: DataFrame) -> DataFrame:
    """What becomes of each law: deferred (a release point leaves it out), missing (no text), failed (no change found) or applied."""
    laws = events.where("event_type = 'public_law'").select("identifier", "congress", "law_number")
    kept = not_deferred(laws, deferred).select("identifier", F.lit(True).alias("_kept"))
    found = changes.groupBy("identifier").agg(F.count(F.lit(1)).alias("changes"))
    rows = laws.join(kept, "identifier", "left").join(texts.select("identifier", F.lit(True).alias("_text")).distinct(), "identifier", "left").join(found, "identifier", "left")
    outcome = F.when(F.col("_kept").isNull(), "deferred").when(F.col("_text").isNull(), "missing").when(F.col("changes").isNull(), "failed").otherwise("applied")
    return rows.select("identifier", outcome.alias("outcome"), F.coalesce("changes", F.lit(0)).alias("changes"))


def new_revisions(events: DataFrame, outcomes: DataFrame, head: int, sequence: int) -> DataFrame:
    """A revision for each applied law and each release point, in order, with ids and sequence numbers after the head's; each one's parent is the one before it.

    Events are numbered within their month, after those of all months before: the window over
    months has no more rows than the calendar.
    """
    laws = outcomes.where("outcome = 'applied'").select("identifier")
    own = events.where("event_type = 'release_point'").unionByName(events.where("event_type = 'public_law'").join(laws, "identifier", "left_semi"))
    own = own.withColumn("_month", F.trunc("sort_date", "month"))
    months = own.groupBy("_month").agg(F.count(F.lit(1)).alias("_n"))
    months = months.select(F.col("_month").alias("_m"), (F.sum("_n").over(Window.orderBy("_month")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_month").orderBy(*TIMELINE_ORDER)) + F.col("_before")
    rows = own.join(months, F.col("_month").eqNullSafe(F.col("_m"))).withColumn("_number", number)
    return rows.select(
        (F.lit(head) + F.col("_number")).cast("long").alias("revision_id"), (F.lit(head) + F.col("_number") - 1).cast("long").alias("parent_revision_id"),
        (F.lit(sequence) + F.col("_number")).cast("long").alias("sequence_number"), "identifier", "event_type", (F.col("event_type") == "release_point").alias("is_ground_truth"),
    )


def played_states(states: DataFrame, changes: DataFrame, laws: DataFrame, revision: int, parent: int) -> DataFrame:
    """The snapshots of one revision that plays all laws over their sections: text, hash, tombstone and what came of the changes.

    Only sections that a law changes get a snapshot; the others are found along the parent link.
    """
    done = play_forward(states, changes, laws)
    return done.where("applied > 0").select(*done.columns, F.lit(revision).cast("long").alias("revision_id"), F.lit(parent).cast("long").alias("parent_revision_id"))


def advanced(states: DataFrame, changes: DataFrame, laws: DataFrame, truth: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The state after all laws, and its comparison with a release point's ground truth."""
    done = play_forward(states, changes, laws, key)
    same = states.join(done.select(*key), key, "left_anti").select(*key, "text_hash", "notes_hash", "is_deleted")
    new = done.where("not is_deleted").join(states.select(*key, "notes_hash"), key, "left").select(*key, "text_hash", "notes_hash", "is_deleted")
    after = same.unionByName(new)
    return after, checkpoint(after, truth, key)


def advance_report(outcomes: DataFrame, compared: DataFrame) -> DataFrame:
    """One row: laws by outcome, and the checkpoint's counts."""
    counts = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(f"laws_{o}") for o in OUTCOMES), F.sum("changes").alias("changes"))
    return counts.crossJoin(checkpoint_summary(compared))

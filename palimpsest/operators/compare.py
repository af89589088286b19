"""Comparison of two sets of states by full outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join; columns but the key get the suffixes _a and _b, and in_a and in_b tell the sides."""
    left = a.select(*key, *(F.col(c).alias(f"{c}_a") for c in a.columns if c not in key), F.lit(True).alias("in_a"))
    right = b.select(*key, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in key), F.lit(True).alias("in_b"))
    return left.join(right, key, "full_outer")


def diff_states(before: DataFrame, after: DataFrame, key: list[str], text: str = "text_hash", notes: str | None = "notes_hash") -> DataFrame:
    """Keys that were added, deleted or modified, with text_changed and notes_changed.

    Missing values equal each other. An added or deleted section has changed notes if it has any.
    """
    return diff_of(_both(before, after, key), key, text, notes)


def diff_of(rows: DataFrame, key: list[str], text: str = "text_hash", notes: str | None = "notes_hash") -> DataFrame:
    """`diff_states` of rows that hold both states of a key already (see snapshots.two_states)."""
    text_changed = ~F.col(f"{text}_a").eqNullSafe(F.col(f"{text}_b"))
    if notes:
        a, b = F.col(f"{notes}_a"), F.col(f"{notes}_b")
        notes_changed = F.when(F.col("in_a").isNull(), b.isNotNull()).when(F.col("in_b").isNull(), a.isNotNull()).otherwise(~a.eqNullSafe(b))
    else:
        notes_changed = F.lit(False)
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(text_changed | notes_changed, "modified").otherwise("unchanged")
    present = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return rows.select(*key, kind.alias("change_type"), (~present | text_changed).alias("text_changed"), notes_changed.alias("notes_changed"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count(F.lit(1)).alias("sections"))


def checkpoint(derived: DataFrame, truth: DataFrame, key: list[str], text: str = "text_hash", notes: str = "notes_hash", deleted: str = "is_deleted") -> DataFrame:
    """Each key's outcome: match, text_mismatch, notes_mismatch, deleted_mismatch, only_derived or only_truth."""
    return checkpoint_of(_both(derived, truth, key), key, text, notes, deleted)


def checkpoint_of(rows: DataFrame, key: list[str], text: str = "text_hash", notes: str = "notes_hash", deleted: str = "is_deleted") -> DataFrame:
    """`checkpoint` of rows that hold both states of a key already."""
    same = lambda c: F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    outcome = (
        F.when(F.col("in_b").isNull(), "only_derived").when(F.col("in_a").isNull(), "only_truth").when(~same(deleted), "deleted_mismatch")
        .when(~same(text), "text_mismatch").when(~same(notes), "notes_mismatch").otherwise("match")
    )
    return rows.select(*key, outcome.alias("outcome"))


def checkpoint_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts, and is_clean if all match."""
    kinds = ("match", "text_mismatch", "notes_mismatch", "deleted_mismatch", "only_derived", "only_truth")
    counts = outcomes.agg(F.count(F.lit(1)).alias("sections"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))
    return counts.withColumn("is_clean", F.col("match") == F.col("sections"))


def precision_recall(found: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """matched, only_found, only_wanted, precision and recall of two sets of keys (0 where undefined)."""
    rows = _both(found.select(*key).distinct(), wanted.select(*key).distinct(), key)
    n = rows.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("matched"), F.count_if(F.col("in_b").isNull()).alias("only_found"), F.count_if(F.col("in_a").isNull()).alias("only_wanted")
    )
    ratio = lambda other: F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col(other)), F.lit(0.0))
    return n.withColumns({"precision": ratio("only_found"), "recall": ratio("only_wanted")})

"""What a reader of a code sees: tables of contents, a section with its history, and a law's changes as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import first_amendment
from .apply import line_hunks
from .relations import descendants
from .snapshots import KEY, real_changes

#: What is added to sections' sort orders, so that they come after groups.
AFTER_GROUPS = 1 << 40


def section_summary(states: DataFrame) -> DataFrame:
    """A section's line in a table of contents, with the year and law of its first amendment from its notes."""
    first = first_amendment(F.col("notes"))
    return states.select(*KEY, "group_id", "heading", "sort_order", first["year"].alias("last_amendment_year"), first["law"].alias("last_amendment_law"))


def title_tree(groups: DataFrame, sections: DataFrame, root: str) -> DataFrame:
    """A title's groups and sections, a row each, with depth and place: in the order of place they read as a table of contents.

    place holds the sort orders from below the root down; sections come after the groups of the same
    parent. Only the root's own descendants are walked.
    """
    own = descendants(groups.withColumnRenamed("group_id", "id"), root, "sort_order")
    heads = own.join(groups.select(F.col("group_id").alias("id"), "heading"), "id").select("id", "depth", "place", F.lit("group").alias("kind"), "heading")
    last = F.array(F.col("sort_order").cast("long") + AFTER_GROUPS)
    leaves = sections.join(own.withColumnRenamed("id", "group_id"), "group_id")
    return heads.unionByName(leaves.select(F.col("section_number").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("place", last).alias("place"), F.lit("section").alias("kind"), "heading"))


def section_view(states: DataFrame, snapshots: DataFrame, chain: DataFrame, groups: DataFrame) -> DataFrame:
    """Each live section with its group's heading, its real changes (number, newest and oldest revision) and whether it has notes."""
    changes = real_changes(snapshots, chain).groupBy(*KEY).agg(F.count(F.lit(1)).alias("changes"), F.max("revision_id").alias("changed_at"), F.min("revision_id").alias("first_revision"))
    heads = groups.select("group_id", F.col("heading").alias("group_heading"))
    rows = states.join(changes, KEY, "left").join(heads, "group_id", "left")
    return rows.withColumns({"changes": F.coalesce("changes", F.lit(0)), "has_notes": F.col("notes_hash").isNotNull()})


def diff_cards(before: DataFrame, after: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, lines): a card for each changed section: body where its text changed, note where its notes changed, added for new notes; and the body's hunks."""
    key = key or KEY
    a = before.select(*key, F.col("text_content").alias("_t"), F.col("notes").alias("_n"), F.lit(True).alias("_a"))
    b = after.select(*key, "text_content", "notes", F.lit(True).alias("_b"))
    both = b.join(a, key, "full")
    kinds = F.array_compact(F.array(
        F.when(~F.col("text_content").eqNullSafe(F.col("_t")), "body"), F.when(F.col("_n").isNull() & F.col("notes").isNotNull(), "added_note"),
        F.when(F.col("_n").isNotNull() & ~F.col("notes").eqNullSafe(F.col("_n")), "note"),
    ))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    cards = both.select(*key, change.alias("change"), F.explode(kinds).alias("card"))
    return cards, line_hunks(both, key, "_t", "text_content")


def standalone_provisions(provisions: DataFrame, text: str = "text", excerpt: int = 300) -> DataFrame:
    """Provisions of a law that change no other law: without an amending word, a sidenote or an edit, with the beginning of their text."""
    amends = r"(?i)\b(?:is|are)\s+(?:hereby\s+)?(?:amended|repealed|redesignated|transferred)\b|\bby\s+(?:striking|inserting|adding|redesignating)\b"
    rows = provisions.where(~F.col(text).rlike(amends) & ~F.coalesce("has_sidenote", F.lit(False)))
    return rows.withColumn("excerpt", F.concat(F.substring(text, 1, excerpt), F.when(F.length(text) > excerpt, "...").otherwise("")))

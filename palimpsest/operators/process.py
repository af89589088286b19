"""From the text of laws to changes: edits, their coverage, what goes on to the next mode, resolved places, and a report for each law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_words
from .extract import coverage, extract_edits, unclaimed
from .history import to_seed
from .maintenance import change_description
from .prose import escalation, resolved


def parse_sessions(laws: DataFrame, edits: DataFrame, key: str = "law_id", text: str = "text", mode: str = "RegEx") -> DataFrame:
    """A row for each law: coverage, edits, those to review, unclaimed stretches with edit words, and whether and why it goes on to the next mode."""
    counts = edits.groupBy(key).agg(F.count(F.lit(1)).alias("edits"), F.count_if("needs_review").alias("needs_review"))
    flagged = unclaimed(laws, edits, key, text).where(F.size(edit_words(F.col("gap_text"))) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("flagged"))
    rows = coverage(laws, edits, key, text).join(counts, key, "left").join(flagged, key, "left").fillna(0, ["edits", "needs_review", "flagged"])
    return escalation(rows.withColumn("mode", F.lit(mode)))


def changes_of(edits: DataFrame, default_title: Column, key: str = "law_id") -> DataFrame:
    """The changes that edits with a known place make, numbered in the law's order, with their descriptions; edits to review are held back."""
    placed = resolved(edits, default_title)
    said = change_description(F.col("change_type"), F.col("title_number"), F.col("section_number"), F.col("old_text"), F.col("new_text"))
    rows = placed.withColumns({"status": F.when(F.col("error").isNotNull(), "unresolved").when(F.col("needs_review"), "held").otherwise("made"), "description": F.when(F.col("error").isNull(), said)})
    return rows.select(key, F.col("start_pos").alias("change_id"), "title_number", "section_number", "subsection_path", "change_type", "old_text", "new_text", "confidence", "status", "error", "description")


def process_laws(laws: DataFrame, processed: DataFrame, default_title: Column, key: str = "law_id", text: str = "text", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, sessions) of the laws that haven't been processed, or of all if forced; run again over its own results, it adds nothing."""
    todo = to_seed(laws, processed, [key], force)
    edits = extract_edits(todo, key, text)
    return changes_of(edits, default_title, key), parse_sessions(todo, edits, key, text)


def impact_detail(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """Changes with the heading of the section that they change, where it is known."""
    return changes.join(sections.select("title_number", "section_number", "heading"), ["title_number", "section_number"], "left")


def dependencies(references: DataFrame, sections: DataFrame) -> DataFrame:
    """Outgoing references of sections, with the heading of what they point at; references into nothing are left out."""
    target = sections.select(F.col("title_number").alias("to_title"), F.col("section_number").alias("to_section"), F.col("heading").alias("to_heading"))
    return references.join(target, ["to_title", "to_section"])


def display_title(aliases: Column, short: Column, official: Column) -> Column:
    """A law's first alias, else its short title, else its official one."""
    return F.coalesce(F.get(aliases, F.lit(0)), short, official)

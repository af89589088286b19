"""Schemas of the versioned-text entities."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "date": DateType(), "boolean": BooleanType(), "double": DoubleType()}


def of(text: str) -> StructType:
    """A schema from 'name kind, name kind, ...'."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


LINE = of("line_number int, content string, indent_level int, marker string, is_header boolean, start_char int, end_char int")
LINES = ArrayType(LINE)
REVISION = of("revision_id long, revision_type string, release_point_id long, law_id long, parent_revision_id long, effective_date date, is_ground_truth boolean, status string, summary string, sequence_number int")
SNAPSHOT = of("snapshot_id long, revision_id long, title_number int, section_number string, heading string, text_content string, text_hash string, notes string, notes_hash string, full_citation string, is_deleted boolean, group_id string, sort_order int")
GROUP = of("group_id string, parent_id string, group_type string, number string, name string, sort_order int, is_positive_law boolean, positive_law_date date")
LAW = of("law_id long, congress int, law_number string, law_type string, popular_name string, official_title string, short_title string, enacted_date date, effective_date date, president string")
LAW_CHANGE = of("change_id long, law_id long, title_number int, section_number string, change_type string, old_text string, new_text string, effective_date date, description string, subsection_path string")
TIMELINE_EVENT = of("event_type string, identifier string, congress int, law_number int, event_date date, law_id long")
RELEASE_POINT = of("full_identifier string, congress int, law_identifier string, publication_date date")
TEXT_SPAN = of("session_id long, start_pos int, end_pos int, amendment_id long, pattern_name string")
MAPPING = of("mapping_id long, committee_id long, title_number int, chapter_start string, chapter_end string, congress_start int, congress_end int, is_primary boolean")
COMMITTEE = of("committee_id long, code string, name string, chamber string")

#: The kinds of change, the states of a revision, and the outcomes of applying a change.
CHANGE_TYPES = ("Add", "Delete", "Modify", "Repeal", "Redesignate", "Transfer", "Add_Note")
REVISION_STATUS = ("Pending", "Ingesting", "Ingested", "Failed")
OUTCOMES = ("APPLIED", "SKIPPED", "FAILED")

"""Rows in the forms in which others read them: states, schemas, roots, orders, law texts with what is known of the laws, and edits parsed when they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import extract_edits
from .prose import start_lines
from .xml_edits import extract_xml_edits

#: The kinds of bills, as laws' tables write them, with the codes of the bills' own.
BILL_TYPES = {"H.R.": "hr", "S.": "s", "H.J.Res.": "hjres", "S.J.Res.": "sjres", "H.Con.Res.": "hconres", "S.Con.Res.": "sconres", "H.Res.": "hres", "S.Res.": "sres"}
STATE = ["title_number", "section_number", "heading", "text_content", "text_hash", "notes", "notes_hash", "is_deleted", "snapshot_id", "revision_id", "sort_order"]


def as_states(snapshots: DataFrame) -> DataFrame:
    """Snapshots as states of sections: the columns of STATE, those that are missing as nulls; a null flag counts as not deleted."""
    kinds = {"title_number": "int", "is_deleted": "boolean", "snapshot_id": "long", "revision_id": "long", "sort_order": "int"}
    column = lambda c: F.col(c) if c in snapshots.columns else F.lit(None).cast(kinds.get(c, "string"))
    return snapshots.select(*((F.coalesce(column(c), F.lit(False)) if c == "is_deleted" else column(c)).alias(c) for c in STATE))


def ordered(states: DataFrame) -> DataFrame:
    """States by title, then by section number as text: 10 before 2."""
    return states.orderBy("title_number", "section_number")


def placed_titles(groups: DataFrame) -> DataFrame:
    """The titles among groups with their place (from 1) in the order of their numbers as text: 1, 10, 2. There are few of them."""
    titles = groups.where(F.col("group_type") == "title")
    return titles.withColumn("place", F.row_number().over(Window.orderBy("number")))


def root_revision(point: DataFrame) -> DataFrame:
    """The first revision, made of a release point (release_point_id, identifier, publication_date): without parent, number 0, ground truth that is still being taken in."""
    return point.select(
        F.lit("Release_Point").alias("revision_type"), "release_point_id", F.lit(None).cast("long").alias("law_id"), F.lit(None).cast("long").alias("parent_revision_id"), F.col("publication_date").alias("effective_date"),
        F.lit(True).alias("is_ground_truth"), F.lit("Ingesting").alias("status"), F.concat(F.lit("Initial commit: "), "identifier").alias("summary"), F.lit(0).alias("sequence_number"),
    )


def existing(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """How many rows there are already for each wanted key, 0 where there is none."""
    counts = rows.join(wanted.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("existing"))
    return wanted.select(*key).distinct().join(counts, key, "left").withColumn("existing", F.coalesce("existing", F.lit(0).cast("long")))


def bill_of(bill_type: Column, bill_number: Column, origin: Column) -> Column:
    """(kind, number) of a law's bill: as its own columns say, else as its origin, such as 'H.R. 1234' or 's123', is read; null if neither tells."""
    codes = F.create_map(*(F.lit(x) for k, v in BILL_TYPES.items() for x in (k.lower().replace(".", ""), v)))
    plain = F.lower(F.regexp_replace(origin, r"[.\s]", ""))
    read = codes[F.regexp_extract(plain, r"^([a-z]+)([0-9]+)$", 1)]
    number = F.regexp_extract(plain, r"^([a-z]+)([0-9]+)$", 2).try_cast("int")
    own = codes[F.lower(F.regexp_replace(bill_type, r"[.\s]", ""))]
    ok = own.isNotNull() & bill_number.isNotNull()
    return F.when(ok, F.struct(own.alias("bill_type"), bill_number.cast("int").alias("bill_number"))).when(read.isNotNull() & number.isNotNull(), F.struct(read.alias("bill_type"), number.alias("bill_number")))


def act_titles(chapters: DataFrame, known: DataFrame, key: str = "chapter") -> DataFrame:
    """Chapters of acts from before laws had numbers, with the acts' titles where they are known."""
    return chapters.join(known.select(key, F.col("title").alias("act_title")), key, "left")


def law_texts(laws: DataFrame, texts: DataFrame, htm: bool = True, xml: bool = True) -> DataFrame:
    """Laws (congress, law_number) with their texts in either format, and what is known of them; laws with neither text are left out, texts of unknown laws stay.

    texts: congress, law_number, format (htm or xml) and content.
    """
    wanted = [f for f, on in (("htm", htm), ("xml", xml)) if on]
    key = ["congress", "law_number"]
    body = texts.where(F.col("format").isin(*wanted) & (F.col("content") != "")).groupBy(*key).agg(*(F.max(F.when(F.col("format") == f, F.col("content"))).alias(f"{f}_content") for f in wanted))
    title = F.coalesce("popular_name", "short_title", "official_title")
    return body.join(laws.select(*key, title.alias("title"), "enacted_date"), key, "left")


def parsed_when_asked(laws: DataFrame, lines: DataFrame, key: str = "law_id") -> DataFrame:
    """The edits of laws (key, xml, text), with source 'xml' or 'text', and the start_line of their old text in the lines of their section.

    A law is read by its XML; one without XML, or whose XML gives no edit, by its text. lines:
    title_number, section_number, line_number, content.
    """
    columns = [key, "change_type", "title_number", "section_number", "subsection_path", "old_text", "new_text", "confidence", "needs_review"]
    by_xml = extract_xml_edits(laws.where("xml IS NOT NULL"), key).select(*columns, "seq", F.lit("xml").alias("source"))
    rest = laws.join(by_xml.select(key).distinct(), key, "left_anti").where("text IS NOT NULL")
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_pos", "old_text")) - 1
    by_text = extract_edits(rest, key).select(*columns, number.cast("int").alias("seq"), F.lit("text").alias("source"))
    return start_lines(by_xml.unionByName(by_text), lines, ["title_number", "section_number"], key)

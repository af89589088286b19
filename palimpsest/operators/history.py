"""The way of a bill to a law: classified actions, sponsors, votes, status, and what hangs on a law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headings import action_event, event_title, served
from ..functions.text import full_name


def tally(text: Column) -> Column:
    """(yeas, nays, not_voting) of the first 'n - n' or 'n - n - n' in a text."""
    pattern = r"([0-9]+)\s*[-–]\s*([0-9]+)(?:\s*[-–]\s*([0-9]+))?"
    return F.struct(*(F.regexp_extract(text, pattern, k).try_cast("int").alias(n) for k, n in ((1, "yeas"), (2, "nays"), (3, "not_voting"))))


def classified_actions(actions: DataFrame, law: list[str], order: list[str], kind: str = "action_type", text: str = "text", chamber: str = "chamber") -> DataFrame:
    """Adds event_type, is_milestone, the vote, event_title and sort_order (from 0 within the law) to a bill's actions.

    Passages and the president's actions are milestones, and so are the first introduction and the
    first referral of a law. A window holds one bill's actions.
    """
    rows = actions.withColumn("event_type", action_event(F.col(kind), F.col(text), F.col(chamber)))
    first = F.row_number().over(Window.partitionBy(*law, "event_type").orderBy(*order)) == 1
    milestone = F.col("event_type").isin("house_vote", "senate_vote", "presidential_action") | (F.col("event_type").isin("introduced", "committee_referral") & first)
    number = F.row_number().over(Window.partitionBy(*law).orderBy(*order)) - 1
    rows = rows.withColumns({"is_milestone": milestone, "sort_order": number, "_vote": tally(F.col(text)), "event_title": event_title(F.col("event_type"), F.col(text), F.col(chamber))})
    return rows.select("*", *(F.col(f"_vote.{k}").alias(f"vote_{k}") for k in ("yeas", "nays", "not_voting"))).drop("_vote")


def ordered_sponsors(sponsors: DataFrame, law: list[str], primary: str = "is_primary", order: str = "position") -> DataFrame:
    """Sponsors with their display names, the primary one first; sort_order counts from 0 within the law."""
    name = F.coalesce(F.nullif(full_name(*(F.coalesce(c, F.lit("")) for c in ("first_name", "middle_name", "last_name")), F.lit("")), F.lit("")), F.col("full_name"))
    w = Window.partitionBy(*law).orderBy(F.desc(primary), order)
    return sponsors.withColumns({"name": name, "sort_order": F.row_number().over(w) - 1})


def law_status(actions: DataFrame, law: list[str]) -> DataFrame:
    """enacted, vetoed or pending for each law with classified actions, by the last of the president's, with the last vote of each chamber."""
    last = lambda value, when: F.max_by(value, F.when(when, F.col("sort_order")))
    votes = {c: F.struct("vote_yeas", "vote_nays") for c in ("house", "senate")}
    out = actions.groupBy(*law).agg(
        last("event_title", F.col("event_type") == "presidential_action").alias("_last"), F.count_if("is_milestone").alias("milestones"),
        *(last(v, F.col("event_type") == f"{c}_vote").alias(f"_{c}") for c, v in votes.items()),
    )
    status = F.when(F.col("_last") == "Signed into law", "enacted").when(F.col("_last") == "Vetoed by the President", "vetoed").otherwise("pending")
    return out.select(*law, status.alias("status"), "milestones", *(F.col(f"_{c}.vote_{k}").alias(f"{c}_{k}") for c in votes for k in ("yeas", "nays")))


def to_seed(laws: DataFrame, seeded: DataFrame, law: list[str], force: bool = False) -> DataFrame:
    """Laws whose history is still to be loaded; all of them if forced."""
    return laws if force else laws.join(seeded.select(*law).distinct(), law, "left_anti")


def parent_revisions(laws: DataFrame, revisions: DataFrame, law: list[str]) -> DataFrame:
    """Each law's parent revision: that of its own newest revision, else the head (the largest sequence number)."""
    own = revisions.groupBy(*law).agg(F.max_by("parent_revision_id", "sequence_number").alias("_own"))
    head = revisions.agg(F.max_by("revision_id", "sequence_number").alias("_head"))
    return laws.join(own, law, "left").crossJoin(F.broadcast(head)).withColumn("parent_revision_id", F.coalesce("_own", "_head")).drop("_own", "_head")


def related_laws(related: DataFrame, bills: DataFrame, laws: DataFrame) -> DataFrame:
    """Related bills with the number of the law that each became, if it did."""
    became = bills.join(laws.select("law_id", "law_number"), "law_id").select(F.col("bill_id").alias("related_bill_id"), "law_number")
    return related.join(became, "related_bill_id", "left")


def served_span(terms: DataFrame, member: list[str]) -> DataFrame:
    """First and last day served, from all terms of a member."""
    rows = terms.groupBy(*member).agg(F.min("start_year").alias("s"), F.max("end_year").alias("e"))
    span = served(F.array(F.struct(F.col("s").alias("start_year"), F.col("e").alias("end_year"))))
    return rows.withColumn("span", span).select(*member, "span.first_served", "span.last_served")


def normalized_terms(terms: DataFrame) -> DataFrame:
    """Terms with a start year; the state is XX and the end open where they are missing."""
    rows = terms.where("start_year is not null")
    return rows.withColumns({"state": F.coalesce("state", F.lit("XX")), "start_date": F.make_date("start_year", F.lit(1), F.lit(1)), "end_date": F.when(F.col("end_year").isNotNull(), F.make_date("end_year", F.lit(12), F.lit(31)))})


def with_statements(laws: DataFrame, statements: DataFrame, law: list[str]) -> DataFrame:
    """Laws with their signing statements; a law's own statement stays where it has one."""
    new = statements.groupBy(*law).agg(F.max_by("statement", "issued_date").alias("_new"))
    return laws.join(new, law, "left").withColumn("signing_statement", F.coalesce("signing_statement", "_new")).drop("_new")


def statement_text(html: Column) -> Column:
    """The <pre> of a statement's page without markup, bracketed header lines and runs of empty lines."""
    pre = F.regexp_extract(html, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    plain = F.regexp_replace(pre, r"<[^>]*>", "")
    lines = F.filter(F.split(plain, "\n"), lambda x: ~F.trim(x).rlike(r"^\[.*\]$"))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.rtrim(x)), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def focus_score(laws: DataFrame, changes: DataFrame, law: list[str]) -> DataFrame:
    """ln(1 + sections) of each law, its changes by section, days from introduction to enactment and the margin of its vote."""
    own = changes.groupBy(*law).agg(F.count_distinct("title_number", "section_number").alias("sections"), F.count(F.lit(1)).alias("changes"))
    rows = laws.join(own, law, "left").fillna(0, ["sections", "changes"])
    depth = F.coalesce(F.try_divide(F.col("changes"), F.col("sections")), F.lit(0.0))
    return rows.withColumns({"focus": F.log1p("sections"), "depth": depth, "days_to_passage": F.datediff("enacted_date", "introduced_date"), "margin": F.col("yeas") - F.col("nays")})

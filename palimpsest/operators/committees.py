"""Committees: their jurisdictions out of the rules of the House, and who owns which title or chapter."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headings import committee_code
from .relations import override, valid_at

_BLOCK = re.compile(r"(?is)<(p|h[1-6]|div|li)\b[^>]*>(.*?)(?=</\1>|<(?:p|h[1-6]|div|li)\b|\Z)")
_HEAD = re.compile(r"(?is)^\(([a-z])\)\s+((?:Permanent\s+Select\s+)?.*?\bCommittee\b.*?|Committee\b.*?)\.?$")
_ITEM = re.compile(r"(?s)^\(([0-9]+)\)\s+(.+)$")


def paragraphs(page: str) -> list[str]:
    """The text of a page's blocks, without markup and with white space as one space."""
    out = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", m[2])).split()) for m in _BLOCK.finditer(page)]
    return [x for x in out if x]


def rule_x(page: str) -> list[tuple[str, str, int, str]]:
    """(clause letter, committee, item number, item) of Rule X up to Rule XI; a committee without items has one without text."""
    out: list[tuple[str, str, int, str]] = []
    inside, letter, name, items = False, "", "", 0

    def close() -> None:
        if letter and not items:
            out.append((letter, name, 0, ""))

    for text in paragraphs(page):
        if re.fullmatch(r"(?i)rule\s+x\.?", text):
            inside = True
        elif re.fullmatch(r"(?i)rule\s+xi\.?", text):
            break
        elif inside and (m := _HEAD.match(text)):
            close()
            letter, name, items = m[1].lower(), m[2].strip().rstrip("."), 0
        elif inside and letter and (m := _ITEM.match(text)):
            items += 1
            out.append((letter, name, int(m[1]), m[2].strip()))
    close()
    return out


def jurisdictions(rules: DataFrame, codes: dict[str, str], congress: str = "congress", page: str = "html") -> DataFrame:
    """A row for each committee of each Congress's rules: clause, citation, name, code (null if unknown) and its numbered items as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(c, n, *x) for c, t in zip(p["c"], p["t"], strict=True) for n, x in enumerate(rule_x(t or ""))]
            yield pd.DataFrame(rows, columns=["congress", "place", "clause_letter", "committee_name", "item", "said"])

    kind = rules.schema[congress].dataType.simpleString()
    items = rules.select(F.col(congress).alias("c"), F.col(page).alias("t")).mapInPandas(run, f"congress {kind}, place int, clause_letter string, committee_name string, item int, said string")
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("item") > 0, F.struct("place", "said")))), lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x["said"]))
    out = items.groupBy("congress", "clause_letter", "committee_name").agg(listed.alias("_items"))
    return out.select(
        "congress", "clause_letter", "committee_name", committee_code(F.col("committee_name"), codes).alias("committee_code"),
        F.concat(F.lit("House Rule X, Clause 1("), "clause_letter", F.lit(")")).alias("rule_citation"), F.array_join("_items", "\n").alias("jurisdiction_text"), F.size("_items").alias("items"),
    )


def upsert_jurisdictions(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The instances of known committees with the texts found for their Congress, and what was found for unknown ones."""
    key = ["congress", "committee_code"]
    new = found.where("committee_code is not null").select(*key, F.col("jurisdiction_text").alias("_text"), "rule_citation")
    rows = known.join(new, key, "left").withColumn("jurisdiction_text", F.coalesce("_text", "jurisdiction_text")).drop("_text")
    return rows, found.join(known.select(*key), key, "left_anti")


def resolved_owners(mappings: DataFrame, committees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings with their committee's id, and those of unknown codes for a table of rejects."""
    ids = committees.select("committee_code", "committee_id")
    return mappings.join(ids, "committee_code"), mappings.join(ids, "committee_code", "left_anti")


def _valid(rows: DataFrame, congress: int) -> Column:
    return valid_at("start_congress", "end_congress", F.lit(congress))


def owners_of_titles(mappings: DataFrame, committees: DataFrame, congress: int) -> DataFrame:
    """Owners of whole titles in a Congress: mappings without a chapter, with their committees."""
    rows = mappings.where(_valid(mappings, congress) & F.col("chapter").isNull())
    return rows.join(committees, "committee_id")


def all_owners(mappings: DataFrame, committees: DataFrame, congress: int) -> DataFrame:
    """All mappings valid in a Congress with their committees, by title and chapter, whole titles first."""
    return mappings.where(_valid(mappings, congress)).join(committees, "committee_id").orderBy("title_number", F.asc_nulls_first("chapter"), "committee_id")


def owners_of_chapters(chapters: DataFrame, mappings: DataFrame, congress: int) -> DataFrame:
    """The owner of each (title, chapter): the chapter's own, else the title's."""
    own = mappings.where(_valid(mappings, congress))
    by_chapter = own.where("chapter is not null").groupBy("title_number", "chapter").agg(F.min("committee_id").alias("committee_id"))
    by_title = own.where("chapter is null").groupBy("title_number").agg(F.min("committee_id").alias("committee_id"))
    return override(chapters, by_chapter, by_title, ["title_number", "chapter"], ["title_number"], "committee_id")


def instances(rows: DataFrame, committees: DataFrame, congress: int, chamber: str | None = None) -> DataFrame:
    """A Congress's committees, of one chamber if given."""
    out = rows.where(F.col("congress") == congress).join(committees, "committee_id")
    return out.where(F.col("chamber") == chamber) if chamber else out

"""Sections and groups from title files in the legislative XML schema."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headings import POSITIVE_LAW

#: The elements that group sections, and those that make up a section's text.
GROUPS = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "division", "subdivision")
LEVELS = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
SECTIONS = "path string, title_number int, section_number string, heading string, text_content string, group_key string, sort_order int"
GROUP_ROWS = "path string, group_key string, parent_key string, group_type string, number string, name string, sort_order int"


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def said(e: ElementTree.Element | None, numbers: bool = False) -> str:
    """An element's text with white space as one space and none before stops; footnotes' bodies go, their numbers too unless kept as [n]; small capitals in title case."""

    def parts(x: ElementTree.Element) -> Iterator[str]:
        kind = _name(x)
        if kind == "note" and x.get("type") == "footnote":
            return
        if kind == "ref" and "footnoteRef" in (x.get("class") or ""):
            if numbers:
                yield f"[{''.join(x.itertext()).strip()}]"
            return
        small = "small-caps" in (x.get("style") or "") or x.get("class") == "small-caps"
        yield (x.text or "").title() if small else x.text or ""
        for c in x:
            yield from parts(c)
            yield c.tail or ""

    return re.sub(r"\s+([,.;:)])", r"\1", " ".join("".join(parts(e)).split())) if e is not None else ""


def _child(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in e if _name(c) == name), None)


def heading_of(e: ElementTree.Element) -> str:
    """An element's heading, without footnotes and the bracket that one may leave open."""
    return said(_child(e, "heading")).rstrip("[ ")


def _number(e: ElementTree.Element) -> str:
    num = _child(e, "num")
    value = (num.get("value") if num is not None else "") or said(num)
    return re.sub(r"^(?:§+|Sec\.|[A-Z][a-z]+)\s*|[.\s—–-]+$", "", value.strip())


def _body(e: ElementTree.Element, depth: int = 0) -> list[str]:
    """Lines of a section: each level on a line of its own, indented by a tab for each depth; footnotes are numbers in brackets."""
    own, below = [], []
    for c in e:
        kind = _name(c)
        if kind in LEVELS:
            below += _body(c, depth + 1)
        elif kind in ("num", "heading", "chapeau", "content", "continuation", "text") and not (depth == 0 and kind in ("num", "heading")):
            (below if kind == "continuation" else own).append(said(c, numbers=True) if kind != "continuation" else "\t" * depth + said(c, numbers=True))
    return (["\t" * max(0, depth - 1) + " ".join(x for x in own if x)] if any(own) else []) + below


def title_of(root: ElementTree.Element) -> tuple[int | None, str, bool]:
    """(number, name, positive law) of the title that a file holds.

    The number stands in the title's own number, in the metadata, in the root's attributes or in an
    identifier; the first of these counts. A title without a name is named by its number, one in
    capitals gets small letters. Whether it is positive law is said in the metadata, else known.
    """
    about = {x for e in root.iter() if _name(e) == "meta" for x in e.iter()}
    first = lambda kind: next((e for e in root.iter() if _name(e) == kind and e not in about), None)
    title, document = first("title"), next((e for e in root.iter() if _name(e) == "docNumber"), None)
    said_number = [_number(title) if title is not None else "", said(document), root.get("number") or ""]
    said_number += [m[1] for e in (root, title) if e is not None and (m := re.search(r"/t([0-9]+)", e.get("identifier") or ""))]
    number = next((int(x) for x in said_number if x.strip().isdigit()), None)
    name = heading_of(title) if title is not None else ""
    if not name and (heading := first("heading")) is not None:
        name = said(heading)
    marked = next((said(e).lower() for e in root.iter() if _name(e) == "property" and e.get("role") == "is-positive-law"), "")
    return number, name or f"Title {number or 0}", marked == "yes" or number in POSITIVE_LAW


def parse_title(path: str, xml: str) -> tuple[list[tuple], list[tuple]]:
    """(sections, groups) of one file; a file that can't be parsed has none.

    Groups and sections may stand anywhere below the root, whatever it is called; a file without an
    element for its title gets a group for it, if its number is known.
    """
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return [], []
    sections: list[tuple] = []
    groups: list[tuple] = []
    known, name, _ = title_of(root)

    def walk(e: ElementTree.Element, key: str, title: int | None) -> None:
        for c in e:
            kind = _name(c)
            if kind == "level" and (kind := c.get("role") or "") not in GROUPS:
                walk(c, key, title)
            elif kind in GROUPS:
                number = _number(c) or (str(known) if kind == "title" and known else "")
                own = f"{key}/{kind}:{number}" if key else f"{kind}:{number}"
                t = int(number) if kind == "title" and number.isdigit() else title
                groups.append((path, own, key or None, kind, number, heading_of(c) or (name if kind == "title" else ""), len(groups)))
                walk(c, own, t)
            elif kind == "section" and c.get("role") != "instruction":
                sections.append((path, title, _number(c), heading_of(c), "\n".join(_body(c)), key or None, len(sections)))
            elif kind != "meta" and not kind.startswith("quoted"):
                walk(c, key, title)

    key = ""
    if known and not any(_name(e) == "title" for part in root if _name(part) != "meta" for e in part.iter()):
        key = f"title:{known}"
        groups.append((path, key, None, "title", str(known), name, 0))
    walk(root, key, known)
    return sections, groups


def parse_sections(files: DataFrame) -> DataFrame:
    """Sections of all title files (path, text), with the hash of each text; one file at a time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for path, text in zip(p["path"], p["text"], strict=True):
                yield pd.DataFrame(parse_title(path, text or "")[0], columns=[x.split()[0] for x in SECTIONS.split(", ")]).astype({"title_number": "Int32"})

    return files.select("path", "text").mapInPandas(run, SECTIONS).withColumn("text_hash", F.sha2("text_content", 256))


def parse_groups(files: DataFrame) -> DataFrame:
    """Groups of all title files with ids that depend on their keys alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for path, text in zip(p["path"], p["text"], strict=True):
                yield pd.DataFrame(parse_title(path, text or "")[1], columns=[x.split()[0] for x in GROUP_ROWS.split(", ")])

    ids = {"group_id": F.sha2("group_key", 256), "parent_id": F.sha2("parent_key", 256)}
    return files.select("path", "text").mapInPandas(run, GROUP_ROWS).withColumns(ids)

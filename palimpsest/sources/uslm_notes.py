"""What stands beside the text of a section in the legislative XML schema: footnotes, the source credit, notes and references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .uslm import _child, _name, _number, said

SCHEMA = (
    "path string, title_number int, section_number string, heading string, footnotes array<string>, source_credit string, raw_notes string, "
    "refs array<struct<kind: string, href: string, said: string, suffix: string, note: string>>, levels array<struct<identifier: string, level: string>>"
)
#: What an identifier's parts stand for, and how links name what they point at.
LEVEL_OF = {"st": "subtitle", "d": "division", "ch": "chapter", "sch": "subchapter", "pt": "part", "spt": "subpart", "t": "title", "s": "section"}
KINDS = {"/us/pl/": "public_law", "/us/act/": "act", "/us/usc/": "usc_section", "/us/stat/": "statute"}


def level_type(identifier: str | None, role: str | None) -> str | None:
    """The level that the last part of an identifier names, such as /us/usc/t17/ch1; else the role."""
    last = re.match(r"[a-z]+", (identifier or "").rstrip("/").rpartition("/")[2])
    return LEVEL_OF.get(last[0]) if last and last[0] in LEVEL_OF else role


def marked(e: ElementTree.Element, depth: int = 0) -> str:
    """The text of notes with marks: [NH] headings, [H1] cross-headings, [H2] italics, [QC:n] quoted content, [SIG] signatures, [PARA] between paragraphs."""
    out = []
    for c in e:
        kind, text = _name(c), said(c)
        if kind == "heading":
            out.append(f"[NH]{text}[/NH]")
        elif kind == "crossHeading":
            out.append(f"[H1]{text}[/H1]")
        elif kind == "quotedContent":
            out.append(f"[QC:{depth + 1}]{text}[/QC]")
        elif kind == "signature":
            out.append(f"[SIG]{text}[/SIG]")
        elif kind in ("note", "notes"):
            out.append(marked(c, depth))
        elif kind == "i" and text:
            out.append(f"[H2]{text}[/H2]")
        elif kind in ("p", "content") and any(_name(x) in ("quotedContent", "heading", "p") for x in c):
            out.append(marked(c, depth))
        elif text:
            out.append(f"{text}[PARA]" if kind == "p" else text)
    return " ".join(x for x in ([" ".join((e.text or "").split())] if _name(e) in ("p", "content") else []) + out if x)


def references(section: ElementTree.Element) -> list[dict]:
    """Links in a section, with their kind, the subdivisions in parentheses that follow them, and the heading of the note around them."""
    out: list[dict] = []

    def walk(e: ElementTree.Element, note: str | None) -> None:
        if _name(e) == "note":
            note = said(_child(e, "heading")) or note
        for c in e:
            href = c.get("href") or ""
            if _name(c) == "ref" and (kind := next((k for p, k in KINDS.items() if href.startswith(p)), None)):
                suffix = re.match(r"(?:\s*\([0-9A-Za-z]+\))*", c.tail or "")
                out.append({"kind": kind, "href": href, "said": said(c), "suffix": "".join(suffix[0].split()), "note": note})
            walk(c, note)

    walk(section, None)
    return out


def parse_notes(path: str, xml: str) -> tuple[list[tuple], str | None]:
    """(rows, error) of one file; a file that can't be parsed has no rows and says why."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return [], str(e)
    rows: list[tuple] = []

    def walk(e: ElementTree.Element, title: int | None, levels: list[dict]) -> None:
        for c in e:
            kind = _name(c)
            if kind == "section" and c.get("role") != "instruction":
                foot = [" ".join("".join(x.itertext()).split()) for x in c.iter() if _name(x) == "note" and x.get("type") == "footnote"]
                notes = " ".join(marked(x) for x in c if _name(x) == "notes")
                rows.append((path, title, _number(c), said(_child(c, "heading")).rstrip("[ "), foot, said(_child(c, "sourceCredit")) or None, notes or None, references(c), levels))
            else:
                own = level_type(c.get("identifier"), c.get("role")) if c.get("identifier") else None
                number = _number(c) if kind == "title" else ""
                walk(c, int(number) if number.isdigit() else title, [*levels, {"identifier": c.get("identifier"), "level": own}] if own else levels)

    walk(root, None, [])
    return rows, None


def section_notes(files: DataFrame) -> DataFrame:
    """Heading, footnotes, source credit, raw notes, references and levels of each section of all files (path, text)."""
    names = re.findall(r"(?:^|, )(\w+) (?=string|int|array)", SCHEMA)[:9]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for path, text in zip(p["path"], p["text"], strict=True):
                yield pd.DataFrame(parse_notes(path, text or "")[0], columns=names).astype({"title_number": "Int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def rejected_files(files: DataFrame) -> DataFrame:
    """(path, error) of the files that are no well-formed XML, null and empty ones included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            bad = [(path, parse_notes(path, text or "")[1]) for path, text in zip(p["path"], p["text"], strict=True)]
            yield pd.DataFrame([x for x in bad if x[1]], columns=["path", "error"])

    return files.select("path", "text").mapInPandas(run, "path string, error string")


def complete_notes(sections: DataFrame) -> DataFrame:
    """Sections with their source credit and notes as one text, the credit first."""
    return sections.withColumn("notes_text", F.nullif(F.concat_ws("\n", "source_credit", "raw_notes"), F.lit("")))

"""Sections out of title files of any size: Spark splits a file at the ends of its sections, and many tasks read it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.line_tree import LEVEL
from .uslm import GROUPS, LEVELS, _child, _name, _number, heading_of, said

END = "</section>"
#: A section of the code itself names its place; one in quotation marks doesn't.
_OWN = re.compile(r"<section\b[^>]*\bidentifier\s*=\s*[\"']/us/usc/t[^\"'/]+/s[^\"']*[\"'][^>]*>")
_ANY = re.compile(r"<section\b[^>]*>")
_PLACE = re.compile(r"/us/usc/t([0-9]+)")
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
_EVENTS = "array<struct<opens: boolean, kind: string, number: string, name: string>>"
SECTIONS = f"identifier string, status string, title_number int, section_number string, heading string, text_content string, footnotes array<string>, levels array<{LEVEL}>"
_PIECES = f"path string, block long, n int, kind string, events {_EVENTS}, raw string, {SECTIONS}"
_NAMES = [x.split()[0] for x in SECTIONS.replace(LEVEL, "").split(", ")]


def _wrapped(xml: str, close: bool) -> str:
    """A piece of a file in an element that declares its prefixes."""
    declared = "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(set(_PREFIX.findall(xml)) - {"xml", "xmlns"}))
    return f"<piece{declared}>{xml}" + ("</piece>" if close else "")


def outline(xml: str) -> list[tuple[bool, str, str, str]]:
    """(opens, kind, number, name) of the groups that begin and end in a piece that stands between two sections."""
    body = re.sub(r"<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?>|<!--.*?-->|<((?:\w+:)?meta)\b.*?</\1>", "", xml, flags=re.S)
    # What ends here began in an earlier piece, so that each end is noted and taken out, and the rest is read as far as it goes.
    out: list[tuple[bool, str, str, str]] = []
    depth: list[str] = []
    parts: list[str] = []
    for m in re.finditer(r"<(/?)([A-Za-z_][\w.:-]*)([^>]*?)(/?)>|[^<]+", body):
        if not m[2]:
            parts.append(m[0])
        elif not m[1]:
            parts.append(m[0])
            if not m[4]:
                depth.append(m[2])
        elif depth and depth[-1] == m[2]:
            depth.pop()
            parts.append(m[0])
        else:
            kind = m[2].rpartition(":")[2]
            if kind in (*GROUPS, "level"):
                out.append((False, kind, "", ""))
    parser = ElementTree.XMLPullParser(("start",))
    parser.feed(_wrapped("".join(parts), False))
    own = []
    for _, e in parser.read_events():
        kind = _name(e) if _name(e) != "level" else e.get("role") or ""
        if kind in GROUPS or _name(e) == "level":
            own.append((kind, e))
    return out + [(True, kind, _number(e), heading_of(e)) for kind, e in own]


def levels_of(section: ElementTree.Element) -> list[dict]:
    """The levels of a section in the order of its text (LEVEL): words before the first are a level without marker; closing words keep the depth of what they close, one less where they stand inside the last level's words."""
    out: list[dict] = []

    def level(depth: int, kind: str, marker: str | None, heading: str | None, content: str) -> None:
        out.append({"depth": depth, "kind": kind, "marker": marker or None, "heading": heading or None, "content": content or None})

    def words(e: ElementTree.Element) -> tuple[str, list[tuple[str, str]]]:
        """An element's own words, and the paragraphs and closing words in it, which stand by themselves."""
        apart = [c for c in e if _name(c) in ("continuation", "p")]
        rest = ElementTree.Element(e.tag, e.attrib)
        rest.text = e.text or ""
        for c in e:
            if c in apart:
                tail = c.tail or ""
                if len(rest):
                    rest[-1].tail = (rest[-1].tail or "") + tail
                else:
                    rest.text += tail
            else:
                rest.append(c)
        own = said(rest, numbers=True) if apart else said(e, numbers=True)
        return own, [(_name(c), said(c, numbers=True)) for c in apart]

    def walk(e: ElementTree.Element, depth: int, top: bool) -> None:
        own, closing = [], []
        for kind in ("chapeau", "content", "text"):
            for c in (c for c in e if _name(c) == kind):
                said_here, apart = words(c)
                own.append(said_here)
                closing += apart
        content = " ".join(x for x in own if x)
        if top:
            if content:
                level(0, "level", None, None, content)
        else:
            level(depth, "level", said(_child(e, "num")), said(_child(e, "heading"), numbers=True), content)
        for kind, x in closing:
            if x:
                level(max(0, depth - 1) if kind == "continuation" and not top else depth, "closing", None, None, x)
        for c in e:
            if _name(c) in LEVELS:
                walk(c, depth if top else depth + 1, False)
            elif _name(c) == "continuation" and (x := said(c, numbers=True)):
                level(depth, "closing", None, None, x)

    walk(section, 0, True)
    return out


def section_of(xml: str) -> tuple | None:
    """SECTIONS of one section; None if it can't be read."""
    try:
        e = ElementTree.fromstring(_wrapped(xml, True))[0]
    except (ElementTree.ParseError, IndexError):
        return None
    levels = levels_of(e)
    text = "\n".join("\t" * x["depth"] + " ".join(filter(None, (x["marker"], x["heading"], x["content"]))) for x in levels)
    foot = [" ".join("".join(x.itertext()).split()) for x in e.iter() if _name(x) == "note" and x.get("type") == "footnote"]
    identifier = e.get("identifier")
    place = _PLACE.match(identifier or "")
    return identifier, e.get("status"), int(place[1]) if place else None, _number(e), heading_of(e), text, foot, levels


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sections of the records of a split, in order: 'section' rows; 'open' ones, which the next split ends; 'rest' ones, which belong to the split before; 'end' rows for what follows the last section."""
    now: list = []  # path, block, n, events, begun raw
    last = None

    def row(path: str, block: int, n: int, kind: str, events: list, raw: str | None, section: tuple | None) -> tuple:
        return (path, block, n, kind, [dict(zip(("opens", "kind", "number", "name"), x, strict=True)) for x in events], raw, *(section or (None,) * len(_NAMES)))

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "block", "n", "kind", "events", "raw", *_NAMES]).astype({"title_number": "Int32"})

    n = 0
    for p in batches:
        rows = []
        for path, block, value in zip(p["path"], p["block"], p["value"], strict=True):
            if (path, block) != last:
                if now:
                    rows.append(row(*now[:3], "open", now[3], now[4], None))
                now, last, n = [], (path, block), 0
            n += 1
            whole = value + END
            own = _OWN.search(value)
            if own is None and not now:
                m = _ANY.search(value)
                own = m if m and "instruction" not in m[0] else None
            if own is not None:
                if now:  # a section that never ended
                    rows.append(row(*now[:3], "broken", now[3], now[4], None))
                now = [path, block, n, outline(value[: own.start()]), whole[own.start() :]]
            elif now:
                now[4] += whole
            else:
                kind = "end" if not _ANY.search(value) and "</" in value and re.search(rf"</(?:\w+:)?(?:{'|'.join(GROUPS)}|main|level)\b", value) else "rest"
                rows.append(row(path, block, n, kind, outline(value) if kind == "end" else [], whole, None))
                continue
            raw = now[4]
            if len(_ANY.findall(raw)) - raw.count(END) - len(re.findall(r"<section\b[^>]*/>", raw)) <= 0:
                section = section_of(raw)
                rows.append(row(*now[:3], "section" if section else "broken", now[3], None if section else raw, section))
                now = []
        yield table(rows)
    if now:
        yield table([row(*now[:3], "open", now[3], now[4], None)])


def _joined(lists: pd.Series) -> pd.Series:
    """Pieces of a file that splits have cut, in order, put together: (block, n, raw) of each section."""
    out = []
    for own in lists:
        units: list[list] = []
        for x in own:
            if x["kind"] == "open":
                units.append([x["block"], x["n"], x["raw"]])
            elif units:
                units[-1][2] += x["raw"]
        out.append([{"block": b, "n": n, "raw": r} for b, n, r in units])
    return pd.Series(out, dtype=object)


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What `_read` makes of the files' records. A record ends where a section does, so that a split holds whole sections but at most its last one."""
    records = spark.read.option("lineSep", END).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return records.mapInPandas(_read, _PIECES)


def sections(spark: SparkSession, paths: str | list[str], title: int | None = None, section: str | None = None) -> DataFrame:
    """The sections of title files (path, block, n and SECTIONS), with text_hash; (path, block, n) is their order.

    With a title or section only those are parsed: others are told by the identifiers in their
    records. A section that two splits share is put together from both. Sections that can't be read
    are left out (see `broken`); files may be of any size, since no task holds more than a section.
    """
    records = spark.read.option("lineSep", END).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    if title is not None or section is not None:
        here = rf"<section\b[^>]*\bidentifier\s*=\s*[\"']/us/usc/t{title if title is not None else '[^/]+'}/s{re.escape(section) if section is not None else ''}" + (r"[\"'/]" if section is not None else "")
        # Records without a section of the code may go on with one, so they stay.
        records = records.where(F.col("value").rlike(here) | ~F.col("value").rlike(r"<section\b[^>]*\bidentifier\s*=\s*[\"']/us/usc/t"))
    got = records.mapInPandas(_read, _PIECES)
    whole = got.where("kind = 'section'")
    cut = got.where("kind IN ('open', 'rest')").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "n", "kind", "raw"))).alias("_l"))
    cut = cut.select("path", F.explode(F.pandas_udf(_joined, "array<struct<block: long, n: int, raw: string>>")("_l")).alias("_u"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(path, u["block"], u["n"], *s) for path, u in zip(p["path"], p["_u"], strict=True) if (s := section_of(u["raw"]))]
            yield pd.DataFrame(rows, columns=["path", "block", "n", *_NAMES]).astype({"title_number": "Int32"})

    rest = cut.mapInPandas(parse, f"path string, block long, n int, {SECTIONS}")
    columns = ["path", "block", "n", *_NAMES]
    out = whole.select(*columns).unionByName(rest.select(*columns))
    if title is not None:
        out = out.where(F.col("title_number") == title)
    if section is not None:
        out = out.where(F.col("section_number") == section)
    return out.withColumn("text_hash", F.sha2("text_content", 256))


def broken(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, n, raw) of the sections that can't be read."""
    return pieces(spark, paths).where("kind = 'broken'").select("path", "block", "n", "raw")


def groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, n, group_key, parent_key, group_type, number, name, sort_order) of each group, before the section with (block, n) of which it begins; and of each section the group_key that it stands in.

    Only the outline of a file, a few words for each group, is put together; rows with a null
    group_type are those of sections.
    """
    outlines = pieces(spark, paths).where("kind IN ('section', 'open', 'broken', 'end')").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "n", "kind", "events"))).alias("_l"))

    def run(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            rows, stack, count = [], [], 0
            for x in own:
                for e in x["events"]:
                    if not e["opens"]:
                        if stack:
                            stack.pop()
                        continue
                    parent = stack[-1] if stack else None
                    key = f"{parent}/{e['kind']}:{e['number']}" if parent else f"{e['kind']}:{e['number']}"
                    stack.append(key if e["kind"] in GROUPS else parent)
                    if e["kind"] in GROUPS:
                        rows.append({"block": x["block"], "n": x["n"], "group_key": key, "parent_key": parent, "group_type": e["kind"], "number": e["number"], "name": e["name"], "sort_order": count})
                        count += 1
                if x["kind"] != "end":
                    rows.append({"block": x["block"], "n": x["n"], "group_key": stack[-1] if stack else None, "parent_key": None, "group_type": None, "number": None, "name": None, "sort_order": None})
            out.append(rows)
        return pd.Series(out, dtype=object)

    kind = "array<struct<block: long, n: int, group_key: string, parent_key: string, group_type: string, number: string, name: string, sort_order: int>>"
    return outlines.select("path", F.explode(F.pandas_udf(run, kind)("_l")).alias("_g")).select("path", "_g.*")

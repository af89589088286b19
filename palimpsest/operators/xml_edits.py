"""Typed edits from laws in the legislative XML schema: a reader of instructions, level by level, and side notes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import flat_mapped
from .lineage import spread

_LEVELS = frozenset("section subsection paragraph subparagraph clause subclause item subitem".split())
_HREF = re.compile(r"/us/usc/t([0-9]+)/s([^/]+)(.*)$")
_TEXT_REF = re.compile(r"(?i)\bsection\s+([0-9]+[0-9A-Za-z–-]*)((?:\s*\([0-9A-Za-z]+\))*)(?:\s+of\s+title\s+([0-9]{1,2})\b)?")
_MARKERS = re.compile(r"\s*((?:\([0-9A-Za-z]+\)\s*)+)")
_ONE = re.compile(r"\([0-9A-Za-z]+\)")
_NOTE = re.compile(r"([0-9]+)\s+U\.?\s?S\.?\s?C\.?\s+([0-9][0-9A-Za-z–-]*)\s+note")
#: Units by how deep they lie in a section.
UNITS = {"subsection": 1, "paragraph": 2, "subparagraph": 3, "clause": 4, "subclause": 5, "item": 6}
_UNIT = re.compile(rf"\b({'|'.join(UNITS)})\s*((?:\([0-9A-Za-z]+\)\s*)+)", re.I)
#: Which actions together make which pattern and change, the first that are all there; the marks that aren't part of quoted words; how sure an edit is with both texts, one, and none.
PATTERNS = (
    (("delete", "insert"), "strike_insert", "Modify"), (("substitute",), "substitute", "Modify"), (("delete",), "strike", "Delete"), (("insert",), "insert_new_text", "Add"), (("repeal",), "repeal", "Repeal"),
    (("repealAndReserve",), "repeal", "Repeal"), (("redesignate",), "redesignate", "Redesignate"), (("transfer",), "transfer", "Transfer"), (("add",), "add_section", "Add"), (("enact",), "add_section", "Add"),
)
QUOTES = "\"“”‘’`´"
CONFIDENCE = (0.90, 0.95, 0.98)
#: Patterns whose texts must be looked for, or whose place in the text must.
UNSURE = frozenset(("substitute", "insert_new_text", "add_section", "general"))
SCHEMA = (
    "change_type string, title_number int, section_number string, subsection_path string, old_text string, new_text string, qualifier string, confidence double, is_note boolean, "
    "pattern_name string, anchor_text string, target_text string, needs_review boolean, seq int"
)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _said(e: ElementTree.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def quoted(e: ElementTree.Element) -> str:
    """The words of a quotation; marks at the beginning of any piece of it, and at its end, are none of them."""
    return " ".join("".join(x.lstrip(QUOTES) for x in e.itertext()).split()).rstrip(QUOTES)


@dataclass(frozen=True)
class Place:
    """A title and section, and the markers of the units that enclose what is said, by how deep they lie."""

    title: int | None = None
    section: str | None = None
    path: tuple[tuple[int, str], ...] = ()

    def inside(self, unit: int, markers: list[str]) -> Place:
        """The place of a unit and its markers within this one: units that lie as deep or deeper end."""
        own = [(unit + k, m) for k, m in enumerate(markers)]
        return replace(self, path=(*(x for x in self.path if x[0] < unit), *own))

    def said(self) -> tuple[int | None, str | None, str | None]:
        return self.title, self.section, "".join(m for _, m in self.path) or None


def _from_ref(e: ElementTree.Element, after: str) -> Place | None:
    """The section that a link names; its path is the link's, else what its words or the words after it add in parentheses."""
    m = _HREF.match(e.get("href") or "")
    if not m:
        return None
    path = [f"({x})" for x in m[3].split("/") if x]
    if not path:
        own = _TEXT_REF.search(_said(e))
        following = _MARKERS.match(after)
        path = _ONE.findall(own[2] if own and own[2] else following[1] if following else "")
    return Place(int(m[1]), m[2]).inside(1, path)


#: What an instruction says, in order: ('words', text), ('action', type), ('quote', words), ('place', a Place).
Stream = Iterator[tuple[str, object]]


def stream(e: ElementTree.Element) -> Stream:
    """An element's own instruction, without its inner levels and what is quoted in quotations."""
    if e.text:
        yield "words", e.text
    for c in e:
        name = _name(c)
        if name == "amendingAction":
            yield "action", c.get("type") or _said(c).lower()
            yield "words", _said(c)
        elif name in ("quotedText", "quotedContent"):
            if words := quoted(c):
                yield "quote", words
        elif name == "ref" and (place := _from_ref(c, c.tail or "")):
            yield "place", place
            yield "words", _said(c)
        elif name not in _LEVELS and name not in ("num", "sidenote"):
            yield from stream(c)
        if c.tail:
            yield "words", c.tail


@dataclass
class Reader:
    """Reads one level's instruction from left to right, from the place that the levels around it have given.

    Quotations go to the action before them: what is struck is the old text, what is inserted the new
    one; one right behind `after` or `before` is neither, but where the words go.
    """

    place: Place
    old: str | None = None
    new: str | None = None
    anchor: tuple[str, str] | None = None
    actions: set[str] = field(default_factory=set)
    free: list[str] = field(default_factory=list)
    prose: str = ""
    of_note: bool = False
    _action: str = ""
    _since: int = 0  # where the prose since the last quotation begins

    def read(self, said: Stream) -> Reader:
        for kind, x in said:
            if kind == "words":
                self.prose += x
            elif kind == "action":
                self._act(x)
            elif kind == "quote":
                self._quote(x)
            elif self.place.section is None or not self.actions:
                self.place = x
        self.prose = " ".join(self.prose.split())
        if self.place.section is None and (m := _TEXT_REF.search(self.prose)):
            self.place = Place(int(m[3]) if m[3] else None, m[1]).inside(1, _ONE.findall(m[2]))
        self.of_note = bool(re.search(r"\b(?:section\s+[0-9]+[0-9A-Za-z–-]*|U\.S\.C\. [0-9]+[0-9A-Za-z–-]*)\s+note\b", self.prose))
        self._enter_units()
        return self

    def _act(self, action: str) -> None:
        if action != "amend":
            self.actions.add(action)
            self._action = action

    def _quote(self, words: str) -> None:
        behind = re.search(r"\b(after|before)\s*\Z", self.prose[self._since :].rstrip(QUOTES + " \t\r\n"), re.I)
        if behind:
            self.anchor = self.anchor or (behind[1].lower(), words)
        elif self._action in ("delete", "substitute") and self.old is None:
            self.old = words
        elif self._action in ("insert", "add", "enact", "substitute") and self.new is None:
            self.new = words
        else:
            self.free.append(words)
        self.prose += " "
        self._since = len(self.prose)

    def _enter_units(self) -> None:
        """Units that are named narrow the place, but for new ones, those that words go after or before, and what others are designated as."""
        for m in _UNIT.finditer(self.prose):
            if not re.search(r"\b(?:after|before|as|new|adding|inserting)\s+\Z", self.prose[: m.start()], re.I):
                self.place = self.place.inside(UNITS[m[1].lower()], _ONE.findall(m[2]))

    def qualifier(self) -> tuple[str | None, str | None, str | None]:
        """(kind, anchor, target) of where in its place the edit acts."""
        low = self.prose.lower()
        if "each place" in low:
            return "each_place", None, None
        if self.anchor:
            return *self.anchor, None
        if m := re.search(r"\b(after|before) subsection \(([0-9a-z]+)\)", low):
            return m[1], f"({m[2]})", None
        if self.old is None and (m := re.search(r"\bstriking (the \w+(?: at the end)?)", low)):
            return "unquoted_target", None, m[1]
        return ("at_end" if "at the end" in low else None), None, None

    def edit(self) -> tuple | None:
        """The edit that the level makes; none where nothing in it amends."""
        if self.old is None and self.new is None:
            self.old, self.new = (*self.free, None, None)[:2]
        if not self.actions and not self.new and "amend" not in self.prose.lower():
            return None
        pattern, change = next(((p, c) for needed, p, c in PATTERNS if self.actions.issuperset(needed)), ("general", "Modify"))
        if change == "Delete" and self.new and self.old:
            pattern, change = "strike_insert", "Modify"
        kind, anchor, target = self.qualifier()
        sure = CONFIDENCE[bool(self.old) + bool(self.new)]
        somewhere = self.place.section is not None
        review = not somewhere or pattern in UNSURE
        return (change, *self.place.said(), self.old, self.new, kind, sure if somewhere else sure * 0.5, self.of_note, pattern, anchor, target, review)


def edits_of(xml: str | None) -> list[tuple]:
    """The edits of one law; none from text that isn't XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    acts = {e for e in root.iter() if _name(e) == "amendingAction"}
    holds: dict[ElementTree.Element, bool] = {}

    def acting(e: ElementTree.Element) -> bool:
        if e not in holds:
            holds[e] = e in acts or any([acting(c) for c in e])
        return holds[e]

    out: list[tuple] = []

    def walk(e: ElementTree.Element, place: Place) -> None:
        said = Reader(place).read(stream(e))
        inner = [c for c in _levels(e) if acting(c)]
        if not inner or said.old or said.new:
            edit = said.edit()
            out.extend([edit] if edit else [])
        for c in inner:
            walk(c, said.place)

    for e in root.iter():
        name = _name(e)
        if name in _LEVELS and e.get("role") == "instruction":
            walk(e, Place())
        elif name == "section" and (side := next((c for c in e if _name(c) == "sidenote"), None)) is not None and (m := _NOTE.search(_said(side))):
            body = " ".join(_said(c) for c in e if _name(c) not in ("sidenote", "num"))
            out.append(("Add_Note", int(m[1]), m[2], None, None, body, None, 1.0, True, "add_note", None, None, False))
    return [(*r, k) for k, r in enumerate(out)]


def _levels(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The levels right inside an element, also inside elements that are none; not those that are quoted."""
    for c in e:
        if _name(c) in _LEVELS:
            yield c
        elif not _name(c).startswith("quoted"):
            yield from _levels(c)


def extract_xml_edits(laws: DataFrame, key: str = "law_id", xml: str = "xml") -> DataFrame:
    """Edits of every law in order (key and SCHEMA); one law's tree is held at a time."""
    kind = laws.schema[key].dataType.simpleString()
    return flat_mapped(spread(laws.select(key, F.col(xml).alias("_xml"))), lambda k, x: ((k, *r) for r in edits_of(x)), f"{key} {kind}, {SCHEMA}")

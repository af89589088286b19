"""Typed edits from the prose of laws, with spans, confidence and coverage: a grammar of instructions, and the places that sentences give them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import flat_mapped
from .intervals import covered, gaps, union
from .lineage import spread
from .prose import sentence_spans

#: Kind of change and confidence of each pattern. `insert_after`, `insert`, `add_end`, `read_as_follows` and `redesignate` stand for forms that no other name covers.
PATTERNS = {
    "strike_insert_each_place": ("Modify", 0.95), "strike_insert": ("Modify", 0.95), "strike_insert_phrase": ("Modify", 0.95), "strike_insert_everything_before": ("Modify", 0.90), "strike_insert_everything_after": ("Modify", 0.90),
    "strike": ("Delete", 0.90), "strike_through_period": ("Delete", 0.93), "strike_paragraph": ("Delete", 0.90), "strike_and_following": ("Delete", 0.85), "add_at_end": ("Add", 0.95), "add_after_paragraph": ("Add", 0.95),
    "insert_after_section": ("Add", 0.95), "insert_before": ("Add", 0.90), "insert_before_paragraph": ("Add", 0.95), "add_new_subsection": ("Add", 0.90), "insert_after": ("Add", 0.90), "insert": ("Add", 0.85), "add_end": ("Add", 0.92),
    "repeal": ("Repeal", 0.98), "paragraph_repealed": ("Repeal", 0.95), "striking_section": ("Repeal", 0.90), "redesignate_section": ("Redesignate", 0.98), "redesignate_paragraph": ("Redesignate", 0.95), "redesignate": ("Redesignate", 0.93),
    "substitute_section": ("Modify", 0.95), "substitute_subsection": ("Modify", 0.95), "read_as_follows": ("Modify", 0.92), "transfer": ("Transfer", 0.90), "section_amended_general": ("Modify", 0.85), "section_amended_by": ("Modify", 0.90),
    "subsection_amended": ("Modify", 0.85), "title_amended": ("Modify", 0.80), "add_new_section": ("Add", 0.90), "chapter_amended_add_section": ("Add", 0.90),
}
#: Frames of edits, which give way to any edit that they meet; edits that name their title themselves, which win over the edits within them,
#: whose place would be an earlier sentence's; patterns whose old text only says where the stricken text begins or ends.
_FRAMES = frozenset(("section_amended_general", "section_amended_by", "subsection_amended", "title_amended"))
_WHOLE = frozenset(("add_new_section", "chapter_amended_add_section"))
_ANCHORED = frozenset(("strike_insert_everything_before", "strike_insert_everything_after", "strike_through_period", "strike_and_following"))
UNITS = frozenset("subsection paragraph subparagraph clause subclause subdivision".split())
_HEAD = re.compile(r"\b(striking|adding|inserting|redesignating)\b|\b(?:is|are)\s+(?:hereby\s+)?(amended|repealed|transferred|stricken|to\s+read)\b|\b(amended)\s+to\s+read\s+as\s+follows", re.I)
_NOUN = re.compile(r"\b(?:sections?|title|chapter|subsection|paragraph|subparagraph|clause|subclause|subdivision)\b(?=\s+[(0-9])", re.I)
#: What makes a noun before a verb no subject of it, and what makes one the place of what follows.
_NO_SUBJECT, _IN = re.compile(r"\b(?:by|to|under|with|from|in|after|before|as|through)\s+\Z", re.I), re.compile(r"\bin\s+\Z", re.I)
_LEAD = re.compile(r"\b(?:by|(?:is|are)(?:\s+hereby)?)\s+\Z", re.I)
_NUMBER = re.compile(r"\s*([0-9]+[0-9A-Za-z–-]*)")
_MARK = re.compile(r"\s*\(([0-9A-Za-z]+)\)")
_WORD = re.compile(r"[\s,]*([A-Za-z]+)")
_BARE = re.compile(r"\s*([A-Za-z]+)")
SCHEMA = (
    "pattern_name string, change_type string, title_number int, section_number string, subsection_path string, old_text string, new_text string, "
    "confidence double, start_pos int, end_pos int, needs_review boolean, context string"
)


class Cursor:
    """Reads on from a position of a text, a word, number, marker or quotation at a time; what isn't there leaves it where it is."""

    def __init__(self, text: str, at: int, closes: dict[int, int]):
        self.text, self.at, self.closes = text, at, closes

    def _take(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m and m[1]

    def word(self, *words: str) -> str | None:
        """The next word, if it is one of these; commas before it don't count."""
        m = _WORD.match(self.text, self.at)
        if m and m[1].lower() in words:
            self.at = m.end()
            return m[1].lower()
        return None

    def phrase(self, *words: str) -> bool:
        """All these words; a / parts words of which any will do."""
        at = self.at
        if all(self.word(*w.split("/")) for w in words):
            return True
        self.at = at
        return False

    def any_word(self) -> str | None:
        return self._take(_BARE)

    def number(self) -> str | None:
        return self._take(_NUMBER)

    def mark(self) -> str | None:
        return self._take(_MARK)

    def marks(self) -> list[str]:
        """Markers one right after another."""
        out = []
        while m := self.mark():
            out.append(m)
        return out

    def sign(self, signs: str) -> bool:
        """One of the signs and more, with white space around them."""
        at = self.at
        while at < len(self.text) and (self.text[at] in signs or self.text[at].isspace()):
            at += 1
        found, self.at = any(c in signs for c in self.text[self.at : at]), at
        return found

    def quote(self) -> str | None:
        """The words of a quotation: “...” with others in it, "...", ``...\'\', or \'...\'."""
        at = self.at
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        mark = self.text[at : at + 1]
        if mark == "“":
            end, begin, size = self.closes.get(at, -1), at + 1, 1
        elif mark == '"':
            ends = [e for e in (self.text.find('"', at + 1), self.text.find("”", at + 1)) if e >= 0]
            end, begin, size = min(ends, default=-1), at + 1, 1
        elif self.text.startswith("``", at):
            end, begin, size = self.text.find("\'\'", at + 2), at + 2, 2
            while end >= 0 and self.text.startswith("\'", end + 2):
                end += 1
        elif mark == "\'":
            end, begin, size = self.text.find("\'", at + 1), at + 1, 1
        else:
            return None
        if end <= begin:
            return None
        self.at = end + size
        return self.text[begin:end]

    def listed(self, one: Callable[[], str | None]) -> list[str]:
        """A list: one, another and a third."""
        out = []
        while (x := one()) is not None:
            out.append(x)
            at = self.at
            more = self.sign(",")
            more = bool(self.word("and", "or")) or more
            if not more:
                self.at = at
                break
            back = self.at
            if one() is None:
                self.at = at
                break
            self.at = back
        return out


@dataclass(frozen=True)
class Noun:
    """What a law speaks of: a unit of a section, sections, a title, or a chapter of one."""

    kind: str
    start: int
    end: int
    sections: tuple[str, ...] = ()
    path: str = ""
    unit: str | None = None
    marks: tuple[str, ...] = ()
    title: int | None = None
    such_title: bool = False

    def place(self) -> tuple[int | None, str | None, str]:
        """(title, section, path): a subsection's marker stands for the path of its section."""
        path = self.path
        if self.marks:
            path = ("" if self.unit == "subsection" else path) + "".join(f"({m})" for m in self.marks)
        return self.title, self.sections[0] if self.sections else None, path


def numbered_on(first: str, last: str) -> list[str] | None:
    """The sections from one to another, both whole numbers; None for others."""
    if first.isdigit() and last.isdigit() and 0 < int(last) - int(first) < 10_000:
        return [str(k) for k in range(int(first), int(last) + 1)]
    return None


def noun_at(c: Cursor) -> Noun | None:
    """The noun that begins here, with all that `of` adds to it."""
    start = c.at
    word = (c.any_word() or "").lower()
    if word in UNITS:
        marks = c.marks()
        if not marks:
            return None
        end = c.at
        if c.phrase("of"):
            if c.phrase("such", "section") or c.phrase("the", "section"):
                return Noun("unit", start, c.at, unit=word, marks=tuple(marks))
            of = noun_at(c)
            if of and of.kind in ("section", "unit"):
                outer = of.path + "".join(f"({m})" for m in of.marks)
                return replace(of, kind="unit", start=start, path=outer, unit=word, marks=tuple(marks))
        return Noun("unit", start, end, unit=word, marks=tuple(marks))
    if word in ("section", "sections"):
        first = c.number()
        if first is None:
            return None
        first = first.rstrip("–-")
        path = "".join(f"({m})" for m in c.marks() if len(m) < 6)
        sections = [first]
        at = c.at
        if c.word("through") and (last := c.number()):
            sections = numbered_on(first, last) or [first, last]
        elif word == "sections":
            c.at = at
            while True:
                back = c.at
                more = c.sign(",")
                more = bool(c.word("and", "or")) or more
                nxt = c.number() if more else None
                if nxt is None:
                    c.at = back
                    break
                c.marks()
                sections.append(nxt)
        else:
            c.at = at
        while c.text.startswith(" (", c.at) and 0 <= (close := c.text.find(")", c.at)) - c.at < 60 and "(" not in c.text[c.at + 2 : close]:
            c.at = close + 1
        end, title, such = c.at, None, False
        if c.phrase("of", "such", "title"):
            end, such = c.at, True
        elif (c.phrase("of", "title") or c.phrase("title")) and (n := c.number()) and n.isdigit():
            end, title = c.at, int(n)
        return Noun("section", start, end, tuple(sections), path, title=title, such_title=such)
    if word == "title":
        n = c.number()
        if not (n and n.isdigit() and len(n) < 3):
            return None
        c.phrase("united", "states", "code")
        return Noun("title", start, c.at, title=int(n))
    if word == "chapter" and c.number() and c.phrase("of", "title"):
        n = c.number()
        if n and n.isdigit():
            c.phrase("united", "states", "code")
            return Noun("chapter", start, c.at, title=int(n))
    return None


def balanced(text: str) -> dict[int, int]:
    """Where each “ of a text is closed, others in between counted."""
    out, stack = {}, []
    for m in re.finditer("[“”]", text):
        if m[0] == "“":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _text(c: Cursor) -> str | None:
    """The quotation that `the following` speaks of, if there is one."""
    at = c.at
    if c.phrase("new") and c.any_word():
        c.number()
    c.sign(":—–-")
    said = c.quote()
    if said is None:
        c.at = at
    return said


def _inserted(c: Cursor) -> str | None:
    """`and inserting` with what is inserted, also `in lieu thereof`."""
    at = c.at
    if c.phrase("and", "inserting"):
        c.phrase("in", "lieu", "thereof")
        said = c.quote()
        if said is not None:
            return said
    c.at = at
    return None


def _unit_marks(c: Cursor) -> tuple[str, list[str]] | None:
    """A kind of unit, and the markers of one or several of them."""
    at = c.at
    word = c.word(*UNITS, *(f"{u}s" for u in UNITS))
    if word:
        first = c.marks() if not word.endswith("s") else []
        marks = first or c.listed(c.mark)
        if marks:
            return word.removesuffix("s") if word.endswith("s") else word, marks if word.endswith("s") else ["".join(f"({m})" for m in marks)[1:-1]]
    c.at = at
    return None


#: (pattern, old text, new text, unit and marker of its own, or the noun itself) of each edit that an action makes.
Found = list[tuple[str, str | None, str | None, "tuple[str, str] | Noun | None"]]


def striking(c: Cursor) -> Found:
    c.phrase("out")
    start = c.at
    quotes = c.listed(c.quote)
    if quotes:
        if c.phrase("each", "place") and (c.phrase("such", "term/phrase/word", "appears/appear") or c.phrase("it/they", "appears/appear") or c.phrase("appears/appear") or True):
            new = _inserted(c)
            return [("strike_insert_each_place", q, new, None) for q in quotes]
        new = _inserted(c)
        if new is not None:
            return [("strike_insert", q, new, None) for q in quotes]
        if c.phrase("and", "all/everything", "that", "follows"):
            if c.phrase("through") and (c.phrase("the", "period/semicolon/end") or c.quote() is not None):
                return [("strike_through_period", quotes[0], None, None)]
            return [("strike_and_following", quotes[0], None, None)]
        return [("strike", q, None, None) for q in quotes]
    c.at = start
    c.phrase("the")
    if c.word("phrase", "word", "words", "term", "terms"):
        old = c.quote()
        if old is not None:
            new = _inserted(c)
            return [("strike_insert_phrase" if new is not None else "strike", old, new, None)]
    c.at = start
    side = None
    if c.word("everything"):
        side = c.word("before", "preceding", "through", "after", "following")
    elif c.phrase("all", "that"):
        if c.word("precedes", "precede"):
            side = "before"
        elif c.word("follows", "follow"):
            side = c.word("before", "preceding", "through", "after", "following") or "after"
    if side and (old := c.quote()) is not None:
        name = "strike_insert_everything_after" if side in ("after", "following") else "strike_insert_everything_before"
        return [(name, old, _inserted(c), None)]
    c.at = start
    if units := _unit_marks(c):
        return [("strike_paragraph", None, None, (units[0], m)) for m in units[1]]
    m = _BARE.match(c.text, c.at)
    if m and m[1].lower() == "section":
        c.at = m.start(1)
        if (n := noun_at(c)) and n.kind == "section":
            return [("striking_section", None, None, n)]
    return []


def adding(c: Cursor, verb: str) -> Found:
    start = c.at
    if c.phrase("at", "the", "end"):
        c.phrase("of")
        c.phrase("thereof") or c.phrase("the", "section/subsection/paragraph")
        if c.phrase("the", "following"):
            return [("add_at_end", None, _text(c), None)]
        c.sign(":")
        new = c.quote()
        return [("add_end", None, new, None)] if new is not None else []
    side = c.word("after", "before")
    if side:
        here = c.at
        if units := _unit_marks(c):
            if c.phrase("the", "following"):
                return [("add_after_paragraph" if side == "after" else "insert_before_paragraph", None, _text(c), (units[0], units[1][-1]))]
            return []
        c.at = here
        anchor = c.quote()
        if anchor is not None:
            follows = c.phrase("the", "following")
            c.sign(":")
            new = _text(c)
            if follows and side == "before":
                return [("insert_before", None, new, None)]
            return [("insert_after", None, new, None)] if new is not None else []
        m = _BARE.match(c.text, c.at)
        if m and m[1].lower() == "section":
            c.at = m.start(1)
            n = noun_at(c)
            if n and n.kind == "section" and c.phrase("the", "following"):
                return [("insert_after_section", None, _text(c), n)]
        return []
    c.phrase("a")
    if c.phrase("new"):
        unit = c.word(*UNITS)
        if unit:
            mark = c.mark()
            c.phrase("to", "read")
            if c.phrase("as", "follows"):
                return [("add_new_subsection", None, _text(c), (unit, mark) if mark else None)]
        return []
    c.at = start
    new = c.quote() if verb == "inserting" else None
    return [("insert", None, new, None)] if new is not None else []


def redesignating(c: Cursor) -> Found:
    start = c.at
    if c.phrase("section") and (old := c.number()) and c.phrase("as", "section") and (new := c.number()):
        return [("redesignate_section", old, new, Noun("section", start, c.at, (old,)))]
    c.at = start

    def marks() -> str | None:
        """A list of markers as it is written; also from one through another."""
        while c.text[c.at : c.at + 1].isspace():
            c.at += 1
        at = c.at
        if not c.listed(c.mark):
            return None
        back = c.at
        if not (c.phrase("through") and c.mark()):
            c.at = back
        return c.text[at : c.at]

    known = c.word(*UNITS, *(f"{u}s" for u in UNITS))
    if (known or c.any_word()) and (old := marks()) and c.phrase("as") and c.any_word() and (new := marks()):
        return [("redesignate_paragraph" if known else "redesignate", old, new, None)]
    return []


def about(c: Cursor, verb: str, n: Noun | None) -> Found:
    """What a sentence says of its subject."""
    verb = " ".join(verb.split())
    kind = n.kind if n else None
    each = [replace(n, sections=(s,)) for s in n.sections] if n and n.sections else [n]
    if verb == "repealed" and kind == "section":
        return [("repeal", None, None, x) for x in each]
    if verb in ("repealed", "stricken"):
        return [("paragraph_repealed", None, None, n)] if kind == "unit" else []
    if verb == "transferred":
        if kind != "section":
            return []
        if c.phrase("to", "section"):
            c.number()
            c.marks()
        return [("transfer", None, None, x) for x in each]
    reads = verb == "to read" or c.phrase("to", "read") or c.phrase("and", "reenacted", "to", "read")
    if reads:
        if not c.phrase("as", "follows"):
            return []
        new = _text(c)
        if kind in ("section", "unit"):
            return [("substitute_section" if kind == "section" else "substitute_subsection", None, new, n)]
        return [("read_as_follows", None, new, n)] if new is not None else []
    if n is None:
        return []
    at = c.at
    if kind in ("title", "chapter") and c.phrase("by", "adding/inserting"):
        c.phrase("at", "the", "end")
        back = c.at
        if kind == "chapter" and c.phrase("the", "following"):
            return [("chapter_amended_add_section", None, _text(c), n)]
        c.at = back
        c.phrase("a")
        c.phrase("new")
        if kind == "title" and c.phrase("section") and (number := c.number()):
            return [("add_new_section", None, None, replace(n, sections=(number,)))]
        c.at = at
    if kind == "section":
        return [("section_amended_by" if c.phrase("by") else "section_amended_general", None, None, x) for x in each]
    return [("subsection_amended" if kind == "unit" else "title_amended", None, None, n)] if kind in ("unit", "title") else []


class Law:
    """The sentences, nouns and quotations of a text, each found once."""

    def __init__(self, text: str):
        self.text = text
        self.closes = balanced(text)
        self.begins = [s for _, s, _ in sentence_spans(text)] or [0]
        self.nouns: list[Noun] = []
        done = 0
        for m in _NOUN.finditer(text):
            if m.start() >= done and (n := noun_at(Cursor(text, m.start(), self.closes))):
                self.nouns.append(n)
                done = n.end
        self.starts = [n.start for n in self.nouns]

    def subject(self, verb: int) -> Noun | None:
        """The noun before a verb that it speaks of: the nearest one of its sentence, but for those that a preposition governs."""
        begin = self.begins[max(0, bisect_right(self.begins, verb) - 1)]
        for k in range(bisect_right(self.starts, verb) - 1, -1, -1):
            n = self.nouns[k]
            if n.start < begin or any(q in self.text[n.end : verb] for q in ";\"“”"):
                return None
            if n.end <= verb and not _NO_SUBJECT.search(self.text, max(0, n.start - 12), n.start):
                return n
        return None


def _edits(text: str) -> Iterator[tuple]:
    """(name, old, new, place, start, end) of every edit, wherever it stands."""
    heads = list(_HEAD.finditer(text))
    if not heads:
        return
    law = Law(text)
    place: tuple[int | None, str | None, str] = (None, None, "")
    last_title = None
    ins = [n for n in law.nouns if n.kind == "section" and _IN.search(text, max(0, n.start - 5), n.start)]
    seen = 0
    for m in heads:
        # A section that the law goes into is the place of what follows.
        while seen < len(ins) and ins[seen].end <= m.start():
            n = ins[seen]
            place = (n.title or (last_title if n.such_title else place[0]), n.sections[0], n.path)
            seen += 1
        verb = next(g for g in m.groups() if g).lower()
        c = Cursor(text, m.end(), law.closes)
        start = m.start()
        if m[1]:
            found = striking(c) if verb == "striking" else redesignating(c) if verb == "redesignating" else adding(c, verb)
            if lead := _LEAD.search(text, max(0, start - 40), start):
                start = lead.start()
        else:
            if m[3]:
                c.at = m.start(3) + len("amended")
            n = law.subject(m.start())
            if n is None and m[3]:
                start = m.start(3)
            found = about(c, verb, n)
            if n is not None:
                start = n.start
                title = n.title or (last_title if n.such_title else None)
                if n.kind == "unit" and not n.sections:
                    n = replace(n, sections=(place[1],) if place[1] else (), title=place[0], path=place[2])
                    found = [(name, old, new, n if isinstance(own, Noun) else own) for name, old, new, own in found]
                elif title != n.title:
                    found = [(name, old, new, replace(own, title=title) if isinstance(own, Noun) else own) for name, old, new, own in found]
                    n = replace(n, title=title)
                place = n.place()
                last_title = place[0] or last_title
        for name, old, new, own in found:
            at = place
            if isinstance(own, Noun):
                at = own.place()
                at = (at[0] or (place[0] if own.sections and own.kind == "section" and m[1] else None), *at[1:])
            elif own:
                at = (place[0], place[1], ("" if own[0] == "subsection" else place[2]) + f"({own[1]})")
            yield name, old, new, at, start, c.at


def _matches(text: str) -> list[tuple]:
    groups: dict[tuple[int, int, str], list[tuple]] = {}
    for name, old, new, (title, section, path), start, end in _edits(text):
        change, confidence = PATTERNS[name]
        # Without a place half the trust is gone, without a title a tenth; both texts of a replacement add a little.
        c = confidence * (1.0 if section or title else 0.5) * (1.0 if title else 0.9)
        if name.startswith("strike_insert"):
            c = min(1.0, c * 1.05) if old and new else c * (1.0 if old or new else 0.7)
        lacking = (change in ("Add", "Modify") and new is None) or (change == "Delete" and old is None) or name in _ANCHORED
        context = text[max(0, start - 100) : end + 100]
        row = (name, change, title, section, path or None, old, new, round(c, 6), start, end, section is None or c < 0.8 or lacking, context)
        groups.setdefault((start, end, name), []).append(row)
    rank = lambda r: ((r[0] not in _FRAMES) + (r[0] in _WHOLE), r[7])
    order = sorted(groups.values(), key=lambda g: (g[0][8], tuple(-y for y in rank(g[0]))))
    kept: list[list[tuple]] = []
    for g in order:
        if kept and g[0][8] < kept[-1][0][9]:
            if rank(g[0]) > rank(kept[-1][0]):
                kept[-1] = g
        else:
            kept.append(g)
    return [r for g in kept for r in g]


def extract_edits(laws: DataFrame, key: str = "law_id", text: str = "text") -> DataFrame:
    """All edits in each text; of overlapping ones the surer, then the earlier. An edit of a list has a row for each part of it, with one span."""

    kind = laws.schema[key].dataType.simpleString()
    return flat_mapped(spread(laws.select(key, F.col(text).alias("_text"))), lambda k, t: ((k, *r) for r in _matches(t or "")), f"{key} {kind}, {SCHEMA}")


def section_references(text: Column, default_title: Column) -> Column:
    """All sections that a text names, in order: title (the default one where it names none), section, subsection_path, start_pos and end_pos; a unit of a section, such as paragraph (2) of section 5(a), counts with it."""

    @F.pandas_udf("array<struct<title_number: int, section_number: string, subsection_path: string, start_pos: int, end_pos: int>>")
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        out = []
        for t, default in zip(texts, titles, strict=True):
            rows = []
            for n in Law(t or "").nouns:
                title, _, path = n.place()
                known = title if title is not None else None if pd.isna(default) else int(default)
                rows += [{"title_number": known, "section_number": s, "subsection_path": path or None, "start_pos": n.start, "end_pos": n.end} for s in n.sections]
            out.append(None if t is None else rows)
        return pd.Series(out, dtype=object)

    return run(text, default_title)


def coverage(laws: DataFrame, edits: DataFrame, key: str = "law_id", text: str = "text") -> DataFrame:
    """The share of each text that edits claim, in per cent."""
    sizes = laws.select(key, F.length(text).alias("total"))
    merged = union(edits.select(key, "start_pos", "end_pos"), [key]).join(sizes, key)
    found = covered(merged, [key], "total")
    return sizes.join(found.drop("total"), key, "left").select(key, "total", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def unclaimed(laws: DataFrame, edits: DataFrame, key: str = "law_id", text: str = "text", least: int = 10) -> DataFrame:
    """Stretches between edits of at least `least` characters without the spaces at their ends."""
    sizes = laws.select(key, F.length(text).alias("high"), F.lit(0).alias("low"), F.col(text).alias("_text"))
    merged = union(edits.select(key, "start_pos", "end_pos"), [key]).join(sizes.drop("_text"), key)
    inner = gaps(merged, [key], low="low", high="high")
    whole = sizes.join(merged.select(key).distinct(), key, "left_anti").select(key, F.col("low").alias("gap_start"), F.col("high").alias("gap_end"))
    out = inner.unionByName(whole).join(sizes.select(key, "_text"), key)
    out = out.withColumn("gap_text", F.substring("_text", F.col("gap_start") + 1, F.col("gap_end") - F.col("gap_start")))
    return out.where(F.length(F.trim(F.regexp_replace("gap_text", r"\s+", " "))) >= least).drop("_text")


def escalated(report: DataFrame, low: float = 85.0, review: float = 0.2, flagged: int = 5) -> DataFrame:
    """Whether a parse goes to the next mode: coverage too low, too many to review, or too many flagged spans."""
    share = F.coalesce(F.try_divide(F.col("needs_review"), F.col("edits")), F.lit(0.0))
    return report.withColumn("escalate", (F.col("coverage") < low) | (share > review) | (F.col("flagged") > flagged))

"""Column functions on citations of laws and on the notes under a section.

Citations and amendments are read in Arrow batches by compiled patterns, which nested array expressions would interpret anew for each row; the rest are JVM expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A public law in prose, as (Congress, number).
LAW = r"Pub\.\s*L\.\s*([0-9]+)[—–-]([0-9]+)"
_CITED = re.compile(
    rf"{LAW}(?:\s*,\s*div\.\s*([A-Z]+))?(?:\s*,\s*title\s+([IVXLCDM]+|[0-9]+))?(?:\s*,\s*§+\s*([0-9]+[0-9A-Za-z–-]*(?:\([0-9A-Za-z]+\))*))?"
    r"(?:\s*,\s*((?:\(\w+\))+(?:\s*,\s*(?:\(\w+\))+)*))?(?:\s*,\s*([A-Z][a-z]{2,3}\.?\s+[0-9]{1,2}\s*,\s+[0-9]{4}))?"
    r"(?:\s*,\s*([0-9]+[A-Z]?)\s+Stat\.\s+([0-9]+))?(?:\s*,\s*([0-9]+(?:\s*,\s*[0-9]+)*)(?!\s*Stat))?",
    re.I | re.A,
)
_OPENS, _PARENTHESIS = re.compile(r"\(\s*Pub\.\s*L\.", re.I | re.A), re.compile("[()]")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` of a value that is computed once, however often `of` refers to it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where it is missing or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def law_path(division: Column | None = None, chapter: Column | None = None, title: Column | None = None, section: Column | None = None) -> Column:
    """(level, value) of the given parts of a law, from the outermost in."""
    parts = [F.struct(F.lit(n).alias("level"), v.alias("value")) for n, v in (("division", division), ("chapter", chapter), ("title", title), ("section", section)) if v is not None]
    return F.filter(F.array(*parts), lambda x: x["value"].isNotNull() & (x["value"] != ""))


CITATION = "struct<congress: int, law_number: int, path: array<struct<level: string, value: string>>, extra_sections: array<string>, date_text: string, stat_volume: string, stat_page: int, extra_pages: array<int>, raw_text: string>"
AMENDMENT = "struct<year: int, congress: int, law_number: int, date_text: string, stat_volume: string, stat_page: int, description: string>"


def _whole(x: str | None) -> int | None:
    return int(x) if x and len(x) < 10 else None


def _parts_of(x: str | None) -> list[str]:
    """The parts of a list between commas."""
    return [y for y in (y.strip(" ") for y in (x or "").split(",")) if y]


def cited(text: str) -> dict | None:
    """The first law that a text cites (CITATION); None without one."""
    m = _CITED.search(text)
    if m is None:
        return None
    path = [{"level": n, "value": m[k]} for n, k in (("division", 3), ("title", 4), ("section", 5)) if m[k]]
    return {
        "congress": _whole(m[1]), "law_number": _whole(m[2]), "path": path, "extra_sections": _parts_of(m[6]), "date_text": m[7], "stat_volume": m[8], "stat_page": _whole(m[9]),
        "extra_pages": [_whole(x) for x in _parts_of(m[10])], "raw_text": text.strip(" "),
    }


def credit_of(text: str) -> str:
    """The first parenthesis of a text that begins with a law, others in it counted; the whole text without one."""
    closes, stack = {}, []
    for p in _PARENTHESIS.finditer(text):
        if p[0] == "(":
            stack.append(p.start())
        elif stack:
            closes[stack.pop()] = p.end()
    return next((text[m.start() : closes[m.start()]] for m in _OPENS.finditer(text) if m.start() in closes), text)


def law_citation(text: Column) -> Column:
    """The first law cited: Congress, number, path, further subsections, date, volume, page and further pages of the Statutes; null without one."""

    @F.pandas_udf(CITATION.removeprefix("struct<").removesuffix(">"))
    def run(texts: pd.Series) -> pd.DataFrame:
        names = ["congress", "law_number", "path", "extra_sections", "date_text", "stat_volume", "stat_page", "extra_pages", "raw_text"]
        return pd.DataFrame([(None if t is None else cited(t)) or {} for t in texts], columns=names).astype({"congress": "Int32", "law_number": "Int32", "stat_page": "Int32"})

    got = run(text)
    return F.when(got["congress"].isNotNull(), got)


def law_citations(text: Column) -> Column:
    """All laws cited in a section's source credit, in order; the first made the section.

    The credit is the first parenthesis that begins with a law, or the whole text without one; semicolons part its laws.
    """

    @F.pandas_udf(f"array<{CITATION}>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [c for x in re.split(r";\s*", credit_of(t)) if (c := cited(x))] for t in texts], dtype=object)

    return run(text)


def level_display(path: Column) -> Column:
    """'div. C', 'ch. 531', 'title III' or '§101' for each part of a path."""
    short = {"division": "div. ", "chapter": "ch. ", "title": "title ", "section": "§"}
    names = F.create_map(*(F.lit(x) for kv in short.items() for x in kv))
    return F.transform(path, lambda x: F.concat(names[x["level"]], x["value"]))


def record_references(text: Column) -> Column:
    """Pages of the Congressional Record, such as 'CR 2/12/2013 H439-440' or 'CR S1234'."""
    return F.regexp_extract_all(text, F.lit(r"CR\s+(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s+)?[A-Z][0-9]+(?:-[0-9]+)?"), F.lit(0))


def package_id(congress: Column, law_number: Column, private: Column | None = None) -> Column:
    kind = F.lit("publ") if private is None else F.when(private, "pvt").otherwise("publ")
    return F.concat(F.lit("PLAW-"), congress.cast("string"), kind, law_number.cast("string"))


def reference_target(kind: Column, ref: dict[str, Column], href: Column) -> Column:
    """What a reference in a note points at, as 'PL 115-264', 'Act of 1935-08-14 ch. 531', '17 USC 106' or '134 Stat. 501'; else its link."""
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.coalesce(
        F.when(kind == "public_law", said("PL ", ref["congress"], "-", ref["law_number"])), F.when(kind == "act", said("Act of ", ref["act_date"], " ch. ", ref["act_chapter"])),
        F.when(kind == "usc_section", said(ref["usc_title"], " USC ", ref["usc_section"])), F.when(kind == "statute", said(ref["stat_volume"], " Stat. ", ref["stat_page"])), href,
    )


def section_list(text: Column) -> Column:
    """The sections that 'sections 106, 107, and 108' or 'sections 106 through 110' name, each written out; empty without any."""
    ends = F.split(F.regexp_replace(F.regexp_substr(text, F.lit(r"[Ss]ections?\s+[0-9]+\s+through\s+[0-9]+")), r"^[Ss]ections?\s+", ""), r"\s+through\s+")
    span = let(
        F.struct(ends[0].cast("int").alias("low"), ends[1].cast("int").alias("high")),
        lambda x: F.when(x["low"] <= x["high"], F.transform(F.sequence(x["low"], x["high"]), lambda n: n.cast("string"))).when(x["low"] > x["high"], F.array().cast("array<string>")),
    )
    listed = F.regexp_extract(text, r"[Ss]ections?\s+([0-9]+[A-Za-z]?(?:\s*,\s*(?:(?:and|&)\s+)?[0-9]+[A-Za-z]?|\s+(?:and|&)\s+[0-9]+[A-Za-z]?)*)", 1)
    return F.coalesce(span, F.regexp_extract_all(listed, F.lit(r"[0-9]+[A-Za-z]?"), F.lit(0)))


def described_difference(old: Column, new: Column) -> Column:
    """How two texts differ but for white space: their lengths, else the first differing character with 20 on either side; null where they are equal."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def first(a: Column, b: Column) -> Column:
        # The first position where they part, by halving: the shared prefix is as long as the largest k whose prefixes are equal.
        size = F.length(a)
        steps = F.transform(F.sequence(F.length(F.bin(size)) - 1, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
        same = lambda have, step: F.substring(a, have + 1, step) == F.substring(b, have + 1, step)
        found = F.aggregate(steps, F.lit(0), lambda have, step: F.when((step <= size - have) & same(have, step), have + step).otherwise(have))

        def said(at: Column) -> Column:
            around = lambda x: F.concat(F.lit("'..."), F.substring(x, F.greatest(at - 20, F.lit(0)) + 1, F.least(at + 20, size) - F.greatest(at - 20, F.lit(0))), F.lit("...'"))
            return F.concat(F.lit("First diff at char "), at, F.lit(": DB="), around(a), F.lit(" vs RP="), around(b))

        return let(found, said)

    def described(x: Column) -> Column:
        a, b = x["a"], x["b"]
        delta = F.concat(F.lit("Length differs: DB="), F.length(a), F.lit(", RP="), F.length(b), F.lit(" (delta="), F.length(b) - F.length(a), F.lit(")"))
        return F.when(F.length(a) != F.length(b), delta).when(a != b, first(a, b))

    return let(F.struct(plain(old).alias("a"), plain(new).alias("b")), described)


# Notes under a section

#: Markers of note headings, cross-headings, italic headings, quoted content and signatures in raw notes.
MARKS = ("NH", "H1", "H2", "SIG")


def without_marks(text: Column) -> Column:
    """Raw notes without headings, with the text of inner marks kept and paragraphs parted by empty lines."""
    steps = [(rf"(?s)\[{m}\].*?\[/{m}\]", "") for m in ("NH", "H1")] + [(r"\[/(?:NH|H1)\]", "")] + [(rf"(?s)\[{m}\](.*?)\[/{m}\]", "$1") for m in ("H2", "SIG")]
    steps += [(r"(?s)\[QC:[0-9]+\](.*?)\[/QC\]", "$1"), (r"\[PARA\]", "\n\n")]
    return F.regexp_replace(F.regexp_replace(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text), r"^\s+", ""), r"\s+$", "")


def wrapper_position(text: Column, heading: str) -> Column:
    """Where a wrapper heading begins, from 1, if nothing but marked headings stands before it; 0 without one."""
    found = F.regexp_extract(text, rf"(?is)^((?:\s|\[NH\].*?\[/NH\]|\[H1\].*?\[/H1\]|\[/?(?:NH|H1)\])*+){heading}", 1)
    return F.when(F.regexp_like(text, F.lit(rf"(?is)^(?:\s|\[NH\].*?\[/NH\]|\[H1\].*?\[/H1\]|\[/?(?:NH|H1)\])*+{heading}")), F.length(found) + 1).otherwise(0)


_SPACES = (re.compile(r'"\s*([^"]*?)\s*"', re.A), re.compile(r"“\s*([^”]*?)\s*”", re.A))
_YEARS, _YEAR = re.compile(r"(?=[0-9]{4}\s*[—–-]\s*)", re.A), re.compile(r"([0-9]{4})\s*[—–-]\s*", re.A)
_LAW, _LAW_FIRST = re.compile(LAW, re.A), re.compile(rf"(?:Subsecs?\.\s+.*?)?{LAW}", re.A | re.S)
_ACT, _ACT_YEAR = re.compile(r"\bAct\b", re.A), re.compile(r"\bAct\s+\w+\.?\s+[0-9]{1,2},?\s+([0-9]{4})", re.A)
_WHITE = " \t\n\x0b\f\r"


def _said(text: str) -> str:
    """White space as one space, none inside quotation marks."""
    plain = " ".join(re.split(f"[{_WHITE}]+", text)).strip(" ")
    return _SPACES[1].sub(r"“\1”", _SPACES[0].sub(r'"\1"', plain))


def amended(text: str) -> list[dict]:
    """The amendments (AMENDMENT) that a note lists by year."""

    def entry(year: int, law: dict | None, body: str) -> dict:
        own = {k: law[k] if law else None for k in ("congress", "law_number", "date_text", "stat_volume", "stat_page")}
        return {"year": year, **own, "description": _said(body)}

    out = []
    for block in _YEARS.split(text):
        head = _YEAR.match(block)
        if head is None:
            continue
        year, body = int(head[1]), block[head.end() :].rstrip(_WHITE).strip(" ")
        paragraphs = [p for p in (p.strip(_WHITE) for p in re.split(r"\n\n+", body)) if _LAW_FIRST.match(p)]
        if paragraphs:
            out += [entry(year, cited(p[_LAW.search(p).start() :]), p) for p in paragraphs]
        elif _LAW.search(body):
            out.append(entry(year, cited(body), body))
        elif _ACT.search(body):
            out.append(entry(year, None, body))
    if not out:
        old = re.sub(rf"\A[{_WHITE}]*[—–-][{_WHITE}]*", "", text).strip(" ")
        if m := _ACT_YEAR.search(old):
            out.append(entry(int(m[1]), None, old))
    return out


def amendments(text: Column) -> Column:
    """The amendments that a note lists by year: year, law (Congress, number, date, volume, page; nulls for old acts) and what it did.

    A year's paragraphs that begin with a public law, after a subsection or none, are an amendment each.
    A year without one counts once, for its first law or for an act. A text without years is an act of
    the year in its date.
    """
    return F.pandas_udf(lambda texts: pd.Series([None if t is None else amended(t) for t in texts], dtype=object), f"array<{AMENDMENT}>")(text)


def first_of(amended: Column) -> Column:
    """(year, 'PL c-n') of the first of the amendments that names a law; null without one."""
    named = F.filter(amended, lambda a: a["congress"].isNotNull())
    said = F.transform(named, lambda a: F.struct(a["year"].alias("year"), F.concat(F.lit("PL "), a["congress"].cast("string"), F.lit("-"), a["law_number"].cast("string")).alias("law")))
    return F.get(said, F.lit(0))


def first_amendment(text: Column) -> Column:
    """(year, 'PL c-n') of the first amendment in a note that names a law; null without one."""
    return first_of(amendments(text))


def _of_heading(notes: Column, begins: str) -> Column:
    """The texts of the notes (array of struct<header, content>) whose heading begins so."""
    own = F.filter(notes, lambda n: F.startswith(F.lower(n["header"]), F.lit(begins.lower())) & (n["content"] != ""))
    return F.transform(own, lambda n: n["content"])


def short_titles(notes: Column) -> Column:
    """(title, year, public_law) that each note under a heading of short titles gives.

    An act goes by the first quoted words that call it an act or a law, else by the words that it is
    cited or known as, else by how its note begins. The year is the one in the name, the law the
    first that the note cites.
    """
    names_act = lambda x: x.rlike(r"\b(?:Act|Law)\b")

    def entry(content: Column) -> Column:
        quoted = F.get(F.filter(F.regexp_extract_all(content, F.lit("[“\"]([^“”\"]+)[”\"]"), F.lit(1)), names_act), F.lit(0))
        called = F.get(F.split(content, r"(?i)\b(?:cited|known) as(?: the)? "), F.lit(1))
        called = F.trim(F.regexp_replace(F.get(F.split(called, "[.;,]"), F.lit(0)), "^['‘“\"]+|['’”\"]+$", ""))
        name = F.coalesce(quoted, F.when(names_act(called), called), F.substring(content, 1, 100))
        return let(name, lambda n: F.struct(n.alias("title"), _part(n, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).cast("int").alias("year"), _part(content, rf"({LAW})", 1).alias("public_law")))

    return F.transform(_of_heading(notes, "Short Title"), entry)


def references_in_text(notes: Column, least: int = 20, most: int = 500) -> Column:
    """What the notes on references explain, a sentence each: those of more than `least` characters, up to the `most`-th."""
    sentences = F.flatten(F.transform(_of_heading(notes, "References in Text"), lambda c: F.split(c, r"(?<=\.)\s+(?=\p{Lu})")))
    return F.transform(F.filter(sentences, lambda x: F.length(x) > least), lambda x: F.substring(x, 1, most))

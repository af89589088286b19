"""Notes under a section: apart from its text, by category and heading, with typed lines; JVM expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import amendments, first_of, law_citations, short_titles, without_marks

#: Headings that open a category, headings that belong to one where no category is opened, and headings at which notes begin.
WRAPPERS = {"historical and revision notes": "historical", "editorial notes": "editorial", "statutory notes and related subsidiaries": "statutory", "executive documents": "statutory"}
HISTORICAL = ("derivation", "historical and revision notes")
EDITORIAL = ("amendments", "change of name", "references in text", "codification", "prior provisions", "construction", "recodification", "effective date of repeal")
NOTE_STARTS = (
    "Editorial Notes", "Statutory Notes", "Historical and Revision", "Amendments", "References in Text", "Codification", "Prior Provisions", "Effective Date", "Short Title", "Change of Name", "Transfer of Functions", "Derivation", "Executive Documents",
)
_REPORT = r"(?i)(?:House|Senate)\s+Report\s+No\.\s*[0-9–-]+"
#: A note's text is noise if it has no more characters than this.
SHORTEST = 30


def separated(text: Column) -> Column:
    """(law, notes): the text up to the first line that begins with a note's heading, or to the source credit after a full sentence, and the rest."""
    heads = F.regexp_instr(text, F.lit(rf"(?im)^[ \t]*(?:{'|'.join(NOTE_STARTS)})"))
    credit = F.regexp_instr(text, F.lit(r"(?i)\(\s*(?:Pub\.\s*L\.|Added Pub\.|June|July|Aug\.|Sept\.|Oct\.|Nov\.|Dec\.|Jan\.|Feb\.|Mar\.|Apr\.|May)\s*[0-9]"))
    before = F.rtrim(F.substring(text, F.lit(1), credit - 1))
    credit = F.when((credit > 1) & before.rlike(r"[.;]\s*$|\([a-zA-Z0-9]+\)\s*$"), credit)
    at = F.least(F.when(heads > 0, heads), credit)
    clean = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.struct(clean(F.coalesce(F.substring(text, F.lit(1), at - 1), text)).alias("law"), F.nullif(clean(F.substring(text, at, F.length(text))), F.lit("")).alias("notes"))


def flat_category(header: Column) -> Column:
    """The category of a heading where none is opened."""
    low = F.lower(header)
    historical = low.isin(*HISTORICAL) | header.rlike(_REPORT)
    return F.when(historical, "historical").when(low.isin(*EDITORIAL) | header.rlike("(?i)^Effective Date of\\b"), "editorial").otherwise("statutory")


def note_blocks(raw: Column) -> Column:
    """(category, header, content) of each note in raw notes, in order.

    Blocks begin at marked headings. A wrapper heading opens its category for what follows; before
    the first, headings are told by their words. Of equal headings in a category the first counts;
    noise, wrappers and headings of one word among statutory notes go, headings without text stay.
    """
    blocks = F.filter(F.split(raw, r"(?=\[(?:NH|H1)\])"), lambda b: F.trim(b) != "")
    head = lambda b: F.trim(F.regexp_extract(b, r"(?s)^\[(?:NH|H1)\](.*?)\[/(?:NH|H1)\]", 1))
    plain = lambda b: F.regexp_extract(b, rf"(?i)^\s*({'|'.join(WRAPPERS)})", 1)
    opened = F.create_map(*(F.lit(x) for kv in WRAPPERS.items() for x in kv))
    body = lambda b: F.regexp_replace(b, r"(?s)^\[(?:NH|H1)\].*?\[/(?:NH|H1)\]", "")
    kind = "struct<open: string, notes: array<struct<category: string, header: string, raw: string>>>"
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<category: string, header: string, raw: string>>").alias("notes"))

    read = F.transform(blocks, lambda b: F.struct(F.when(head(b) != "", head(b)).otherwise(plain(b)).alias("header"), body(b).alias("raw")))
    read = F.transform(read, lambda b: F.struct(b["header"].alias("header"), opened[F.lower(b["header"])].alias("wraps"), flat_category(b["header"]).alias("flat"), b["raw"].alias("raw"), (F.size(F.split(b["header"], r"\s+")) > 1).alias("long")))

    def step(state: Column, b: Column) -> Column:
        category = F.coalesce(state["open"], b["flat"])
        known = F.exists(state["notes"], lambda n: (n["header"] == b["header"]) & (n["category"] == category))
        keep = (b["header"] != "") & b["wraps"].isNull() & ~known & ((category != "statutory") | state["open"].isNull() | b["long"])
        note = F.struct(category.alias("category"), b["header"].alias("header"), b["raw"].alias("raw"))
        return F.struct(F.coalesce(b["wraps"], state["open"]).alias("open"), F.when(keep, F.concat(state["notes"], F.array(note))).otherwise(state["notes"]).alias("notes")).cast(kind)

    found = F.aggregate(read, start.cast(kind), step)["notes"]
    said = F.transform(found, lambda n: F.struct(n["category"].alias("category"), n["header"].alias("header"), without_marks(n["raw"]).alias("content"), n["raw"].alias("raw")))
    return F.filter(said, lambda n: (n["content"] == "") | (F.length(n["content"]) > SHORTEST))


def typed_lines(raw: Column) -> Column:
    """(kind, indent, text) of a note's lines: header for [H2], quoted with its level for [QC:n], signature for [SIG], text for the rest; paragraphs part lines."""
    parts = F.filter(F.split(raw, r"\[PARA\]|\n+|(?=\[(?:H2|QC:[0-9]+|SIG)\])|(?<=\[/(?:H2|QC|SIG)\])"), lambda x: F.trim(x) != "")
    quoted = lambda x: F.regexp_extract(x, r"^\s*\[QC:([0-9]+)\]", 1)
    kind = lambda x: F.when(x.rlike(r"^\s*\[H2\]"), "header").when(quoted(x) != "", "quoted").when(x.rlike(r"^\s*\[SIG\]"), "signature").otherwise("text")
    lines = F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), F.coalesce(quoted(x).try_cast("int"), F.lit(0)).alias("indent"), F.trim(F.regexp_replace(F.regexp_replace(x, r"\[/?(?:NH|H1|H2|SIG|QC(?::[0-9]+)?)\]", ""), r"\s+", " ")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def notes_document(rows: DataFrame, key: list[str], raw: str = "raw_notes") -> DataFrame:
    """A section's notes as one row: notes, categories (sorted), citations, amendments, short titles, and where it went.

    transferred_to holds the section that a note at the start names, or 'another location'; omitted
    and has_amendments are flags, the latter from the notes, the number of citations and the text.
    """
    text = F.col(raw)
    notes = note_blocks(text)
    of = lambda h: F.get(F.filter("notes", lambda n: n["header"] == h), F.lit(0))["content"]
    begin = F.substring(text, 1, 100)
    moved = r"(?i)reclassified as section ([0-9]+[a-z]?) of Title ([0-9]+)"
    target = F.when(F.regexp_like(text, F.lit(moved)), F.concat(F.regexp_extract(text, moved, 2), F.lit(" U.S.C. § "), F.regexp_extract(text, moved, 1))).otherwise("another location")
    # Exploded arrays of one element are read once, however often what follows refers to them.
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    out = once(rows.select(*key, raw), "notes", notes)
    out = once(out, "citations", law_citations(text))
    none = F.array().cast(rows.sparkSession.range(1).select(amendments(F.lit("")).alias("x")).schema["x"].dataType)
    out = once(out, "amendments", F.coalesce(amendments(of("Amendments")), none))
    statutory = F.filter("notes", lambda n: n["category"] == "statutory")
    return out.select(
        *key, "notes", "citations", "amendments", first_of(F.col("amendments")).alias("first_amendment"), short_titles(statutory).alias("short_titles"), F.array_sort(F.array_distinct(F.transform("notes", lambda n: n["category"]))).alias("categories"),
        F.when(begin.rlike(r"(?i)\bTransferred\b"), target).alias("transferred_to"), F.coalesce(begin.rlike(r"(?i)\bOmitted\b"), F.lit(False)).alias("omitted"),
        ((F.size("amendments") > 0) | (F.size("citations") > 1) | F.coalesce(text.rlike(r"\[NH\]Amendments\[/NH\]"), F.lit(False))).alias("has_amendments"),
    )


def by_category(document: DataFrame, key: list[str]) -> DataFrame:
    """A row for each note: its place, category, heading and text."""
    return document.select(*key, F.posexplode("notes").alias("position", "n")).select(*key, "position", "n.category", "n.header", "n.content")


def reference_roles(document: DataFrame, key: list[str]) -> DataFrame:
    """Citations with their role: the first made the section, the others amended it."""
    rows = document.select(*key, F.posexplode("citations").alias("position", "c"))
    return rows.select(*key, "position", "c.congress", "c.law_number", F.when(F.col("position") == 0, "Enactment").otherwise("Amendment").alias("role"))

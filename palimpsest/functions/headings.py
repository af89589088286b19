"""Column functions on headings, committees, offices and dates of laws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "if", "in", "nor", "of", "on", "or", "so", "the", "to", "up", "with", "yet")
#: Days on which titles were enacted as positive law.
POSITIVE_LAW = {
    1: "1947-07-30", 3: "1948-06-25", 4: "1947-07-30", 5: "1966-09-06", 9: "1947-07-30", 10: "1956-08-10", 11: "1978-11-06", 13: "1954-08-31", 14: "1949-08-04",
    17: "1947-07-30", 18: "1948-06-25", 23: "1958-07-07", 28: "1948-06-25", 31: "1982-09-13", 32: "1956-08-10", 35: "1952-07-19", 36: "1998-08-12", 37: "1962-09-07",
    38: "1958-09-02", 39: "1970-08-12", 40: "2002-08-21", 41: "2011-01-04", 44: "1968-06-19", 46: "2006-10-06", 49: "1983-07-05", 51: "2010-10-11", 54: "2014-12-19",
}
PASSAGE = ("passed", "agreed to", "adopted", "concurred in")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def _capital(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "-")


def title_cased(text: Column) -> Column:
    """A heading of which four fifths of the letters are capitals, in title case; small words stay small but for the first and last. Others stay."""
    letters = _letters(text)
    mostly = (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= 0.8 * F.length(letters))
    words = _words(text)
    case = lambda w, i: F.when((i > 0) & (i < F.size(words) - 1) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(_capital(w))
    return F.when(mostly, F.array_join(F.transform(words, case), " ")).otherwise(text)


def without_brackets(text: Column) -> Column:
    """No opening bracket at the start and no closing one at the end, as they are left when a bracket spans two elements."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[", ""), r"\]$", ""))


def cleaned_heading(text: Column) -> Column:
    """No soft hyphens, final stops or dashes after a stop; one in capitals has words begin with one, but for Roman numerals."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, "­", ""), r"\s*\.—\s*$", ""), r"\.+\s*$", "")
    letters = _letters(plain)
    roman = lambda w: (F.length(w) >= 2) & F.upper(w).rlike(r"^(?=[IVXLCDM])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})[.,;:]?$")
    titled = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), _capital), "")
    cased = F.array_join(F.transform(_words(plain), lambda w: F.when(roman(w), F.upper(w)).otherwise(titled(w))), " ")
    return F.when((letters != "") & (F.upper(letters) == letters), cased).otherwise(F.array_join(_words(plain), " "))


def split_header(text: Column) -> Column:
    """(header, content) of 'Definitions—The term ...': up to six words before the first dash that end in no stop; no header otherwise."""
    head = F.trim(F.regexp_extract(text, r"(?s)^([^—]*)—", 1))
    ok = text.contains("—") & F.size(_words(head)).between(1, 6) & ~head.rlike(r"[.,;]$")
    rest = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^—]*—(.*)$", 1), r"^\s+|\s+$", "")
    return F.struct(F.when(ok, head).alias("header"), F.when(ok, rest).otherwise(text).alias("content"))


def list_markers(text: Column) -> Column:
    """Markers such as (a) that begin a list item: those that no word of reference ('section', 'paragraph', 'under', ...) or marker stands right before."""
    before = r"(?i)(?<!(?:section|sections|subsection|subsections|paragraph|paragraphs|subparagraph|subparagraphs|clause|clauses|subclause|subclauses|under|and|or|through|to)\s{1,3})(?<![\w)])"
    return F.regexp_extract_all(text, F.lit(before + r"\(([0-9]{1,3}|[A-Za-z]{1,5})\)"), F.lit(1))


def relative_indents(levels: Column) -> Column:
    """Indents of a section's lines, of which the smallest above zero becomes 1."""
    low = F.array_min(F.filter(levels, lambda x: x > 0))
    return F.transform(levels, lambda x: F.when(x > 0, x - (low - 1)).otherwise(x))


def indented(content: Column, level: Column, width: int | None = None) -> Column:
    """A line as displayed: behind a tab for each level, or `width` spaces."""
    return F.concat(F.repeat(F.lit("\t" if width is None else " " * width), F.greatest(level, F.lit(0))), content)


def name_uuid(name: Column, namespace: str) -> Column:
    """The UUID (version 5) of a name in a namespace, given as its UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    high = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda i, n: F.substring(digest, i, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), high, part(18, 3), F.lit("-"), part(21, 12))


# Committees and offices


def committee_name(name: Column) -> Column:
    """Lower case, without 'Committee on (the)' or 'Select Committee on' at the start and without stops at the end."""
    low = F.lower(F.trim(name))
    return F.regexp_replace(F.trim(F.regexp_replace(low, r"^(?:committee on the |committee on |select committee on )", "")), r"\.+$", "")


def committee_code(name: Column, codes: dict[str, str]) -> Column:
    """The code of a committee by its short name, else by its whole one; null for an unknown one."""
    by_name = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(by_name[committee_name(name)], by_name[F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")])


def aliases(titles: Column) -> Column:
    """The names in 'X or the Y'."""
    return F.filter(F.transform(F.split(titles, " or the "), lambda x: F.trim(x)), lambda x: x != "")


def president_title(name: Column) -> Column:
    return F.when(name == "Unknown", name).otherwise(F.concat(F.lit("President "), F.substring_index(name, " ", -1)))


# Bills' actions


def is_passage(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(low.rlike("|".join(PASSAGE)), F.lit(False))


def action_event(kind: Column, text: Column, chamber: Column) -> Column:
    """introduced, committee_referral, house_vote, senate_vote, presidential_action or other, by an action's type, words and chamber."""
    kind, low, passed = F.lower(F.coalesce(kind, F.lit(""))), F.lower(text), is_passage(text)
    return (
        F.when(kind == "president", "presidential_action").when((kind == "introreferral") & low.contains("introduced"), "introduced")
        .when((kind == "committee") | ((kind == "introreferral") & low.contains("referred")), "committee_referral")
        .when((kind == "floor") & (chamber == "House") & passed, "house_vote").when((kind == "floor") & (chamber == "Senate") & passed, "senate_vote").otherwise("other")
    )


def event_title(event: Column, text: Column, chamber: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(event == "introduced", F.concat(F.lit("Bill introduced"), F.coalesce(F.concat(F.lit(" in the "), chamber), F.lit("")))).when(event == "committee_referral", "Referred to committee")
        .when(event == "house_vote", "Passed the House").when(event == "senate_vote", "Passed the Senate")
        .when((event == "presidential_action") & low.contains("veto"), "Vetoed by the President").when((event == "presidential_action") & low.rlike("signed|became"), "Signed into law")
        .when(event == "presidential_action", "Presidential action").otherwise(F.coalesce(F.nullif(F.substring(text, 1, 80), F.lit("")), F.lit("Legislative action")))
    )


# Dates


def positive_law_date(title: Column, parsed: Column | None = None) -> Column:
    """The day a title became positive law: as parsed, else as known; null for the others."""
    known = F.create_map(*(F.lit(x) for kv in POSITIVE_LAW.items() for x in kv))[title.cast("int")].cast("date")
    return known if parsed is None else F.coalesce(parsed, known)


def vote_date(text: Column) -> Column:
    """The day of an ISO date or time; 1970-01-01 for any other text."""
    return F.coalesce(F.substring(text, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))


def year_date(year: Column, month: int = 1, day: int = 1) -> Column:
    return F.when(year.between(1, 9999), F.make_date(year, F.lit(month), F.lit(day)))


def served(terms: Column) -> Column:
    """(first, last) day of the terms (start_year, end_year): January 1 of the first year, December 31 of the last; null while one has no end."""
    start, end = F.array_min(F.transform(terms, lambda t: t["start_year"])), F.array_max(F.transform(terms, lambda t: t["end_year"]))
    return F.struct(year_date(start).alias("first_served"), year_date(end, 12, 31).alias("last_served"))

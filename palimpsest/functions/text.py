"""Column functions on text: normal forms, citations, markers, names and votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lower-case hex; null for null."""
    return F.sha2(text, 256)


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, length: int = 50) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def en_dashed(section: Column) -> Column:
    return F.translate(section, "-", "–")


def plain_dashed(section: Column) -> Column:
    """Section numbers with every dash written as a hyphen, lower case, without spaces."""
    return F.lower(F.regexp_replace(F.translate(section, "‐‑‒–—", "-----"), r"\s+", ""))


def spaced_title(name: Column) -> Column:
    """camelCase as words in title case."""
    return F.initcap(F.trim(F.regexp_replace(name, "([A-Z])", " $1")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", "")


def markers(text: Column) -> Column:
    """All list markers such as (a), (12) or (iv), without parentheses, in order."""
    return F.regexp_extract_all(text, F.lit(r"\(([0-9]{1,3}|[A-Za-z]{1,5})\)"), F.lit(1))


def is_roman(text: Column) -> Column:
    return F.upper(text).rlike(r"^(?=[IVXLC])(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def indent_level(marker: Column) -> Column:
    """(a) 1, (1) 2, (A) 3, (ii) 4, (II) 5, others 0; a single i or I counts as a letter."""
    roman = is_roman(marker) & (F.length(marker) > 1)
    return (
        F.when(roman & marker.rlike("^[a-z]+$"), 4).when(roman & marker.rlike("^[A-Z]+$"), 5).when(marker.rlike("^[0-9]+$"), 2)
        .when(marker.rlike("^[a-z]{1,2}$"), 1).when(marker.rlike("^[A-Z]{1,2}$"), 3).otherwise(0)
    )


def vote_tally(text: Column) -> Column:
    """(yeas, nays) of the first two numbers joined by a dash; nulls if there are none."""
    pattern = "([0-9]+)\\s*[-–]\\s*([0-9]+)"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    return F.struct(part(1).alias("yeas"), part(2).alias("nays"))


def public_laws(text: Column) -> Column:
    """Public laws cited, such as 115-97, in order, each once; numbers are read to their last digit."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)Pub(?:lic|\\.)\\s*L(?:aw|\\.)\\s*(?:No\\.\\s*)?([0-9]+[-–][0-9]+)"), F.lit(1)))


def citation(text: Column) -> Column:
    """(title, section) of '17 USC 106', '17 U.S.C. § 106', '17/106' or 'Title 17 Section 106'."""
    usc = "(?i)^\\s*(?:title\\s+)?([0-9]{1,2})\\s*(?:u\\.?\\s*s\\.?\\s*c\\.?|/|,)?\\s*(?:§+|sec(?:tion|\\.)?)?\\s*([0-9]+[0-9A-Za-z\\-–]*)\\s*$"
    section = F.regexp_extract(text, usc, 2)
    return F.struct(F.regexp_extract(text, usc, 1).try_cast("int").alias("title_number"), F.when(section != "", section).alias("section_number"))


def usc_reference(path: Column) -> Column:
    """'/us/usc/t26/s219/c/1' as (26, '219', '(c)(1)')."""
    rest = F.filter(F.split(F.regexp_extract(path, "/s[^/]+/(.*)$", 1), "/"), lambda x: x != "")
    section = F.regexp_extract(path, "/s([^/]+)", 1)
    return F.struct(
        F.regexp_extract(path, "/t([0-9]+)", 1).try_cast("int").alias("title_number"), F.when(section != "", section).alias("section_number"),
        F.array_join(F.transform(rest, lambda x: F.concat(F.lit("("), x, F.lit(")"))), "").alias("subsection_path"),
    )


def release_point(identifier: Column) -> Column:
    """'119-72not60u1' as Congress, law, the laws left out and the update number."""
    parts = F.split(identifier, "-", 2)
    rest = F.element_at(parts, 2)
    left_out = F.transform(F.regexp_extract_all(rest, F.lit("not([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(
        parts[0].try_cast("int").alias("congress"), F.regexp_extract(rest, "^([0-9]+)", 1).try_cast("int").alias("law_number"), left_out.alias("not_laws"),
        F.coalesce(F.regexp_extract(rest, "u([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("update_number"),
    )


def party(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("republican"), "Republican").when(low.contains("democrat"), "Democrat").when(low.contains("independent"), "Independent").otherwise("Other")


def chamber(text: Column) -> Column:
    return F.when(F.lower(text).contains("senate"), "Senate").when(F.lower(text).contains("house"), "House")


def vote_position(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("yea", "aye", "yes"), "Yea").when(low.isin("nay", "no"), "Nay").when(low == "present", "Present").otherwise("Not_Voting")


def full_name(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    name = F.concat_ws(" ", *(F.when(F.trim(x) != "", F.trim(x)) for x in (first, middle, last, suffix)))
    return F.when(F.upper(name) == name, F.initcap(name)).otherwise(name)


def first_replaced(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of `old` replaced: as it stands, else by flexible white space, else in any case.

    A struct of the new text (null if not found) and the way found.
    """
    words = F.filter(F.split(F.trim(old), r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    loose = F.array_join(quoted, "\\s+")

    def swap(pattern: Column) -> Column:
        hit = F.regexp_substr(text, pattern)
        at = F.instr(text, hit)
        return F.when(hit.isNotNull() & (hit != ""), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(hit), F.length(text))))

    at = F.instr(text, old)
    exact = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))
    flexible, any_case = swap(loose), swap(F.concat(F.lit("(?i)"), loose))
    ok = F.length(F.trim(old)) > 0
    return F.struct(
        F.when(ok, F.coalesce(exact, flexible, any_case)).alias("text"),
        F.when(ok & exact.isNotNull(), "exact").when(ok & flexible.isNotNull(), "white_space").when(ok & any_case.isNotNull(), "any_case").alias("way"),
    )


#: Words that speak for an edit in unclaimed text.
EDIT_WORDS = (
    "amended", "striking", "inserting", "adding", "repealed", "redesignating", "transferred", "strike", "insert", "redesignated",
    "deleting", "substituting", "replaced", "inserted", "struck", "added", "amending", "repeal",
)


def edit_words(text: Column) -> Column:
    """The edit words of a text in alphabetical order, each once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(EDIT_WORDS)})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))

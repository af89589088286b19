"""Prose of laws: text that follows an instruction, sentences with offsets, ordinals, struck subsections, lines of old texts, escalation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations of legal prose whose stop ends no sentence.
ABBREVIATIONS = (
    "Pub", "L", "Stat", "Sec", "Sess", "Cong", "Art", "Ch", "Cl", "Div", "No", "Nos", "Par", "Pars", "Pt", "Subch", "Subpar", "Subpars", "Subsec", "Subsecs", "Tit", "Vol", "U", "S", "C", "F", "R", "D", "Fed", "Reg", "Rep", "Res", "Ex", "Ord", "Proc",
    "Rev", "Gen", "Col", "Gov", "Sen", "Dept", "Amdt", "Para", "Eff", "sec", "no", "pub", "stat", "rev", "reg", "fed", "corp", "inc", "ltd", "co", "et", "dept", "div", "ch", "art", "amdt", "cl", "para", "par", "pars", "subsec", "subsecs", "subch", "pt", "proc", "eff",
    "Jan", "Feb", "Mar", "Apr", "Aug", "Sept", "Oct", "Nov", "Dec", "Mr", "Mrs", "Ms", "Dr", "Jr", "Sr", "St", "Inc", "Corp", "Co", "Ltd", "etc", "seq", "al", "v", "vs", "e", "g", "i",
)
#: Ordinals of sentences, from the first on.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
MODES = {"RegEx": "LLM", "LLM": "Human_Plus_LLM", "Human_Plus_LLM": "Human_Plus_LLM"}


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


#: How sure each way of reading what follows an instruction is.
FOLLOWING = {"quoted": 0.9, "quoted_heuristic": 0.7, "colon_to_section": 0.6, "paragraph": 0.5}
#: How far after an instruction its colon and its quotation mark may stand.
COLON_WITHIN, QUOTE_WITHIN = 200, 500
_MARK = re.compile("[\"“”]|``|''")
_STOP_AND_MARK = re.compile("[.]\\s*[\"”]")


def closing(text: str, at: int) -> int | None:
    """Where the quotation that opens at `at` closes, quotations in it counted; None where it doesn't.

    “ and `` open, ” and \'\' close; a straight mark closes what a straight mark opened, and opens
    where another kind is open. The text is read once, with a stack of what is open.
    """
    stack: list[str] = []
    for m in _MARK.finditer(text, at):
        mark = m[0]
        if mark in ("“", "``"):
            stack.append(mark)
        elif mark == '"':
            if stack and stack[-1] == mark:
                stack.pop()
            else:
                stack.append(mark)
        elif stack and stack[-1] == {"”": "“", "\'\'": "``"}[mark]:
            stack.pop()
        elif mark == "”" and stack and stack[-1] == '"':  # a straight mark that a curly one closes
            stack.pop()
        if not stack:
            return m.start()
    return None


def quotation(text: str, at: int) -> tuple[str, str] | None:
    """(words, method) of the quotation that opens at `at`; where none closes it, up to the first stop before a mark."""
    begin = at + (2 if text.startswith("``", at) else 1)
    end = closing(text, at)
    if end is not None:
        return text[begin:end].strip(), "quoted"
    stop = _STOP_AND_MARK.search(text, begin)
    return (text[begin : stop.start() + 1].strip(), "quoted_heuristic") if stop else None


def _opens_section(line: str) -> bool:
    """Whether a line begins with a section's number, as in SEC. 3, or with a subsection's letter."""
    head = line.split(maxsplit=1)
    if len(head) < 2:
        return False
    return bool(head[0] == "SEC." and head[1][0].isdigit() or len(head[0]) == 3 and head[0][0] + head[0][2] == "()" and head[0][1].islower())


def _before(lines: list[str], ends: Callable[[str], bool]) -> str | None:
    """The lines before the first one (but the first) at which it ends; None if there is none."""
    k = next((k for k, line in enumerate(lines) if k and ends(line)), None)
    return None if k is None else "\n".join(lines[:k]).strip()


def introduced(text: str, end: int) -> tuple[str, float, str] | None:
    """(text, confidence, method) of what an instruction that ends at `end` introduces."""
    found = None
    colon = text.find(":", end, end + COLON_WITHIN)
    if colon >= 0:
        rest = colon + 1 + len(text[colon + 1 :]) - len(text[colon + 1 :].lstrip())
        if _MARK.match(text, rest) and text[rest] not in "”\'":
            found = quotation(text, rest)
        else:
            said = _before(text[rest:].split("\n"), _opens_section)
            found = (said, "colon_to_section") if said else None
    if found is None and (m := re.compile("[\"“]|``").search(text, end, end + QUOTE_WITHIN)):
        found = quotation(text, m.start())
    if found is None:
        said = _before(text[end:].lstrip(": \t\n\r").split("\n"), lambda line: not line.strip() or line.startswith("SEC.") and _opens_section(line))
        found = (said, "paragraph") if said and len(said) > 10 else None
    return found and (found[0], FOLLOWING[found[1]], found[1])


def following_text(text: Column, end: Column) -> Column:
    """(text, confidence, method) of what an instruction that ends at `end` introduces; null without any.

    After a colon within COLON_WITHIN characters: the quotation there, else what stands up to the
    next section or subsection. Else the next quotation that begins within QUOTE_WITHIN characters,
    else the paragraph, if it has more than 10 characters.
    """

    @F.pandas_udf("text string, confidence double, method string")
    def run(texts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        got = [None if t is None or pd.isna(e) else introduced(t, int(e)) for t, e in zip(texts, ends, strict=True)]
        return pd.DataFrame([g or (None, None, None) for g in got], columns=["text", "confidence", "method"])

    got = run(text, end)
    return F.when(got["method"].isNotNull(), got)


_STOP, _EMPTY = re.compile(r"\.(?=\s+[A-Z\"“(])|\n\s*\n"), re.compile(r"\n\s*\n")
_SHORT = re.compile(rf"\b(?:{'|'.join(ABBREVIATIONS)})\Z")


def sentence_spans(text: str, begin: int = 0) -> list[tuple[str, int, int]]:
    """(words, start, end) of each sentence. A stop before white space and a capital, a quotation or a parenthesis ends one, and so does an empty line; not the stop of an abbreviation, one before a numbered parenthesis, or one after a parenthesis that an abbreviation follows."""
    out, start = [], 0

    def add(end: int) -> None:
        words = text[start:end].strip()
        if words:
            lead = start + len(text[start:end]) - len(text[start:end].lstrip())
            out.append((words, begin + lead, begin + lead + len(words)))

    for m in _STOP.finditer(text):
        if m[0] == ".":
            after = text[m.end() : m.end() + 40].lstrip()
            word = re.match(r"[A-Za-z]+(?=\.)", after)
            if _SHORT.search(text, max(start, m.start() - 12), m.start()) or re.match(r"\([0-9]", after) or text[m.start() - 1 : m.start()] == ")" and word and _SHORT.search(word[0]):
                continue
            add(m.end())
        else:
            add(m.start())
        start = m.end()
    add(len(text))
    return out


def sentences(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """The sentences of texts (see `sentence_spans`) with their place, paragraph (how many empty lines stand before it, none counted at the start) and offsets, end excluded."""

    @F.pandas_udf("array<struct<position: int, paragraph: int, sentence: string, start_char: int, end_char: int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            breaks = [] if t is None else [m.start() for m in _EMPTY.finditer(t)]
            spans = [] if t is None else sentence_spans(t)
            out.append([{"position": k, "paragraph": bisect_right(breaks, s), "sentence": words, "start_char": s, "end_char": e} for k, (words, s, e) in enumerate(spans)])
        return pd.Series(out, dtype=object)

    return rows.select(*key, F.explode(run(F.col(text))).alias("_s")).select(*key, "_s.*")


def _instruction(text: str) -> list[str]:
    """The words and markers of an instruction, lower-cased but for markers."""
    return [w if w[0] == "(" else w.lower() for w in re.findall(r"\([0-9A-Za-z]+\)|[A-Za-z]+", text)]


def _run(words: list[str], at: int, of: Callable[[str], bool]) -> tuple[list[str], int]:
    """The words from `at` on that are of a kind, with `and` between them, and where they end."""
    out = []
    while at < len(words) and (of(words[at]) or out and words[at] == "and"):
        out += [words[at]] * (words[at] != "and")
        at += 1
    return out, at


def _is_marker(word: str) -> bool:
    return word[0] == "("


def designated(text: str) -> list[tuple[int, str]] | None:
    """(sentence, marker) that an instruction pairs: so many ordinals of sentences, so many subsections."""
    words = _instruction(text)
    for k in (k for k, w in enumerate(words[:-1]) if w == "designating" and words[k + 1] == "the"):
        ordinals, at = _run(words, k + 2, ORDINALS.__contains__)
        link = words[at : at + 3]
        if ordinals and len(link) == 3 and link[0] in ("sentence", "sentences") and link[1] == "as" and link[2] in ("subsection", "subsections"):
            marks, _ = _run(words, at + 3, _is_marker)
            return list(zip(map(ORDINALS.index, ordinals), marks, strict=True)) if len(marks) == len(ordinals) else None
    return None


def struck(text: str) -> list[str] | None:
    """The subsections that an instruction strikes, without parentheses."""
    words = _instruction(text)
    for k, w in enumerate(words[:-1]):
        if w == "striking" and words[k + 1] in ("subsection", "subsections"):
            marks, _ = _run(words, k + 2, _is_marker)
            if marks:
                return [m[1:-1] for m in marks]
    return None


def ordinal_markers(text: Column) -> Column:
    """(sentence, marker) of 'designating the first and second sentences as subsections (a) and (b)'; null where they don't pair up."""

    @F.pandas_udf("array<struct<sentence: int, marker: string>>")
    def run(texts: pd.Series) -> pd.Series:
        got = texts.map(lambda t: None if t is None else designated(t))
        return got.map(lambda x: None if x is None else [{"sentence": s, "marker": m} for s, m in x])

    return run(text)


def struck_subsections(text: Column) -> Column:
    """The markers of 'striking subsections (a), (b) and (c)', without parentheses; null without any."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else struck(t)), "array<string>")(text)


def _plain(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def start_lines(edits: DataFrame, lines: DataFrame, key: list[str], edit: str, old: str = "old_text") -> DataFrame:
    """Edits with start_line, the line of their section where their old text begins; null where it stands nowhere.

    White space and case don't count. The first line counts that holds the text or is held by it; else
    the one where it begins in the lines put together. Only sections with edits are put together.
    """
    own = lines.join(edits.select(*key).distinct(), key, "left_semi")
    whole = own.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_number", F.col("content").alias("c")))).alias("_lines"))
    rows = edits.join(whole, key, "left").withColumn("_old", F.when(_plain(F.col(old)) != "", _plain(F.col(old))))
    hit = F.filter("_lines", lambda x: (_plain(x["c"]) != "") & (_plain(x["c"]).contains(F.col("_old")) | F.col("_old").contains(_plain(x["c"]))))
    texts = F.transform("_lines", lambda x: _plain(x["c"]))
    at = F.instr(F.array_join(texts, " "), F.col("_old"))
    ends = F.transform(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.length(F.array_join(F.slice(texts, F.lit(1), i), " ")))
    index = F.size(F.filter(ends, lambda e: e < at))
    spanning = F.when(at > 0, F.get(F.col("_lines"), index)["line_number"])
    return rows.withColumn("start_line", F.when(F.col("_old").isNotNull() & (F.size("_lines") > 0), F.coalesce(F.get(hit, F.lit(0))["line_number"], spanning))).drop("_lines", "_old")


def escalation(report: DataFrame, mode: str = "mode", low: float = 85.0, review: float = 0.2, flagged: int = 5) -> DataFrame:
    """Whether a parse goes on to the next mode, why, and to which: coverage too low, too many to review, or too many flagged spans."""
    share = F.coalesce(F.try_divide(F.col("needs_review"), F.col("edits")), F.lit(0.0))
    why = F.array_compact(F.array(
        F.when(F.col("coverage") < low, F.concat(F.lit("Coverage "), F.format_number("coverage", 1), F.lit(f"% below threshold ({low:g}%)"))),
        F.when(share > review, F.concat(F.lit("Review ratio "), F.format_number(share * 100, 0), F.lit(f"% exceeds threshold ({review:.0%})"))),
        F.when(F.col("flagged") > flagged, F.concat(F.col("flagged").cast("string"), F.lit(f" flagged unclaimed spans (threshold: {flagged})"))),
    ))
    higher = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))
    rows = report.withColumn("_why", why)
    return rows.withColumns({"escalate": F.size("_why") > 0, "reason": F.nullif(F.array_join("_why", "; "), F.lit("")), "next_mode": F.when(F.size("_why") > 0, F.coalesce(higher[F.col(mode)], F.lit("Human_Plus_LLM")))}).drop("_why")


def resolved(refs: DataFrame, default_title: Column) -> DataFrame:
    """References with the natural key of their section: the title, else the default one, and the section with en dashes; error where either is missing."""
    title, section = F.coalesce("title_number", default_title), F.translate("section_number", "-", "–")
    error = F.when(F.col("section_number").isNull(), "no section").when(title.isNull(), "no title")
    return refs.withColumns({"title_number": title, "section_number": section, "error": error})

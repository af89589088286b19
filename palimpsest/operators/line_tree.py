"""Sections as trees of lines: lines out of prose and out of structured levels, their parents, and the ranges that hold their descendants."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import spread
from .prose import sentence_spans

LINE = "struct<line_number: int, content: string, indent_level: int, marker: string, is_header: boolean, start_char: int, end_char: int, parent: int, last: int, depth: int, path: string>"
FIELDS = tuple(re.findall(r"(\w+):", LINE))
#: A level of a structured section, in the order of the text: depth from 0; kind 'level', or 'closing' for words that follow the levels inside.
LEVEL = "struct<depth: int, kind: string, marker: string, heading: string, content: string>"
#: Words before a marker that make it a reference.
REFERRING = frozenset(f"{w}{s}" for w in ("subsection", "paragraph", "subparagraph", "clause", "subclause") for s in ("", "s"))
_ITEM = re.compile(r"(?:^|(?<=[\s.;:—]))\((?:[0-9]{1,3}|[A-Za-z]{1,5})\)(?:\s*\((?:[0-9]{1,3}|[A-Za-z]{1,5})\))*")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[\s.;:,—–-]*\Z")
_NAMES = re.compile(r"\(([0-9A-Za-z]+)\)")
_NUMERAL = re.compile(r"(?=.)M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\Z")
_ROMAN = re.compile(r"(?=.)(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\Z")


def rank(name: str) -> int:
    """(a) 1, (1) 2, (A) 3, (ii) 4, (II) 5; a single i or I is a letter, other names are like letters."""
    if name.isdigit():
        return 2
    if len(name) > 1 and _ROMAN.match(name.lower()) and (name.islower() or name.isupper()):
        return 4 if name.islower() else 5
    return 3 if name.isupper() else 1


def nested(indents: Sequence[int], markers: Sequence[str | None]) -> list[tuple[int, int, int, str]]:
    """(parent, last, depth, path) of each line, by a stack of the lines that are open.

    parent is the place of the nearest line before that is indented less, -1 without one; last the
    place of the last line below it, itself if there is none, so that lines from a line to its last
    are its subtree, and lines whose range holds a line are its way to the root. path joins the
    markers on that way; a marker such as (b)(1) stands for as many of them as it has parts.
    """
    out: list[list] = []
    stack: list[int] = []
    for k, (indent, marker) in enumerate(zip(indents, markers, strict=True)):
        while stack and indents[stack[-1]] >= indent:
            out[stack.pop()][1] = k - 1
        parent = stack[-1] if stack else -1
        above = _NAMES.findall(out[parent][3]) if stack else []
        own = _NAMES.findall(marker or "")
        path = [*above[: len(above) - len(own) + 1], *own] if len(own) > 1 else [*above, *own]
        out.append([parent, k, len(stack), "".join(f"({x})" for x in path)])
        stack.append(k)
    for k in stack:
        out[k][1] = len(indents) - 1
    return [tuple(x) for x in out]


def in_tree(lines: list[tuple]) -> list[tuple]:
    """Lines with what `nested` says of them, by line number; empty lines are in no tree."""
    said = [x for x in lines if x[1]]
    tree = nested([x[2] for x in said], [x[3] for x in said])
    number = [x[0] for x in said]
    own = {n: (number[p] if p >= 0 else None, number[last], d, path or None) for n, (p, last, d, path) in zip(number, tree, strict=True)}
    return [(*x, *own.get(x[0], (None, None, None, None))) for x in lines]


def items(text: str) -> Iterator[tuple[str | None, int, int, int]]:
    """(marker, start, start of the words, end) of each list item, and of the words before the first with no marker."""
    starts = []
    for m in _ITEM.finditer(text):
        word = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())
        if not (word and word[1].lower() in REFERRING):
            starts.append(m)
    if not starts or starts[0].start():
        yield None, 0, 0, starts[0].start() if starts else len(text)
    for k, m in enumerate(starts, 1):
        yield "".join(m[0].split()), m.start(), m.end(), starts[k].start() if k < len(starts) else len(text)


def header_of(words: str) -> tuple[str, str] | None:
    """(header, rest) of 'Definitions—The term ...': up to six words before the first dash that end in no stop."""
    head, dash, rest = words.partition("—")
    head = head.strip()
    return (head, rest.strip()) if dash and 1 <= len(head.split()) <= 6 and head[-1] not in ".,;" and rest.strip() else None


def clean_heading(text: str) -> str:
    """A heading without soft hyphens and final stops and dashes; of one in capitals each word begins with one, Roman numerals stay."""
    plain = re.sub(r"\.?\s*—?\s*\Z", "", text.replace("\xad", "")) if re.search(r"\.\s*—\s*\Z", text) else text.replace("\xad", "")
    words = re.sub(r"\.+\s*\Z", "", plain).split()
    if not plain.isupper():
        return " ".join(words)
    numeral = lambda w: len(w) > 1 and _NUMERAL.match(w.rstrip(".,;:"))
    return " ".join(w if numeral(w) else re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), w) for w in words)


def prose_lines(text: str) -> list[tuple]:
    """Lines of a section without structure: list items begin lines, and so do sentences.

    An item is indented by the kind of its last marker; its header, if it has one, is a line of its
    own, and the words after it, like all sentences but the first, are indented once more. Words
    before the first item aren't indented. The smallest indent above zero becomes 1.
    """
    rows: list[list] = []
    for marker, start, begin, end in items(text):
        level = rank(_NAMES.findall(marker)[-1]) if marker else 0
        words = text[begin:end]
        body = words.strip()
        head = header_of(body) if marker else None
        if head:
            at = begin + len(words) - len(words.lstrip())
            rows.append([f"{marker} {head[0]}", level, marker, True, start, at + len(head[0])])
            rows.append([head[1], level + 1, None, False, begin + words.index("—") + 1, begin + len(words.rstrip())])
            continue
        said = sentence_spans(words, begin)
        for k, (sentence, a, b) in enumerate(said):
            first = marker and not k
            rows.append([f"{marker} {sentence}" if first else sentence, level + (1 if marker and k else 0), marker if first else None, False, start if first else a, b])
        if marker and not said:
            rows.append([marker, level, marker, False, start, begin])
    low = min((r[1] for r in rows if r[1]), default=1)
    return [(k, r[0], r[1] - (low - 1 if r[1] else 0), *r[2:]) for k, r in enumerate(rows, 1)]


def structured_lines(levels: Sequence) -> list[tuple]:
    """Lines of the levels (LEVEL) of a structured section.

    A heading is a line, its words lie one deeper, and levels inside it one deeper than those. A level
    without heading has its marker before its first sentence; the others lie one deeper, if it has a
    marker. Closing words stand like their level. An empty line goes before a heading that follows
    words, unless it lies deeper than they do. Offsets count the lines' contents with a line end each.
    """
    rows: list[tuple] = []
    at = 0
    base = [0]  # by depth: the indent of levels there

    def add(content: str, indent: int, marker: str | None = None, header: bool = False) -> None:
        nonlocal at
        rows.append((len(rows) + 1, content, indent, marker, header, at, at + len(content) + 1))
        at += len(content) + 1

    for x in levels:
        depth, kind, marker, heading, content = (x[c] for c in ("depth", "kind", "marker", "heading", "content"))
        del base[depth + 1 :]
        base += [base[-1] + 1] * (depth + 1 - len(base))
        indent = base[depth]
        heading = clean_heading(heading or "")
        said = [s for s, _, _ in sentence_spans(content or "")]
        if kind == "closing":
            for s in said:
                add(s, indent)
            continue
        if heading:
            before = next((r for r in reversed(rows) if r[1]), None)
            if before and not before[4] and indent <= before[2]:
                add("", 0)
            add(f"{marker or ''} {heading}".strip(), indent, marker, True)
            for s in said:
                add(s, indent + 1)
            base.append(indent + (2 if said else 1))
            continue
        for k, s in enumerate(said or ([""] if marker else [])):
            first = marker and not k
            add(f"{marker} {s}".strip() if first else s, indent + (1 if marker and k else 0), marker if first else None)
        base.append(indent + 1)
    return rows


def _array(of, *columns: Column) -> Column:
    """A column of lines that `of` makes of the values of a row; null where the first of them is."""

    @F.pandas_udf(f"array<{LINE}>")
    def run(*series: pd.Series) -> pd.Series:
        rows = (None if x[0] is None else [dict(zip(FIELDS, line, strict=True)) for line in in_tree(of(*x))] for x in zip(*series, strict=True))
        return pd.Series(list(rows), dtype=object)

    return run(*columns)


def section_lines(sections: DataFrame, key: list[str], text: str = "text_content", levels: str | None = None) -> DataFrame:
    """The lines of sections with their place in the tree: key and FIELDS.

    levels: a column array<LEVEL>; sections that have none, and all if it isn't given, are read as
    prose. Null texts have no lines. Every section is read in one pass by itself.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if levels is None:
        lines = _array(prose_lines, body)
    else:
        given = F.coalesce(F.col(levels), F.array().cast(f"array<{LEVEL}>"))
        lines = _array(lambda x, t: structured_lines(x) or prose_lines(t), given, body)
    return spread(sections.select(*key, *{text, *([levels] if levels else [])})).select(*key, F.explode(lines).alias("_l")).select(*key, "_l.*")


def with_tree(lines: DataFrame, key: list[str], number: str = "line_number", indent: str = "indent_level", marker: str | None = None) -> DataFrame:
    """Lines as rows, with parent, last, depth and path; line numbers are unique in their section, whose lines are put together once."""
    mark = F.col(marker) if marker else F.lit(None).cast("string")
    own = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(number).cast("int").alias("n"), F.col(indent).cast("int").alias("i"), mark.alias("m")))).alias("_l"))

    @F.pandas_udf("array<struct<n: int, parent: int, last: int, depth: int, path: string>>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            numbers = [x["n"] for x in own]
            tree = nested([x["i"] or 0 for x in own], [x["m"] for x in own])
            out.append([{"n": n, "parent": numbers[p] if p >= 0 else None, "last": numbers[last], "depth": d, "path": path or None} for n, (p, last, d, path) in zip(numbers, tree, strict=True)])
        return pd.Series(out, dtype=object)

    tree = spread(own).select(*key, F.explode(run("_l")).alias("_t")).select(*key, F.col("_t.n").alias(number), "_t.parent", "_t.last", "_t.depth", "_t.path")
    return lines.join(tree, [*key, number])


def subtrees(tree: DataFrame, roots: DataFrame, key: list[str], number: str = "line_number") -> DataFrame:
    """The lines of the subtree of each root (key, `number`), itself first: a range of line numbers, at any depth; root names it."""
    at = tree.join(roots.select(*key, number), [*key, number], "left_semi").select(*key, F.col(number).alias("root"), F.col("last").alias("_last"))
    return tree.join(at, key).where(F.col(number).between(F.col("root"), F.col("_last"))).drop("_last")


def paths(tree: DataFrame, of: DataFrame, key: list[str], number: str = "line_number") -> DataFrame:
    """The lines on the way from each line (key, `number`) to its root, itself included: those whose ranges hold it; below names it."""
    at = of.select(*key, F.col(number).alias("below"))
    return tree.join(at, key).where(F.col("below").between(F.col(number), F.col("last")))


def tree_stats(tree: DataFrame, key: list[str], kind: Column) -> DataFrame:
    """For each section: lines, max_depth, and how many lines there are of each kind and at each depth, as maps; no line's children are counted twice."""
    by = lambda c: F.map_from_entries(F.sort_array(F.collect_list(c)))
    own = tree.select(*key, kind.alias("_kind"), "depth")
    counts = own.groupBy(*key, "_kind", "depth").agg(F.count(F.lit(1)).alias("_n"))
    kinds = counts.groupBy(*key, "_kind").agg(F.sum("_n").alias("_n")).groupBy(*key).agg(by(F.struct("_kind", "_n")).alias("by_kind"))
    depths = counts.groupBy(*key, "depth").agg(F.sum("_n").alias("_n")).groupBy(*key).agg(F.sum("_n").alias("lines"), F.max("depth").alias("max_depth"), by(F.struct("depth", "_n")).alias("by_depth"))
    return depths.join(kinds, key)

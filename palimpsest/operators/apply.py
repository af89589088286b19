"""Application of edits to sections, in order, and the revisions that come out of it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import flat_mapped
from .lineage import spread
from .snapshots import KEY


def find_and_replace(text: str, old: str, new: str) -> str | None:
    """The text with the first `old` replaced: as it stands, else by flexible white space, else in any case; None if absent."""
    if not old.strip():
        return None
    if old in text:
        return text.replace(old, new, 1)
    loose = r"\s+".join(map(re.escape, old.split()))
    for flags in (0, re.I):
        if m := re.search(loose, text, flags):
            return text[: m.start()] + new + text[m.end() :]
    return None


def apply_one(text: str | None, kind: str, old: str | None, new: str | None) -> tuple[str, str | None]:
    """(APPLIED, SKIPPED or FAILED, the text afterwards)."""
    if kind in ("Redesignate", "Transfer", "Add_Note"):
        return "SKIPPED", text
    if kind == "Repeal":
        return "APPLIED", None
    if kind == "Add":
        if not new:
            return "FAILED", text
        return "APPLIED", new if not text else f"{text}\n{new}"
    if kind in ("Modify", "Delete"):
        if text is None:
            return "FAILED", text
        if old is None:
            return ("APPLIED", new) if kind == "Modify" and new else ("FAILED", text)
        after = find_and_replace(text, old, (new or "") if kind == "Modify" else "")
        return ("FAILED", text) if after is None else ("APPLIED", after)
    return "FAILED", text


def apply_changes(states: DataFrame, changes: DataFrame, key: list[str] | None = None, text: str = "text_content", order: list[str] | None = None) -> DataFrame:
    """Folds each section's changes in order over its text; a repeal ends the fold.

    Only sections with changes are grouped, and a group holds what is enacted for one section. Sections unknown in `states` start without text.
    Returns key, text_content, text_hash, is_deleted, applied, skipped and failed.
    """
    key = key or KEY
    steps = F.sort_array(F.collect_list(F.struct(*(order or ["change_id"]), "change_type", "old_text", "new_text")))
    rows = changes.groupBy(*key).agg(steps.alias("_steps"))
    parts = [F.col(f"_steps.{c}").alias(f"_{c}") for c in ("change_type", "old_text", "new_text")]
    rows = rows.join(states.select(*key, F.col(text).alias("_before")), key, "left").select(*key, "_before", *parts)
    out = ", ".join(f"{k} {changes.schema[k].dataType.simpleString()}" for k in key)

    def fold(*row: object) -> Iterator[tuple]:
        *own, now, kinds, olds, news = row
        count = {"APPLIED": 0, "SKIPPED": 0, "FAILED": 0}
        gone = False
        for kind, old, new in zip(kinds, olds, news, strict=True):
            status, now = apply_one(now, kind, old, new)
            count[status] += 1
            if kind == "Repeal":
                gone = True
                break
        yield (*own, now, gone, *count.values())

    done = flat_mapped(spread(rows), fold, f"{out}, text_content string, is_deleted boolean, applied long, skipped long, failed long")
    return done.withColumn("text_hash", F.sha2("text_content", 256))


def play_forward(states: DataFrame, changes: DataFrame, laws: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Applies all laws' changes in the order of their dates, Congresses and numbers, as one fold for each section.

    Since a section's text depends on its own changes alone, laws needn't be played one by one.
    """
    placed = laws.select("law_id", F.coalesce("enacted_date", F.lit("0001-01-01").cast("date")).cast("string").alias("_date"), F.col("congress").alias("_congress"), F.coalesce(F.col("law_number").try_cast("int"), F.lit(0)).alias("_number"))
    return apply_changes(states, changes.join(placed, "law_id"), key, order=["_date", "_congress", "_number", "law_id", "change_id"])


HUNKS = "hunk int, old_start int, old_lines int, new_start int, new_lines int, kind string, line string"


#: Cells of a table of bits that is kept to trace a common subsequence back; larger ones are halved.
CELLS = 1 << 24


def _rows(a: Sequence[str], b: Sequence[str]) -> Iterator[int]:
    """For each beginning of b, a number whose bit i is 0 where one more line of a is common up to line i than before it.

    All lines of a are dealt with at once, as the bits of one number.
    """
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & whole
        yield row


def _lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The longest common subsequences of all beginnings of a with the whole of b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """(i, j) of the lines of a longest common subsequence, in order; where a table of bits would be large, b is halved and a cut where the halves have most in common."""
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(k, k) for k in range(begin)]
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    if x and y:
        if len(y) == 1 or len(x) * len(y) <= CELLS:
            rows = [(1 << len(x)) - 1, *_rows(x, y)]
            i, j, back = len(x) - 1, len(y), []
            while i >= 0 and j > 0:
                if rows[j] >> i & 1:  # one line less of a has as much in common
                    i -= 1
                elif not rows[j - 1] >> i & 1:  # and so has one line less of b
                    j -= 1
                else:
                    back.append((begin + i, begin + j - 1))
                    i, j = i - 1, j - 1
            out += reversed(back)
        else:
            middle = len(y) // 2
            at = int(np.argmax(_lengths(x, y[:middle]) + _lengths(x[::-1], y[middle:][::-1])[::-1]))
            out += [(begin + i, begin + j) for i, j in common_lines(x[:at], y[:middle])]
            out += [(begin + at + i, begin + middle + j) for i, j in common_lines(x[at:], y[middle:])]
    return out + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def hunks_of(old: str | None, new: str | None, context: int = 3) -> list[tuple]:
    """The lines of a unified diff with as few changed lines as may be, by hunk: kind is ' ', '-' or '+'."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    lines: list[tuple[str, str, int, int]] = []  # kind, line, and how many lines of either text come before it
    i = j = 0
    for p, q in [*common_lines(a, b), (len(a), len(b))]:
        lines += [("-", a[k], k, j) for k in range(i, p)] + [("+", b[k], p, k) for k in range(j, q)]
        lines += [(" ", a[p], p, q)] if p < len(a) else []
        i, j = p + 1, q + 1
    changed = [k for k, x in enumerate(lines) if x[0] != " "]
    spans: list[list[int]] = []
    for k in changed:
        if spans and k - spans[-1][1] <= 2 * context:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    out = []
    for n, (first, last) in enumerate(spans):
        own = lines[max(0, first - context) : last + context + 1]
        head = (n, own[0][2] + 1, sum(x[0] != "+" for x in own), own[0][3] + 1, sum(x[0] != "-" for x in own))
        out += [(*head, kind, line) for kind, line, _, _ in own]
    return out


def line_hunks(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """Unified-diff lines of each row's two texts; rows with equal texts give none and are left out before Python."""
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key)

    def run(*row: object) -> Iterator[tuple]:
        *own, a, b = row
        return ((*own, *h) for h in hunks_of(a, b))

    differing = pairs.where(~F.col(old).eqNullSafe(F.col(new)))
    return flat_mapped(spread(differing.select(*key, F.col(old).alias("_a"), F.col(new).alias("_b"))), run, f"{kinds}, {HUNKS}")


def line_counts(hunks: DataFrame, key: list[str]) -> DataFrame:
    return hunks.groupBy(*key).agg(F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"))


def lines_of(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Non-empty lines with number, marker, indent level, header flag and offsets, by JVM functions alone."""
    from ..functions.text import indent_level

    parts = rows.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    w = Window.partitionBy(*key).orderBy("pos")
    begin = F.sum(F.length("raw") + 1).over(w) - F.length("raw") - 1
    parts = parts.withColumn("start_char", begin.cast("int")).withColumn("end_char", (begin + F.length("raw")).cast("int")).where(F.trim("raw") != "")
    marker = F.regexp_extract("raw", r"^\s*\(([0-9]{1,3}|[A-Za-z]{1,5})\)", 1)
    content = F.trim("raw")
    return parts.select(
        *key, F.row_number().over(w).alias("line_number"), content.alias("content"), F.when(marker != "", indent_level(marker)).otherwise(0).alias("indent_level"),
        F.when(marker != "", marker).alias("marker"), ((F.upper(content) == content) & (F.length(content) < 80) & content.rlike("[A-Z]")).alias("is_header"), "start_char", "end_char",
    )

"""Edits at anchors in a section's lines: after a subsection, in place of some, under other markers; lines keep their identity."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .apply import find_and_replace
from .batches import flat_mapped
from .lineage import parts
from .prose import designated, struck
from .provisions import before_in_sequence

#: Lines, or changes of sections, of a part that one task sorts and groups.
EACH = 100_000
#: Digits of line keys, in their order as text.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE = len(DIGITS)
_MARKER = re.compile(r"\([0-9A-Za-z]+\)(?:\([A-Z0-9]+\))?")
LINES = "line_key string, line_number int, marker string, content string, indent_level int, created_by long, changed_by long"
#: What a change says besides its section: kind of change, texts, the anchor ('after' or 'before' a marker), the pairs of markers that it redesignates, and its instruction.
CHANGE = ("change_id", "change_type", "old_text", "new_text", "position", "anchor", "old_markers", "new_markers", "instruction")


def between(low: str, high: str | None) -> str:
    """A key after `low` and before `high` (None: the end of all keys), as short as may be; keys don't end in the smallest digit.

    Keys compare as text. Between any two there is another, so that lines come between others, and
    no line that stays gets another key, however often a section is changed.
    """
    out, k = "", 0
    while True:
        a = DIGITS.index(low[k]) if k < len(low) else 0
        b = DIGITS.index(high[k]) if high is not None and k < len(high) else _BASE
        if b - a > 1:
            return out + DIGITS[(a + b) // 2]
        out += DIGITS[a]
        if b > a:  # below `high` from here on, whatever follows
            high = None
        k += 1


def new_keys(low: str, high: str | None, n: int, by: int) -> list[str]:
    """n rising keys after `low` and before `high` that hold the change's number, so that none is ever given to another change's line, even where the line that had it is gone."""
    if not n:
        return []
    tag, x = "1", by
    while x:
        x, d = divmod(x, _BASE)
        tag = DIGITS[d] + tag
    # What between() gives is no beginning of `high`, so that more digits after it change nothing in its order.
    middle = between(low, high) + tag
    return [*new_keys(low, middle, (n - 1) // 2, by), middle, *new_keys(middle, high, n // 2, by)]


def first_keys(n: int) -> list[str]:
    """n rising keys of one length, with room between them."""
    width = 1
    while _BASE**width < 2 * (n + 1):
        width += 1
    step = _BASE**width // (n + 1)

    def digits(x: int) -> str:
        out = ""
        for _ in range(width):
            x, d = divmod(x, _BASE)
            out = DIGITS[d] + out
        return out

    return [digits(step * k).rstrip("0") for k in range(1, n + 1)]


@lru_cache(1024)
def _first_keys(n: int) -> list[str]:
    return first_keys(n)


def plain_marker(marker: str | None) -> str:
    return (marker or "").strip("()")


def alike(marker: str, other: str) -> bool:
    """Markers of one kind: numbers, small letters or capitals."""
    kind = lambda m: "1" if m.isdigit() else "A" if m.isupper() else "a"
    return kind(marker) == kind(other)


class Section:
    """Lines by key, in the keys' order."""

    def __init__(self, lines: Sequence[dict]):
        self.lines = {x["line_key"]: dict(x) for x in lines}
        self.keys = sorted(self.lines)

    def range_of(self, markers: Sequence[str]) -> tuple[int, int] | None:
        """Places of the lines from the first one with one of the markers up to the next one with another marker of the first's kind; the end is excluded."""
        own = {plain_marker(m) for m in markers}
        kind = plain_marker(markers[0])
        at = [plain_marker(self.lines[k]["marker"]) for k in self.keys]
        begin = next((k for k, m in enumerate(at) if m in own), None)
        if begin is None:
            return None
        end = next((k for k in range(begin + 1, len(at)) if at[k] and at[k] not in own and "(" not in at[k] and alike(at[k], kind)), len(at))
        return begin, end

    def add(self, place: int, text: str, by: int) -> None:
        """Lines of a text before the line at `place`."""
        low = self.keys[place - 1] if place else ""
        high = self.keys[place] if place < len(self.keys) else None
        said = [x.strip() for x in text.split("\n") if x.strip()]
        for key, content in zip(new_keys(low, high, len(said), by), said, strict=True):
            marker = _MARKER.match(content)
            self.lines[key] = {"line_key": key, "marker": marker[0] if marker else None, "content": content, "indent_level": 0, "created_by": by, "changed_by": by}
            insort(self.keys, key)

    def remove(self, begin: int, end: int) -> None:
        for k in self.keys[begin:end]:
            del self.lines[k]
        del self.keys[begin:end]

    def edit(self, key: str, by: int, **to: str | None) -> None:
        line = self.lines[key]
        if any(line[c] != x for c, x in to.items()):
            line.update(to, changed_by=by)

    def redesignate(self, change: dict) -> bool:
        """New markers for old ones, all at once; or, by its instruction, for the lines that ordinals name."""
        if pairs := designated(change["instruction"] or ""):
            places = [(i, m) for i, m in pairs if i < len(self.keys)]
            for i, m in places:
                said = self.lines[self.keys[i]]["content"] or ""
                self.edit(self.keys[i], change["change_id"], marker=m, content=said if said.startswith(m) else f"{m} {said}")
            return bool(places)
        old, new = change["old_markers"], change["new_markers"]
        if old is None or new is None or len(old) != len(new):
            return False
        to = {plain_marker(a): f"({plain_marker(b)})" for a, b in zip(old, new, strict=True)}
        hit = [k for k in self.keys if plain_marker(self.lines[k]["marker"]) in to]
        for k in hit:
            line = self.lines[k]
            m = to[plain_marker(line["marker"])]
            said = line["content"] or ""
            self.edit(k, change["change_id"], marker=m, content=m + said.removeprefix(line["marker"]) if said.startswith(line["marker"]) else said)
        return bool(hit)

    def place_for(self, change: dict) -> int:
        """Where the lines of an addition go: after or before the subsection that is its anchor, else after the one before their own marker in sequence, else at the end."""
        if change["position"] in ("after", "before") and change["anchor"]:
            anchor = _MARKER.match(change["anchor"])
            found = self.range_of([anchor[0]]) if anchor else None
            if found:
                return found[1] if change["position"] == "after" else found[0]
            return len(self.keys)
        own = _MARKER.match(change["new_text"].strip())
        before = before_in_sequence(plain_marker(own[0].partition(")")[0])) if own else None
        found = self.range_of([before]) if before else None
        return found[1] if found else len(self.keys)

    def apply(self, change: dict) -> bool:
        """Whether the change found its place."""
        kind, old, new, by = change["change_type"], change["old_text"], change["new_text"], change["change_id"]
        if kind == "Redesignate":
            return self.redesignate(change)
        if kind == "Add":
            if not new:
                return False
            self.add(self.place_for(change), new, by)
            return True
        if kind not in ("Modify", "Delete"):
            return False
        if old is not None:
            hit = False
            for k in self.keys:
                said = self.lines[k]["content"] or ""
                after = said.replace(old, new or "") if old and old in said else find_and_replace(said, old, new or "")
                if after is not None:
                    hit = True
                    self.edit(k, by, content=after)
            return hit
        marks = struck(change["instruction"] or "") or [plain_marker(m) for m in change["old_markers"] or ()]
        found = self.range_of(marks) if marks else None
        if found is None or kind == "Modify" and new is None:
            return False
        self.remove(*found)
        if new:
            self.add(found[0], new, by)
        return True


def applied(lines: Sequence[dict], changes: Sequence[dict]) -> tuple[list[dict], list[tuple[int, bool]]]:
    """The lines afterwards, in order, and whether each change found its place. Markers are redesignated before anything else, so that anchors are there."""
    section = Section(lines)
    order = [c for c in changes if c["change_type"] == "Redesignate"] + [c for c in changes if c["change_type"] != "Redesignate"]
    done = [(c["change_id"], section.apply(c)) for c in order]
    return [section.lines[k] | {"line_number": n} for n, k in enumerate(section.keys, 1)], done


def keyed(lines: DataFrame, key: list[str], created_by: str | None = None) -> DataFrame:
    """Lines (key, line_number, marker, content, indent_level) with the keys that they keep from now on."""
    by = (F.col(created_by) if created_by else F.lit(None)).cast("long")
    own = Window.partitionBy(*key).orderBy("line_number")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [F.col("line_number").cast("int").alias("line_number"), "marker", "content", F.col("indent_level").cast("int").alias("indent_level"), by.alias("created_by"), by.alias("changed_by")]
    rows = lines.select(*key, *columns).where("line_number IS NOT NULL").repartition(parts(lines, EACH), *key)
    rows = rows.withColumns({"_i": F.row_number().over(own), "_n": F.count(F.lit(1)).over(whole)})
    keys = F.pandas_udf(lambda n, i: pd.Series([_first_keys(x)[y - 1] for x, y in zip(n, i, strict=True)], dtype=object), "string")
    return rows.select(*key, keys("_n", "_i").alias("line_key"), "line_number", "marker", "content", "indent_level", "created_by", "changed_by")


def apply_anchored(lines: DataFrame, changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(lines after all changes, (key, change_id, placed) of each change).

    lines: key and LINES; changes: key and CHANGE. Lines that stay keep their key, so that what a
    line goes back to, created_by and changed_by, survives any number of revisions and is a join on
    the key; new lines get keys between their neighbours'. Sections without changes are passed on as
    they are; a section that has changes is put together once, with what is enacted for it. Numbers
    of changes are at least 0 and unique in a section.
    """
    fields = [x.split()[0] for x in LINES.split(", ")]
    # Sections are dealt out by the number of changes, since tasks hold what they sort and group.
    n = parts(changes, EACH // 10)
    steps = changes.repartition(n, *key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*CHANGE))).alias("_changes"))
    own = lines.repartition(n, *key).join(steps.select(*key).hint("merge"), key, "left_semi")
    touched = own.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("_lines"))
    rows = steps.join(touched.hint("merge"), key, "left").select(*key, "_lines", "_changes")
    kinds = ", ".join(f"{k} {changes.schema[k].dataType.simpleString()}" for k in key)

    def run(*row: object) -> Iterator[tuple]:
        *own, given, listed = row
        after, done = applied(given or [], listed)
        yield (*own, [{f: x[f] for f in fields} for x in after], [{"change_id": c, "placed": placed} for c, placed in done])

    line = "struct<" + ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in LINES.split(", ")) + ">"
    got = flat_mapped(rows, run, f"{kinds}, _after array<{line}>, _done array<struct<change_id: long, placed: boolean>>")
    after = got.select(*key, F.explode("_after").alias("_l")).select(*key, "_l.*")
    rest = lines.join(steps.select(*key), key, "left_anti").select(*key, *fields)
    return rest.unionByName(after), got.select(*key, F.explode("_done").alias("_d")).select(*key, "_d.*")


def provenance(lines: DataFrame, laws: DataFrame, key: list[str]) -> DataFrame:
    """Lines with the laws that made them and that changed them last: for each, its columns but law_id, with the prefixes created_ and changed_; nulls for lines from before all of them."""
    columns = [c for c in laws.columns if c != "law_id"]
    out = lines
    for role in ("created", "changed"):
        own = laws.select(F.col("law_id").alias(f"_{role}"), *(F.col(c).alias(f"{role}_{c}") for c in columns))
        out = out.join(own, F.col(f"{role}_by") == F.col(f"_{role}"), "left").drop(f"_{role}")
    return out.select(*key, "line_key", "line_number", "marker", "content", *(f"{role}_{c}" for role in ("created", "changed") for c in columns))

"""Edits of a section's lines, and the citations and notes that go with them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import flat_mapped
from .lineage import spread

_MARKER = re.compile(r"^\s*\(([0-9]{1,3}|[A-Za-z]{1,5})\)")


def marker_of(line: str) -> str | None:
    m = _MARKER.match(line)
    return m[1] if m else None


def before_in_sequence(marker: str) -> str | None:
    """(c) comes after (b), (3) after (2); None for the first, and for others than numbers and single letters."""
    if marker.isdigit():
        return str(int(marker) - 1) if int(marker) > 1 else None
    return chr(ord(marker) - 1) if len(marker) == 1 and marker.lower() != "a" else None


def block(lines: list[str], marker: str) -> tuple[int, int] | None:
    """The lines from a marker's to the next one of the same or a smaller indent."""
    start = next((i for i, x in enumerate(lines) if marker_of(x) == marker), None)
    if start is None:
        return None
    depth = len(lines[start]) - len(lines[start].lstrip("\t"))
    end = start + 1
    while end < len(lines) and len(lines[end]) - len(lines[end].lstrip("\t")) > depth:
        end += 1
    return start, end


def patch(lines: list[str], changes: list[tuple[str, str | None, str | None]]) -> list[str]:
    """The lines after (type, old, new) changes: markers first, then additions, replacements and removals.

    Redesignate takes markers as old and new. Add puts its lines after the block that comes before
    its own marker in sequence, else at the end. Modify and Delete replace in every line; a Delete
    of a marker such as (b) removes its whole block.
    """
    lines = list(lines)
    order = {"Redesignate": 0, "Add": 1, "Modify": 2, "Delete": 3}
    for kind, old, new in sorted(changes, key=lambda c: order.get(c[0], 9)):
        if kind == "Redesignate" and old and new:
            lines = [re.sub(rf"^(\s*)\({re.escape(old.strip('()'))}\)", rf"\1({new.strip('()')})", x) for x in lines]
        elif kind == "Add" and new:
            mine = marker_of(new)
            place = block(lines, before) if mine and (before := before_in_sequence(mine)) else None
            at = place[1] if place else len(lines)
            lines[at:at] = new.split("\n")
        elif kind == "Modify" and old is not None:
            lines = [x.replace(old, new or "") for x in lines]
        elif kind == "Delete" and old:
            whole = re.fullmatch(r"\(([0-9A-Za-z]{1,5})\)", old.strip())
            place = block(lines, whole[1]) if whole else None
            if place:
                del lines[place[0] : place[1]]
            else:
                lines = [y for x in lines if (y := x.replace(old, "")).strip() or not x.strip()]
    return lines


def patch_sections(sections: DataFrame, changes: DataFrame, key: list[str], text: str = "text_content") -> DataFrame:
    """Patches the lines of all sections that have changes, many sections to a batch; a section's changes are what is enacted for it."""
    steps = F.sort_array(F.collect_list(F.struct("change_id", "change_type", "old_text", "new_text")))
    rows = changes.groupBy(*key).agg(steps.alias("_s")).join(sections.select(*key, F.col(text).alias("_before")), key)
    rows = rows.select(*key, "_before", *(F.col(f"_s.{c}").alias(c) for c in ("change_type", "old_text", "new_text")))
    kinds = ", ".join(f"{k} {changes.schema[k].dataType.simpleString()}" for k in key)

    def run(*row: object) -> Iterator[tuple]:
        *own, before, kind, old, new = row
        lines = patch((before or "").split("\n"), list(zip(kind, old, new, strict=True)))
        yield (*own, "\n".join(lines), len(lines))

    return flat_mapped(spread(rows), run, f"{kinds}, text_content string, lines long")


def ordered_citations(citations: Column) -> Column:
    """Citations (array of struct<law, is_act, year>) with their roles: acts Framework, the first law Enactment, the others Amendment."""
    acts = F.filter(citations, lambda c: c["is_act"])
    laws = F.filter(citations, lambda c: ~c["is_act"])
    role = lambda c, i: F.when(i == 0, "Enactment").otherwise("Amendment")
    framework = F.transform(acts, lambda c: F.struct(c["law"].alias("law"), F.lit("Framework").alias("role"), c["year"].alias("year")))
    others = F.transform(laws, lambda c, i: F.struct(c["law"].alias("law"), role(c, i).alias("role"), c["year"].alias("year")))
    return F.concat(framework, others)


def last_modified(citations: Column) -> Column:
    """The newest year of citations other than Framework; null without one."""
    return F.array_max(F.transform(F.filter(citations, lambda c: c["role"] != "Framework"), lambda c: c["year"]))


def with_note(notes: Column, law: Column, year: Column, said: Column) -> Column:
    """The notes (array of struct<law, year, lines>) with one more at the end, its text as lines; as they are if the law has one."""
    one = F.struct(law.alias("law"), year.alias("year"), F.filter(F.split(said, "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return F.when(F.exists(notes, lambda n: n["law"] == law), notes).otherwise(F.concat(F.coalesce(notes, F.array().cast("array<struct<law:string,year:int,lines:array<string>>>")), F.array(one)))

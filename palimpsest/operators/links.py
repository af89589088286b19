"""Names of laws and sections in a text become links: the longest names first, by one automaton over all of them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import spread

PIECES = "array<struct<start_char: int, end_char: int, reference: int, said: string>>"


class Names:
    """An automaton of names, which tells all their occurrences in one pass over a text."""

    def __init__(self, names: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        self.size = [0]  # of the name that ends at a state
        self.name = [-1]
        for k, name in enumerate(names):
            at = 0
            for c in name:
                at = self.step[at].get(c) or self._add(at, c)
            if name and self.name[at] < 0:  # of equal names the first counts
                self.name[at], self.size[at] = k, len(name)
        # fall: the state of the longest proper suffix that is a prefix of a name; shorter: the next on that way where a name ends.
        self.fall, self.shorter = [0] * len(self.step), [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            at = waiting.popleft()
            for c, to in self.step[at].items():
                waiting.append(to)
                self.fall[to] = self._next(self.fall[at], c)
            back = self.fall[at]
            self.shorter[at] = back if self.name[back] >= 0 else self.shorter[back]

    def _add(self, at: int, c: str) -> int:
        self.step[at][c] = new = len(self.step)
        self.step.append({})
        self.size.append(0)
        self.name.append(-1)
        return new

    def _next(self, at: int, c: str) -> int:
        while at and c not in self.step[at]:
            at = self.fall[at]
        return self.step[at].get(c, 0)

    def occurrences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, name) of every occurrence, overlapping ones too."""
        at = 0
        for i, c in enumerate(text, 1):
            at = self._next(at, c)
            found = at if self.name[at] >= 0 else self.shorter[at]
            while found:
                yield i - self.size[found], i, self.name[found]
                found = self.shorter[found]


def chosen(text: str, names: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, name) of the occurrences that become links, in order.

    Longer names go before shorter ones, of equal length those listed first, then those further left;
    one that overlaps another gives way.
    """
    found = sorted(Names(names).occurrences(text), key=lambda x: (x[0] - x[1], x[2], x[0]))
    taken = bytearray(len(text))
    kept = []
    for start, end, name in found:
        # What is taken is at least as long, so one of the two ends would lie in it.
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, name))
    return sorted(kept)


def cut_up(text: str, names: list[str]) -> list[tuple[int, int, int | None, str]]:
    """The pieces of a text between and at its links: (start, end, name or None, words); put together they are the text."""
    out, done = [], 0
    for start, end, name in chosen(text, names):
        if start > done:
            out.append((done, start, None, text[done:start]))
        out.append((start, end, name, text[start:end]))
        done = end
    if done < len(text):
        out.append((done, len(text), None, text[done:]))
    return out


def pieces(text: Column, names: Column) -> Column:
    """The pieces of a text (PIECES): reference is the place of a name in `names` (from 0), null between links. Null for a null text; null and empty names are passed over."""

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, listed, strict=True):
            own = ["" if x is None else x for x in n] if n is not None else []
            out.append(None if t is None else [dict(zip(("start_char", "end_char", "reference", "said"), p, strict=True)) for p in cut_up(t, own)])
        return pd.Series(out, dtype=object)

    return run(text, names)


def route(reference: Column) -> Column:
    """Where a reference (ref_type, usc_title, usc_section, congress, law_number) leads; null where there is no page for it."""
    number = lambda x: F.coalesce(x != 0, F.lit(False))
    name = lambda x: F.coalesce(x.cast("string") != "", F.lit(False))
    to = lambda first, a, b: F.concat(F.lit(first), reference[a].cast("string"), F.lit("/"), reference[b].cast("string"))
    section = (reference["ref_type"] == "usc_section") & number(reference["usc_title"]) & name(reference["usc_section"])
    law = (reference["ref_type"] == "public_law") & number(reference["congress"]) & name(reference["law_number"])
    return F.when(section, to("/sections/", "usc_title", "usc_section")).when(law, to("/laws/", "congress", "law_number"))


def linked_pieces(texts: DataFrame, references: DataFrame, key: list[str], text: str = "text", order: str = "position", revision: Column | None = None) -> DataFrame:
    """Each text in pieces: key, piece, start_char, end_char, said, display_text, ref_type, target_id, href and linked.

    references: rows of key, `order`, display_text, ref_type, target_id, usc_title, usc_section,
    congress, law_number and resolvable. What a reference that can't be resolved or has no page
    names is a piece of its own without link. Of equal names of a text the first counts, so that
    names are put together once for each text, however often they are listed. revision is kept in
    links. Texts without references are one piece; null and empty texts have none.
    """
    fields = [c for c in ("display_text", "ref_type", "target_id", "usc_title", "usc_section", "congress", "law_number", "resolvable")]
    row = F.struct(order, *fields)
    first = references.where(F.col("display_text") != "").groupBy(*key, "display_text").agg(F.min_by(row, F.struct(order, F.xxhash64(*fields))).alias("_r"))
    own = first.groupBy(*key).agg(F.sort_array(F.collect_list("_r")).alias("_refs"))
    rows = spread(texts.select(*key, F.col(text).alias("_text"))).join(own, key, "left")
    cut = rows.select(*key, "_refs", F.posexplode(pieces(F.col("_text"), F.transform("_refs", lambda r: r["display_text"]))).alias("piece", "_p"))
    cut = cut.select(*key, "piece", "_p.*", F.get("_refs", F.col("_p.reference")).alias("_r"))
    href = F.when(F.coalesce(F.col("_r.resolvable"), F.lit(True)), route(F.col("_r")))
    if revision is not None:
        href = F.concat(href, F.lit("?rev="), revision.cast("string"))
    return cut.select(*key, "piece", "start_char", "end_char", "said", "_r.display_text", "_r.ref_type", "_r.target_id", href.alias("href"), href.isNotNull().alias("linked"))


def linked_text(cut: DataFrame, key: list[str]) -> DataFrame:
    """The pieces of each text put together, links written as [words](href)."""
    said = F.when(F.col("linked"), F.concat(F.lit("["), F.col("said"), F.lit("]("), F.col("href"), F.lit(")"))).otherwise(F.col("said"))
    own = cut.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece", said.alias("said")))).alias("_p"), F.count_if("linked").alias("links"))
    return own.select(*key, "links", F.array_join(F.transform("_p", lambda p: p["said"]), "").alias("linked_text"))

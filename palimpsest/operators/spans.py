"""Where words stand in a text that says them a little differently, by bit-parallel edit distance; and the stretches of a parse as JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distances(text: str, said: str, anywhere: bool = True) -> list[int]:
    """For each end in the text (0 first): the fewest changed, missing and added characters between `said` and a stretch that ends there; it begins anywhere, or else where the text does.

    A column of the table of distances is two numbers, whose bits say where it rises and falls, so
    that a character of the text costs a few operations on numbers as long as `said`.
    """
    n = len(said)
    if not n:
        return [0 if anywhere else k for k in range(len(text) + 1)]
    where: dict[str, int] = {}
    for i, c in enumerate(said):
        where[c] = where.get(c, 0) | 1 << i
    whole, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now = whole, 0, n
    out = [n]
    for c in text:
        same = where.get(c, 0)
        vertical = same | down
        level = ((same & up) + up ^ up) | same
        rise, fall = down | ~(level | up) & whole, up & level
        now += (rise & top > 0) - (fall & top > 0)
        rise, fall = (rise << 1 | (not anywhere)) & whole, fall << 1 & whole
        up, down = fall | ~(vertical | rise) & whole, rise & vertical
        out.append(now)
    return out


def approximate_span(text: str, said: str) -> tuple[int, int, int]:
    """(start, end, distance) of the stretch of a text that is nearest to `said`: the first end of the least distance, and the last start that has it; white space at either end of `said` doesn't count."""
    said = said.strip()
    at = text.find(said)
    if at >= 0:
        return at, at + len(said), 0
    ends = distances(text, said)
    least = min(ends)
    end = ends.index(least)
    # From the end back: how much of the text before it belongs to the stretch.
    size = distances(text[max(0, end - len(said) - least) : end][::-1], said[::-1], False).index(least)
    return end - size, end, least


def spans_of(text: Column, said: Column) -> Column:
    """(start_pos, end_pos, distance) of the stretch of each text that is nearest to what is said; null where either is null."""

    @F.pandas_udf("start_pos int, end_pos int, distance int")
    def run(texts: pd.Series, words: pd.Series) -> pd.DataFrame:
        got = [approximate_span(t, w) if t is not None and w is not None else (None, None, None) for t, w in zip(texts, words, strict=True)]
        return pd.DataFrame(got, columns=["start_pos", "end_pos", "distance"]).astype("Int32")

    got = run(text, said)
    return F.when(got["start_pos"].isNotNull(), got)


def spans_json(spans: DataFrame, key: list[str], with_text: bool = True) -> DataFrame:
    """A law's stretches (start_pos, end_pos, kind, pattern_name, text) as one JSON text, in order, with how many there are and how long they are; without texts if so asked."""
    fields = ["start_pos", "end_pos", "kind", "pattern_name", *(["text"] if with_text else [])]
    own = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_s"))
    length = F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + s["end_pos"] - s["start_pos"])
    return own.select(*key, F.to_json(F.struct(F.size("_s").alias("spans"), length.alias("length"), F.col("_s").alias("items"))).alias("json"))

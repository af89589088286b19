"""Unions, gaps and overlaps of intervals, by windows over their starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(rows: DataFrame, key: list[str], start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Maximal merged intervals of each key; intervals that touch are merged."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(merged: DataFrame, key: list[str], start: str = "start_pos", end: str = "end_pos", low: str | None = None, high: str | None = None) -> DataFrame:
    """What lies between merged intervals, and, with columns `low` and `high` of the whole range, before and after them."""
    w = Window.partitionBy(*key).orderBy(start)
    before = F.lag(end).over(w)
    inner = merged.withColumn("gap_start", before if low is None else F.coalesce(before, F.col(low))).withColumn("gap_end", F.col(start))
    out = inner.select(*key, "gap_start", "gap_end")
    if high is not None:
        out = out.unionByName(merged.groupBy(*key).agg(F.max(end).alias("gap_start"), F.max(high).alias("gap_end")))
    return out.where("gap_start is not null and gap_end > gap_start")


def covered(merged: DataFrame, key: list[str], total: str, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Length of the merged intervals and its share of the total, in per cent."""
    out = merged.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.max(total).alias(total))
    return out.withColumn("coverage", F.bround(F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col(total)), F.lit(0.0)), 2))


def streak(rows: DataFrame, key: list[str], order: list, good: str, skip: str) -> DataFrame:
    """The run of `good` rows from the newest on (in `order`); rows where `skip` holds neither count nor break it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    live = rows.where(~F.expr(skip)).withColumn("_bad", F.sum(F.when(F.expr(good), 0).otherwise(1)).over(w))
    found = live.groupBy(*key).agg(F.count_if(F.col("_bad") == 0).alias("streak"))
    return rows.select(*key).distinct().join(found, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def points_in(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Points with the half-open spans of their key that hold them; both are dealt to cells of `width`, so that a long key is spread over many."""
    dealt = spans.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    rows = points.withColumn("_cell", F.floor(F.col(at) / width)).join(dealt, [*key, "_cell"])
    return rows.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, key: list[str], start: str = "start_pos", end: str = "end_pos", width: int = 256) -> DataFrame:
    """Pairs of overlapping half-open intervals of equal key (columns of b get the suffix _b).

    Intervals are dealt to cells of `width`, and a pair counts in the cell where it begins to
    overlap, so that a long key is spread over many cells.
    """
    cells = lambda d, s, e: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    right = b.select(*key, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in key))
    pairs = cells(a.where(F.col(end) > F.col(start)), start, end).join(cells(right.where(F.col(f"{end}_b") > F.col(f"{start}_b")), f"{start}_b", f"{end}_b"), [*key, "_cell"])
    begin = F.greatest(start, f"{start}_b")
    return pairs.where((begin < F.least(end, f"{end}_b")) & (F.floor(begin / width) == F.col("_cell"))).drop("_cell")

"""Lookups by date, range, override and hierarchy; timelines, searches and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges that are broadcast at most.
MOST_RANGES = 1000


def as_of(rows: DataFrame, key: list[str], date: str, on: Column, tie: str) -> DataFrame:
    """The newest row of each key on or before a date, by a hash aggregate (ties: the larger `tie`)."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.where(F.col(date) <= on).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(date, tie)).alias("_r"))
    return out.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], left_date: str, right_date: str, values: list[str]) -> DataFrame:
    """Each left row with the newest right values of its key at or before its date, in one sort of both sides."""
    a = left.select(*key, F.col(left_date).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*key, F.col(right_date).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return rows.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def valid_at(start: str, end: str, at: Column) -> Column:
    """A closed range that is open-ended where its end is null."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))


def range_label(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str, other: str, width: int = 366) -> DataFrame:
    """The label of the dates' range that holds each value (both ends count), else `other`; ranges don't overlap.

    Up to MOST_RANGES ranges are broadcast. More are dealt, with the values, to cells of `width` days
    and joined there.
    """
    inside = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    if ranges.limit(MOST_RANGES + 1).count() <= MOST_RANGES:
        joined = rows.join(F.broadcast(ranges), inside, "left")
    else:
        cell = lambda c: F.floor(F.unix_date(F.col(c)) / width)
        dealt = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
        joined = rows.withColumn("_cell", cell(value)).join(dealt.withColumnRenamed("_cell", "_other"), (F.col("_cell") == F.col("_other")) & inside, "left").drop("_cell", "_other")
    return joined.withColumn(label, F.coalesce(label, F.lit(other))).drop(low, high)


def override(rows: DataFrame, specific: DataFrame, general: DataFrame, on_specific: list[str], on_general: list[str], value: str) -> DataFrame:
    """The specific rule's value where there is one, else the general rule's."""
    s = specific.select(*on_specific, F.col(value).alias("_s"))
    g = general.select(*on_general, F.col(value).alias("_g"))
    return rows.join(s, on_specific, "left").join(g, on_general, "left").withColumn(value, F.coalesce("_s", "_g")).drop("_s", "_g")


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, descendant, depth) of a forest, each node at depth 0 of itself; one join for each level.

    For all pairs; `descendants` walks from one root. Below DEEPEST levels, pairs found before are left
    out, so that a loop in the parent links ends.
    """
    step = nodes.select(F.col(node).alias("descendant"), F.col(parent).alias("_up"))
    level = step.select(F.col("descendant").alias("ancestor"), "descendant", F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        level = level.join(step.select(F.col("descendant").alias("ancestor"), "_up"), "ancestor").where("_up is not null")
        level = level.select(F.col("_up").alias("ancestor"), "descendant", F.lit(depth).alias("depth"))
        level = cut(level.join(out.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti") if depth > DEEPEST else level)
        if not level.head(1):
            return out
        out = out.unionByName(level)


def descendants(nodes: DataFrame, root: str, order: str | None = None, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, depth) of a root and all below it, a join for each level; with `order`, also place, the values of that column from below the root down.

    A node has one parent, so that only a loop through the root could come back; it is cut there.
    """
    rows = nodes.select(F.col(node).alias("id"), F.col(parent).alias("_up"), (F.col(order) if order else F.lit(0)).cast("long").alias("_at"))
    level = rows.where(F.col("id") == root).select("id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("place"))
    out, depth = level, 0
    while level.head(1):
        depth += 1
        below = rows.where(F.col("id") != root).join(level.select(F.col("id").alias("_up"), "place"), "_up")
        level = cut(below.select("id", F.lit(depth).alias("depth"), F.concat("place", F.array("_at")).alias("place")))
        out = out.unionByName(level)
    return out if order else out.drop("place")


def timeline(laws: DataFrame, release_points: DataFrame) -> DataFrame:
    """Laws and release points in order: by date (missing first), laws before release points, Congress, number.

    Both come with event_type, identifier, congress, law_number and event_date.
    """
    events = laws.unionByName(release_points)
    first = F.coalesce("event_date", F.lit("0001-01-01").cast("date"))
    return events.withColumns({"sort_date": first, "type_order": F.when(F.col("event_type") == "public_law", 0).otherwise(1), "number": F.coalesce("law_number", F.lit(0))})


#: Levels of a forest below which pairs are looked up before they count.
DEEPEST = 64
TIMELINE_ORDER = ["sort_date", "type_order", "congress", "number", "identifier"]


def timeline_slice(events: DataFrame, start: str, end: str) -> DataFrame:
    """The events from one release point to another, both included; an error if either is missing.

    Events are compared with the two ends by their place in the order, without numbering them.
    """
    place = F.struct(*TIMELINE_ORDER)
    ends = events.where(F.col("identifier").isin(start, end) & (F.col("event_type") == "release_point")).select("identifier", place.alias("_end"))
    if missing := {start, end} - {r["identifier"] for r in ends.select("identifier").collect()}:
        raise KeyError(f"no such release point: {', '.join(sorted(missing))}")
    one = ends.agg(F.min(F.when(F.col("identifier") == start, F.col("_end"))).alias("_from"), F.max(F.when(F.col("identifier") == end, F.col("_end"))).alias("_to"))
    return events.join(F.broadcast(one), (place >= F.col("_from")) & (place <= F.col("_to"))).drop("_from", "_to")


def not_deferred(laws: DataFrame, deferred: DataFrame) -> DataFrame:
    """Laws that no upcoming release point leaves out."""
    return laws.join(deferred.select("congress", "law_number").distinct(), ["congress", "law_number"], "left_anti")


def contains(text: Column, query: str) -> Column:
    """Case-insensitive containment of the query as it stands; % and _ have no meaning."""
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def snippet(text: Column, query: str, before: int = 80, after: int = 120, plain: int = 200) -> Column:
    """The text around the first hit, in any case, with dots where it is cut; without a hit its beginning."""
    at = F.locate(query.lower(), F.lower(text))
    begin = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(at - 1 + len(query) + after, F.length(text))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, plain), F.when(F.length(text) > plain, "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(head)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """One page in a total order, and the number of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def upsert(target: DataFrame, source: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """The target with the source's rows: those of known keys replace (update) or give way to the target's."""
    keep, add = (target.join(source.select(*key), key, "left_anti"), source) if update else (target, source.join(target.select(*key), key, "left_anti"))
    return keep.unionByName(add.dropDuplicates(key))


def upsert_outcome(target: DataFrame, source: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """created, updated or skipped for each source row, by whether the target has its key and its hash."""
    known = target.select(*key, F.col(hash_col).alias("_old"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "created").when(F.col("_old").eqNullSafe(F.col(hash_col)), "skipped").otherwise("updated")
    return source.join(known, key, "left").withColumn("outcome", kind).drop("_old", "_known")


def replace_children(target: DataFrame, source: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the parents in the source are the source's; the others stay."""
    return target.join(source.select(*parent).distinct(), parent, "left_anti").unionByName(source)


def split_known(rows: DataFrame, known: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and those whose key isn't, for a table of rejects."""
    ids = known.select(*key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")

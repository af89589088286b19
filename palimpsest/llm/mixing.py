"""Mixing of sources to target weights by proportionate fair scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, pieces, running

#: Rows of a block.
BLOCK = 64
#: So many sources' slots are broadcast, at most, and so many slots has a period, at most.
MOST_SOURCES, MOST_SLOTS = 10_000, 1 << 20


def whole_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights, to six decimals, as the smallest whole numbers of the same ratios; their sum is the schedule's period.

    Sources of weight 0 are left out. A period of over MOST_SLOTS (and over the number of sources) is refused.
    """
    if any(w < 0 or w != w or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be finite, and at least 0")
    exact = {s: Fraction(round(Fraction(w) * 10**6)) for s, w in weights.items()}
    exact = {s: w for s, w in exact.items() if w}
    share = math.gcd(*(int(w) for w in exact.values())) or 1
    out = {s: int(w) // share for s, w in exact.items()}
    if sum(out.values()) > max(MOST_SLOTS, len(out)):
        raise ValueError(f"these weights repeat only after {sum(out.values())} slots; round them")
    return out


def pfair(counts: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period, its slots being the sum of the counts.

    counts are whole weights. Block i of a source with c of S slots is released at floor(i S / c) and due at ceil((i + 1) S / c);
    of the blocks released, the one due first takes the slot. So each source has had, after any
    number t of slots, less than one block more or less than t c / S.
    """
    slots = sum(counts.values())
    order = sorted(counts, key=lambda s: (s is None, s or ""))
    waiting = [(0, k, 0) for k in range(len(order))]
    ready: list[tuple[int, bool, int, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            c = counts[order[k]]
            due = -(-(i + 1) * slots // c)
            # Of equal deadlines, first the block whose window overlaps the next one's, then the heavier source.
            heapq.heappush(ready, (due, (i + 1) * slots % c == 0, -c, k, i))
        due, _, _, k, i = heapq.heappop(ready)
        c = counts[order[k]]
        out.append((order[k], i, i * slots // c, due, t))
        if i + 1 < c:
            heapq.heappush(waiting, ((i + 1) * slots // c, k, i + 1))
    return out


def period_plan(sources: DataFrame, weights: Mapping[str | None, float] | None, other: float) -> DataFrame:
    """(_source, _late, _c, _all, _slots) for each source: its slots in a period, how many a period has, and which are its own.

    One task makes a period's schedule from a row for each source. Sources of weight 0 are late: they have a schedule of equal weights of their own.
    """
    kind = sources.schema[0].dataType.simpleString()

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(x) else x for x in p["_source"]]
        timely = whole_weights({s: weights.get(s, other) if weights else 1 for s in names})
        rows = []
        for late, count in ((False, timely), (True, {s: 1 for s in names if s not in timely})):
            own: dict[str | None, list[int]] = {s: [] for s in count}
            for s, _, _, _, slot in pfair(count):
                own[s].append(slot)
            rows += [(s, late, c, sum(count.values()), own[s]) for s, c in count.items()]
        return pd.DataFrame(rows, columns=["_source", "_late", "_c", "_all", "_slots"])

    return sources.distinct().withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(plan, f"_source {kind}, _late boolean, _c long, _all long, _slots array<long>")


def _placed(docs: DataFrame, weights: Mapping[str | None, float] | None, other: float, key: str, source: str, block: int) -> DataFrame:
    """_record (all columns), _n (number in the source), _block, _release, _deadline and _slot of each row."""
    plan = cut(period_plan(docs.select(F.col(source).alias("_source")), weights, other))
    late = 0
    if plan.where("_late").limit(1).count():
        # Late sources begin where the others have placed their last block.
        blocks = docs.groupBy(F.col(source).alias("_from")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
        ends = blocks.join(plan.where("not _late"), F.col("_from").eqNullSafe(F.col("_source"))).select(F.ceil(F.col("_blocks") / F.col("_c")) * F.col("_all"))
        late = ends.agg(F.max(ends[0])).first()[0] or 0
    if plan.count() <= MOST_SOURCES:
        plan = F.broadcast(plan)
    rest = [F.col(c) for c in docs.columns if c != key]
    rows = docs.select(F.struct("*").alias("_record"), F.col(source).alias("_from"), F.col(key).alias("_key"), (F.xxhash64(*rest) if rest else F.lit(0)).alias("_tie"))
    rows = numbered(rows, ["_from"], ["_key", "_tie"], "_n", pieces(docs, 16 << 20, 64)).withColumn("_block", F.floor(F.col("_n") / block).cast("long"))
    rows = rows.join(plan, F.col("_from").eqNullSafe(F.col("_source")))
    begin = F.floor(F.col("_block") / F.col("_c")).cast("long") * F.col("_all") + F.when(F.col("_late"), F.lit(late)).otherwise(F.lit(0))
    i = F.col("_block") % F.col("_c")
    release = F.floor(i * F.col("_all") / F.col("_c")).cast("long")
    deadline = F.ceil((i + 1) * F.col("_all") / F.col("_c")).cast("long")
    return rows.select("_record", "_n", "_block", (begin + release).alias("_release"), (begin + deadline).alias("_deadline"), (begin + F.element_at("_slots", i.cast("int") + 1)).alias("_slot"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK, other: float = 0.0) -> DataFrame:
    """Orders all rows so that, block by block, each source gets its target share.

    Adds to the table block (a source's rows, `block` at a time, in an order that the keys' hashes fix),
    release, deadline and slot of the block, and position (gapless from 0, in slot order). weights
    are by source, to six decimals, all equal if not given; sources without one have the weight
    `other`. The schedule repeats exactly after as many slots as the weights, as smallest whole
    numbers, sum up to. So after any number of slots a source that has blocks left has had less
    than one block more or less than its weight's share of them; slots of sources that have run out
    stay empty and don't count for position. Sources of weight 0 follow after all others, in equal
    shares, so that no row is lost. Weights of a period of over MOST_SLOTS raise an error.

    Null sources are a source of their own. Repeated rows and null keys get positions of their own.
    An empty table gives no rows. Other columns stay, whatever their names; those of the names added
    are replaced.
    """
    added = ["block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*added)
    rows = _placed(docs, weights, other, key, source, block)
    filled = cut(rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_rows")))
    starts = running(filled, "_slot", "_rows", "_start").withColumnRenamed("_slot", "_s")
    out = rows.join(starts, F.col("_slot") == F.col("_s"))
    own = [F.col(f"_record.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, *(F.col(f"_{c}").alias(c) for c in added[:-1]), (F.col("_start") + F.col("_n") % block).alias("position"))


def mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK, other: float = 0.0) -> DataFrame:
    """The table's rows in the order of `mix`: partitions follow one another and are sorted by slot."""
    out = _placed(docs, weights, other, key, source, block).repartitionByRange(pieces(docs, 16 << 20), "_slot", "_n").sortWithinPartitions("_slot", "_n")
    return out.select(*(F.col(f"_record.`{c}`").alias(c) for c in docs.columns))

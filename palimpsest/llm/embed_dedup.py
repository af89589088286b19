"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied
from .components import connected_components

#: Bits of a table's key, at least; more where there are more vectors than keys.
BITS = 16
#: The chance that a pair right at the threshold meets in no table.
MISS = 4e-5
#: Rows of a bucket that are compared as a whole; larger buckets are split into pairs of blocks.
BLOCK = 256
#: Rows of buckets that go to one task together, and the size up to which their pairs are made at once.
CELL, SMALL = 4000, 24
#: At most so many buckets count as large, which bounds what is broadcast.
MOST_LARGE = 100_000


def usable(vector: F.Column) -> F.Column:
    """Not null, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def tables_for(least: float, bits: int) -> int:
    """So many tables that a pair of cosine `least` fails to meet with probability MISS."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-agree)))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)


def compared(ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, sign: np.ndarray, table: int, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, weighted by the other's copies, and each row's root in the forest of those links.

    A pair counts in the first table where its rows meet. side: 0 and 1, if only pairs across count.
    """
    n = len(ids)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, n, 512):
        rows = slice(i, min(n, i + 512))
        near = (vectors[rows] @ vectors.T) / (norm[rows, None] * norm[None, :]) >= least
        for t in range(table):
            near &= sign[rows, t][:, None] != sign[None, :, t]
        if side is not None:
            near &= side[rows, None] != side[None, :]
        near[np.arange(rows.stop - i), np.arange(i, rows.stop)] = False
        links[rows] += near @ copies
        for k in np.flatnonzero(near.any(axis=1)):
            others = np.flatnonzero(near[k])
            tops = {root(int(i + k)), *(root(int(o)) for o in np.unique(parent[others]))}
            low = min(tops, key=lambda r: ids[r])
            for r in tops:
                parent[r] = low
    return links, ids[[root(j) for j in range(n)]]


def small_buckets(bucket: np.ndarray, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, sign: np.ndarray, table: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row, and links that connect them, among rows of equal buckets; rows are sorted by bucket."""
    n = len(ids)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    links = np.zeros(n, np.int64)
    parent: dict[int, int] = {}
    forest = []

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for gap in range(1, SMALL):
        a = np.flatnonzero(bucket[gap:] == bucket[: n - gap]) if gap < n else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + gap
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= least
        a, b = a[near], b[near]
        before = (sign[a] == sign[b]) & (np.arange(sign.shape[1]) < table[a][:, None])
        a, b = a[~before.any(axis=1)], b[~before.any(axis=1)]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((int(ids[i]), int(ids[j])))
    return links, forest


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, bits: int | None = None, seed: int = 17) -> DataFrame:
    """Links rows of one label whose cosine, in double precision, is at least `least`; joins links into components.

    Returns key, n_links (other rows linked directly), component_id (smallest key reachable) and
    kept (key = component_id), a row for each row. Equal vectors are collapsed first and count as
    links of one another. Rows with a null label or an unusable vector (null, zero, or with null or
    non-finite components) link with nothing, and so do vectors of different lengths. Rows with a
    null key have a null component and are not kept. An empty table gives no rows; other columns
    are left out.
    """
    # Floats stay floats until they are compared, in double precision.
    kind = "float" if table.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector), lambda x: x.cast(kind))
    rows = table.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("_label"), v.alias("_v"))
    # A key for equal vectors of one label (negative zero counts as zero).
    plain = F.transform("_v", lambda x: (x + F.lit(0.0)).cast("double"))
    linked = usable(F.col("_v")) & F.col("_label").isNotNull() & F.col("_id").isNotNull()
    rows = rows.withColumns({"_k1": F.when(linked, F.xxhash64("_label", plain)), "_k2": F.when(linked, F.xxhash64(plain, "_label", F.lit(1)))})
    same = cut(rows.where("_k1 is not null").groupBy("_k1", "_k2").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("_label").alias("label"), F.first("_v").alias("v")))

    bits = bits or max(BITS, math.ceil(math.log2(same.count() + 1)))
    tables = tables_for(least, bits)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for d, part in p.groupby(p["v"].map(len)):
                x = np.stack(part["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "label": part["label"].astype(str) + f":{d}", "v": part["v"], "sign": list(signatures(x, bits, tables, seed))})

    signed = cut(same.select("id", "copies", F.col("label").cast("string").alias("label"), "v").mapInPandas(tidied(hashed), f"id long, copies long, label string, v array<{kind}>, sign array<int>"))
    # Rows are dealt to buckets by id alone; vectors follow to those that hold more than one.
    spread = signed.select("id", "label", F.posexplode("sign").alias("t", "s")).select("id", "t", F.xxhash64("label", "t", "s").alias("bucket"))
    met = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = met.agg(F.sum("n")).first()[0] or 0
    large = max(BLOCK, -(-total // MOST_LARGE))
    # Rows alone in their bucket go no further. Small buckets go to tasks many at a time; one above `large` rows goes in pairs of blocks.
    split = met.where(F.col("n") > large).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    held = cut(spread.join(met.select("bucket"), "bucket", "left_semi").join(F.broadcast(split), "bucket", "left"))
    held = held.join(signed.select("id", "copies", "v", "sign"), "id")
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    tasks = tasks.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    cell = F.when(F.col("blocks").isNull(), F.pmod("bucket", F.lit(max(8, total // CELL)))).otherwise(F.xxhash64("bucket", "lo", "hi"))
    tasks = tasks.select(cell.alias("cell"), "bucket", "id", "copies", "v", "sign", "t", "own", F.coalesce("blocks", F.lit(0)).alias("blocks"), "lo", "hi")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        by = np.lexsort((get("id"), get("bucket")))
        bucket, ids, copies, t, side = (get(c)[by] for c in ("bucket", "id", "copies", "t", "own"))
        lists = lambda c: group.column(c).combine_chunks().flatten().to_numpy()
        width = pa.compute.list_value_length(group.column("v").combine_chunks()).to_numpy()[by]
        at = np.concatenate([[0], np.cumsum(width[np.argsort(by)])])
        flat = lists("v")
        sign = lists("sign").reshape(len(by), -1)[by]
        rows: list[tuple[int, int, int]] = []
        for d in np.unique(width):
            k = np.flatnonzero(width == d)
            x = flat[at[by[k]][:, None] + np.arange(d)].astype(float)
            if group.column("blocks")[0].as_py():
                found = compared(ids[k], copies[k], x, sign[k], int(t[0]), side[k] if get("lo")[0] != get("hi")[0] else None, least)
                rows += [(int(i), int(r), int(n)) for i, r, n in zip(ids[k], found[1], found[0], strict=True) if n]
                continue
            edge = np.flatnonzero(np.concatenate([[True], bucket[k][1:] != bucket[k][:-1], [True]]))
            size = np.repeat(np.diff(edge), np.diff(edge))
            few = size <= SMALL
            count, forest = small_buckets(bucket[k][few], ids[k][few], copies[k][few], x[few], sign[k][few], t[k][few], least)
            rows += [(int(i), int(i), int(n)) for i, n in zip(ids[k][few], count, strict=True) if n] + [(a, b, 0) for a, b in forest]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j - i > SMALL:
                    found = compared(ids[k][i:j], copies[k][i:j], x[i:j], sign[k][i:j], int(t[k][i]), None, least)
                    rows += [(int(i), int(r), int(n)) for i, r, n in zip(ids[k][i:j], found[1], found[0], strict=True) if n]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], schema=links)

    found = cut(tasks.groupBy("cell").applyInArrow(tidied(compare), "a long, b long, links long"))
    parts = connected_components(found.select("a", "b")).select(F.col("node").alias("id"), "component")
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    by_vector = cut(same.select("_k1", "_k2", "id", "copies").join(degree, "id", "left").join(parts, "id", "left").select("_k1", "_k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("_component")))
    out = rows.select("_id", "_k1", "_k2").join(by_vector, ["_k1", "_k2"], "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"))

"""Centroid clustering of 64-component vectors by weighted popcounts of bit planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied

#: Components of a vector: one bit of each makes up the word of a plane.
WIDTH = 64
#: Integers beyond this, either side, count as this, so that every distance fits a long.
MOST = 1 << 27
_LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in double precision, bounded by MOST."""
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def packed(x: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes) words: bit j of word p is bit p of the row's component j; components are at least 0."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpacked(words: np.ndarray) -> np.ndarray:
    """(rows, planes, 64): the bits of the words."""
    return np.unpackbits(np.ascontiguousarray(words[:, :, None]).view(np.uint8), axis=2, bitorder="little")


def dots(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot product of each row with `other`, the planes of one vector or of a vector for each row.

    Planes p and q have 2**(p + q) times as many common bits as their AND has ones.
    """
    weight = 2.0 ** np.arange(words.shape[1])
    out = np.zeros(len(words), np.int64)
    for q in range(other.shape[-1]):
        ones = np.bitwise_count(words & other[..., q : q + 1])
        out += (ones @ weight).astype(np.int64) << q
    return out


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the squared distance."""
    own = dots(words, words)
    best, least = np.zeros(len(words), np.int32), np.full(len(words), _LONG)
    for k, c in enumerate(centroids):
        d = own + dots(c[None], c)[0] - 2 * dots(words, c)  # sums that overflow come back: a distance fits
        closer = d < least
        best[closer], least[closer] = k, d[closer]
    return best, least


def sums(words: np.ndarray, cluster: np.ndarray, clusters: int) -> np.ndarray:
    """(clusters, 64): sums of the rows' components by cluster, from the planes' counts of ones."""
    out = np.zeros((clusters, WIDTH), np.int64)
    by = np.argsort(cluster, kind="stable")
    edge = np.flatnonzero(np.diff(cluster[by], prepend=-1))
    if len(by):
        ones = np.add.reduceat(unpacked(words[by]), edge, axis=0, dtype=np.int64)
        out[cluster[by[edge]]] = (ones << np.arange(words.shape[1])[None, :, None]).sum(axis=1)
    return out


def cluster(table: DataFrame, clusters: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Lloyd's rounds over integer vectors floor(scale * x), all sums and distances exact.

    Vectors count that have exactly 64 components, none null or non-finite; the others give no row.
    Centroids start as the vectors with the smallest SHA-256 of `salt:key`, a null key being the
    text 'null', equal keys in the vectors' order; with fewer vectors than `clusters` there is a
    centroid for each. A round assigns every vector to its nearest centroid, ties to the smaller
    number, and moves each centroid that has vectors to the floor of their mean; then vectors are
    assigned once more. Integers beyond 2**27 count as that, and sums of distances beyond a long as
    its largest value.

    Returns key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, a row
    for each vector that counts. Rows that repeat are vectors of their own. Without such vectors
    there are no rows; other columns are left out.

    A task sends a sum for each centroid and component, so that what is shuffled and what the
    driver gets don't grow with the vectors, and a cluster may hold any share of them.
    """
    spark = table.sparkSession
    out = f"{table.select(F.col(key).alias(key)).schema[0].simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = table.where(finite(F.col(vector)) & (F.size(vector) == WIDTH)).select(F.col(key).alias("_key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("_v"))
    low, high = rows.agg(F.min(F.array_min("_v")), F.max(F.array_max("_v"))).first()
    if low is None:
        return spark.createDataFrame([], out)
    low, high = (int(x) for x in whole(np.array([low, high]), scale))
    planes = max(1, (high - low).bit_length())
    kind = rows.schema["_key"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column("_v").flatten().to_numpy().reshape(-1, WIDTH), scale) - low
            words = packed(x, planes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), planes).cast(pa.list_(pa.int64()))], names=["_key", "_planes"])

    order = F.sha2(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("_key").cast("string"), F.lit("null"))), 256)
    first = rows.select("_v", order.alias("_order")).orderBy("_order", "_v").limit(clusters).collect()
    centroids = [[int(x) for x in whole(np.array(r["_v"]), scale)] for r in first]
    rows = cut(rows.mapInArrow(tidied(pack), f"_key {kind.simpleString()}, _planes array<long>"))

    def words_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("_planes").flatten().to_numpy().reshape(-1, planes).view(np.uint64)

    def packed_centroids() -> np.ndarray:
        return packed(np.array(centroids, np.int64) - low, planes)

    for _ in range(rounds):
        now = packed_centroids()

        def partial(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(now), WIDTH), np.int64), np.zeros(len(now), np.int64)
            for b in batches:
                words = words_of(b)
                own = nearest(words, now)[0]
                total += sums(words, own, len(now))
                n += np.bincount(own, minlength=len(now))
            k = np.flatnonzero(n)
            each = np.concatenate([total[k], n[k, None]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(k, WIDTH + 1), pa.int32()), pa.array(np.tile(np.arange(WIDTH + 1), len(k)), pa.int32()), pa.array(each.ravel(), pa.int64())],
                names=["cluster", "component", "total"],
            )

        found = rows.mapInArrow(tidied(partial), "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
        total = {(r["cluster"], r["component"]): int(r["total"]) for r in found.collect()}
        for k in range(len(centroids)):
            if n := total.get((k, WIDTH)):
                centroids[k] = [total[k, j] // n + low for j in range(WIDTH)]

    now = packed_centroids()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, distance = nearest(words_of(b), now)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["_key", "cluster", "distance"])

    assigned = cut(rows.mapInArrow(tidied(assign), f"_key {kind.simpleString()}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("n")).collect()}
    each = [(k, min(n, _LONG), min(sum(inertia.values()), _LONG), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, n in inertia.items()]
    figures = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return assigned.join(F.broadcast(figures), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .embed_dedup import usable

#: Rows that the rotation and the radius are learned from, at most; those with the smallest key hashes.
MOST_LEARNED = 5_000
#: Bits of a substring; each substring has a table of its own.
SUBSTRING = 8
#: Share of the sample's true neighbours that the radius must reach.
REACH = 0.985
#: Rows and queries of one task.
ROWS, QUERIES = 8192, 2048

_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


class Codes:
    """Signs of rotated, centred directions: principal axes turned so that the signs lose least."""

    def __init__(self, x: np.ndarray, rounds: int = 30, seed: int = 3):
        d = x.shape[1]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = u.mean(axis=0) if len(u) > 4 * d else np.zeros(d)
        v = u - self.mean
        axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
        for _ in range(rounds):
            p, _, q = np.linalg.svd(np.where(v @ axes @ turn > 0, 1.0, -1.0).T @ (v @ axes))
            turn = (p @ q).T
        self.planes = axes @ turn

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes, 8 bits in each, for every vector."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean
        return np.packbits(u @ self.planes > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        out += _ONES[a[:, j][:, None] ^ b[None, :, j]]
    return out


def learned_radius(x: np.ndarray, codes: Codes, k: int) -> int:
    """The Hamming radius that reaches a share REACH of the k nearest of the sample's rows among themselves."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, len(u), max(1, len(u) // 400))
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2.0
    k = min(k, len(u) - 1)
    if k < 1:
        return 8 * codes(x[:1]).shape[1]
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    code = codes(x)
    return int(np.quantile(np.take_along_axis(distances(code[q], code), near, axis=1), REACH))


class Index:
    """The codes of a block of rows, with a table for each substring from its value to the rows that have it."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(code[order, j], np.arange(257))))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius of one code.

        One of the m substrings of such a row differs in at most radius // m bits, and in no more
        than that less one unless it is among the first radius % m + 1; those values are probed.
        """
        m = self.code.shape[1]
        found = np.zeros(len(self.code), bool)
        for j, (order, at) in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            for value in np.flatnonzero(_ONES[np.arange(256) ^ q[j]] <= reach) if reach >= 0 else ():
                found[order[at[value] : at[value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[_ONES[self.code[rows] ^ q].sum(axis=1, dtype=np.int64) <= radius]


def nearest(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, most_learned: int = MOST_LEARNED) -> DataFrame:
    """The k nearest rows of each query row by cosine, among all rows but the query's own.

    Returns query_id, rank (from 1), vec_id and score (the cosine in double precision), nearest
    first, ties to the smaller key. The rotation and the radius are learned from at most
    `most_learned` rows; all rows are indexed. Rows of a block within the radius of a query's code
    are compared as floats; a query that finds fewer than k in a block takes the block's rows as a
    whole, so that fewer come back only if there are no more.

    Rows with a null key or an unusable vector (null, zero, null or non-finite components) take no
    part, and vectors of different lengths are never compared. Of equal vectors the k + 1 smallest
    keys can be among a query's k nearest; the others are left out before the search. Rows that
    repeat a key are candidates as they are, but not of a query with that key. An empty table gives
    no rows; other columns are left out.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    # Only the first k + 1 keys of equal vectors matter as candidates, one row of each.
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("same", F.xxhash64(plain))
    equal = Window.partitionBy("same").orderBy("id")
    keys = rows.withColumns({"n": F.dense_rank().over(equal), "before": F.lag("id").over(equal)})
    candidates = cut(keys.where(f"n <= {k + 1} and (before is null or before <> id)").select("id", "v"))
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(most_learned).toPandas()
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tools = {}
    for d, part in sample.groupby(sample["v"].map(len)):
        x = np.stack(part["v"].to_numpy())
        codes = Codes(x)
        tools[int(d)] = (codes, learned_radius(x, codes, k))
    shared = spark.sparkContext.broadcast(tools)

    queries = rows.where("query").select("id", "v")
    n_rows, n_queries = max(1, candidates.count() // ROWS), max(1, queries.count() // QUERIES)
    length = F.size("v").alias("d")
    side = candidates.select("id", "v", length, F.lit(False).alias("query"), F.pmod(F.xxhash64("id"), F.lit(n_rows)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"))
    asks = queries.select("id", "v", length, F.lit(True).alias("query"), F.explode(F.expr(f"sequence(0L, {n_rows - 1}L)")).alias("r"), F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int").alias("q"))

    def search(p: pd.DataFrame) -> pd.DataFrame:
        own, ask = p[~p["query"]].sort_values("id"), p[p["query"]]
        if own.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes, radius = shared.value.get(int(p["d"].iat[0])) or (None, 0)
        x, ids = np.stack(own["v"].to_numpy()), own["id"].to_numpy()
        norm = np.sqrt((x * x).sum(axis=1))
        index = Index(codes(x)) if codes else None
        out = []
        y = np.stack(ask["v"].to_numpy())
        asked = codes(y) if codes else np.zeros((len(y), 1))
        for q, v, c in zip(ask["id"].to_numpy(), y, asked, strict=True):
            near = index.within(c, radius) if index else np.arange(len(x))
            near = near[ids[near] != q]
            if len(near) < k:
                near = np.flatnonzero(ids != q)
            score = (x[near] @ v) / (norm[near] * np.sqrt(v @ v))
            best = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out)

    found = side.unionByName(asks).groupBy("d", "r", "q").applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

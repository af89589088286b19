"""Text quality by naive-Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, text_bytes, tidied, with_column
from .ngram_join import words
from .toxicity import held_out, labelled_sample

SLICE = 1 << 20
#: Labelled rows to learn from, at most; the rows with the smallest key hashes are taken.
MOST_LABELLED = 6_000
#: Lengths of the n-grams of character shapes; each has 2**15 indicators.
GRAMS = (3, 5)
WIDTH = 1 << 15
#: Words repeated so many times in a row, and tenths of words that repeat the one before.
REPEATS = (2, 3, 5, 10)
SIZE = WIDTH * len(GRAMS) + len(REPEATS) + 11


def shapes() -> np.ndarray:
    """Byte to one of 32 shapes: letters, capitals, digits, space, line end, and 27 for other signs."""
    c = np.array([5 + k % 27 for k in range(256)])
    c[0x80:] = 0
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[0x20, 0x09, 0x0B, 0x0C]] = 3
    c[[0x0A, 0x0D]] = 4
    return c.astype(np.uint64)


_SHAPE = shapes()


def indicators(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted numbers of the features of each text: shape n-grams and repetitions of words."""
    s = _SHAPE[data]
    codes = []
    for k, n in enumerate(GRAMS):
        code = np.zeros(max(0, len(s) - n + 1), np.uint64)
        for j in range(n):
            code |= s[j : len(s) - n + 1 + j] << np.uint64(5 * j)
        codes.append((mixed(code) >> np.uint64(49)).astype(np.int64) + k * WIDTH if n > 3 else code.astype(np.int64))
    w, at = words(data, bounds)
    same = np.concatenate([[False], w[1:] == w[:-1]]) if len(w) else np.zeros(0, bool)
    mark = np.zeros(SIZE, bool)
    out = []
    for d in range(len(bounds) - 1):
        for code, n in zip(codes, GRAMS, strict=True):
            mark[code[bounds[d] : max(bounds[d], bounds[d + 1] - n + 1)]] = True
        again = same[at[d] + 1 : at[d + 1]]
        if len(again):
            base = WIDTH * len(GRAMS)
            mark[base + len(REPEATS) + int(10 * again.mean())] = True
            if again.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
                most = int((edge[1::2] - edge[::2]).max()) + 1
                mark[base : base + sum(most >= r for r in REPEATS)] = True
        own = np.flatnonzero(mark)
        mark[own] = False
        out.append(own)
    return out


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """ln of a feature's share among good texts over its share among bad ones."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, good, strict=True) if y == side] or [np.zeros(0, np.int64)]), minlength=SIZE) + smooth for side in (True, False)]
    p, q = (c / c.sum() for c in counts)
    return np.log(p / q)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Weights of the linear hinge-loss model, one dual variable at a time, features scaled; the last is the bias."""
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    unit = [1.0 / max(1e-9, np.sqrt((scale[r] ** 2).sum())) for r in rows]
    x = [scale[r] * u for r, u in zip(rows, unit, strict=True)]
    q = np.array([(v * v).sum() + 1.0 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            step = y[i] * (w[rows[i]] @ x[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - step / q[i], 0.0), c)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[rows[i]] += d * x[i]
                w[-1] += d
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 2.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


class Model:
    """A score for each list of features; `empty` where there are none."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray):
        keep = np.arange(len(rows)) % 5 > 0
        if len(rows) < 20 or good[keep].all() or not good[keep].any() or not len(rows) - keep.sum():
            share = (good.sum() + 1) / (len(good) + 2)
            self.scale, self.w, self.a, self.b = np.zeros(SIZE), np.zeros(SIZE + 1), 0.0, float(np.log(share / (1 - share)))
            return
        fit = [r for r, k in zip(rows, keep, strict=True) if k]
        self.scale = log_count_ratios(fit, good[keep])
        self.w = dual_descent(fit, np.where(good[keep], 1.0, -1.0), self.scale)
        self.a, self.b = platt(self.margins([r for r, k in zip(rows, keep, strict=True) if not k]), good[~keep])

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        for i, r in enumerate(rows):
            s = self.scale[r]
            out[i] = (self.w[r] @ s) / max(1e-9, np.sqrt(s @ s)) + self.w[-1]
        return out

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(rows) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_labelled: int) -> Model:
    """The model of at most `most_labelled` labelled rows that are not held out."""
    import pandas as pd

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            own = indicators(*text_bytes(pa.array([x.encode() for x in p["_text"]], pa.binary())))
            yield pd.DataFrame({"features": [r.astype(np.int32).tobytes() for r in own], "good": p["_label"] > 0, "order": pd.util.hash_array(p["_text"].to_numpy(object), categorize=False).astype(np.int64)})

    sample = labelled_sample(docs, labels, label, key, text, most_labelled)
    got = sample.mapInPandas(tidied(features), "features binary, good boolean, order long").toPandas().sort_values(["order", "good"])
    return Model([np.frombuffer(x, np.int32).astype(np.int64) for x in got["features"]], got["good"].to_numpy(bool))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED, threshold: float = 0.7) -> DataFrame:
    """Returns key, held_out, score (0 to 1, higher for better texts) and predicted (1 if score >= threshold) of each row.

    The model learns from at most `most_labelled` labelled rows whose crc32(key) mod 4 is not 2; a
    fifth of them sets the curve from margins to scores. Null and empty texts have no features and
    get the score of the bias; without labels of both kinds all scores are the share of good ones.
    Repeated rows are scored alike; a null key is not held out. An empty table gives no rows; other
    columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, most_labelled))
    scored = with_column(docs.select(key, text), text, "score", "double", lambda x: shared.value(indicators(*text_bytes(x))), SLICE)
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

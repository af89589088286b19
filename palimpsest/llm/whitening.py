"""Whitening of embeddings: exact covariances, Householder tridiagonals, Sturm counts, inverse iteration."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bit_planes import finite
from .common import tidied

#: Whole entries beyond this, before the offset, count as this.
MOST = 1 << 40
#: Sums of so many bits are exact in double precision.
EXACT = 53
#: What tasks send: entry (i, j) of a table of sums of vectors of length d.
SENT = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
#: The largest deviation that is told apart.
WIDEST = 10**38 - 1


def entries(x: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64) + offset


def products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exact: in double precision by slices whose sums have at most EXACT bits, else in Python's integers."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    bits = 2 * int(np.abs(y).max(initial=0)).bit_length()
    if bits > EXACT - 1:
        z = y.astype(object)
        return z.T @ z if len(y) else out
    step = 1 << min(20, EXACT - bits)
    for i in range(0, len(y), step):
        z = y[i : i + step].astype(float)
        out += (z.T @ z).astype(np.int64)
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal and unit reflectors of Householder's tridiagonal form of a symmetric matrix."""
    a, reflectors = a.astype(float).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.copysign(np.linalg.norm(v), v[0])
        v[0] += length
        if size := np.linalg.norm(v):
            v /= size
            w = a[k + 1 :, k + 1 :]
            p = w @ v
            p -= (v @ p) * v
            w -= 2 * (np.outer(v, p) + np.outer(p, v))
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            a[k + 1, k] = a[k, k + 1] = -length
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: the eigenvalues smaller than each value, as the negative pivots of T - value."""
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(off).max(initial=0) or 1.0)
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(diagonal)):
        pivot = diagonal[i] - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The `most` largest eigenvalues of the tridiagonal matrix, falling, by bisection of Gershgorin's interval."""
    n = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    wanted = np.arange(n - 1, max(-1, n - 1 - most), -1)  # eigenvalues below the one sought
    low, high = np.full(len(wanted), (diagonal - reach).min()), np.full(len(wanted), (diagonal + reach).max())
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = below(diagonal, off, middle) > wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray) -> np.ndarray:
    """x with (T - at) x = right, by elimination with row exchanges; zero pivots become tiny ones."""
    n = len(diagonal)
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(off).max(initial=0) or 1.0)
    main, up, far, b = diagonal - at, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        under = off[i]
        row = (under, main[i + 1], up[i + 1], b[i + 1])
        if abs(under) > abs(main[i]):
            main[i], up[i], far[i], b[i], row = *row, (main[i], up[i], far[i], b[i])
        pivot = main[i] if main[i] else tiny
        main[i] = pivot
        factor = row[0] / pivot
        main[i + 1], up[i + 1], b[i + 1] = row[1] - factor * up[i], row[2] - factor * far[i], row[3] - factor * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = b[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (far[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / (main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i]))
        if abs(x[i]) > 1e200:  # only the direction counts
            x, b = x / 1e200, b / 1e200
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix for each of its falling eigenvalues, orthogonal within clusters.

    Eigenvalues that follow one another closer than a thousandth of the norm are a cluster: their
    vectors are made orthogonal to those before them in it, at every step.
    """
    n = len(diagonal)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0) or 1.0
    random = np.random.default_rng(11)
    out = np.zeros((len(values), n))
    begin = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            begin = k
        # Equal eigenvalues are parted by a few roundings, so that the solutions differ.
        at = value - (k - begin) * 4 * np.finfo(float).eps * norm
        x = random.standard_normal(n)
        for _ in range(5):
            x = solved(diagonal, off, at, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[begin:k].T @ (out[begin:k] @ x)
        out[k] = x / np.linalg.norm(x)
    return out


def eigenpairs(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = np.abs(v).max(initial=0) or 1.0
    diagonal, off, reflectors = tridiagonal(v / size)
    values = leading(diagonal, off, most)
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        u = reflectors[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ u, u)
    # The Rayleigh quotient of the whole matrix takes off what the reflections rounded.
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.einsum("ki,ij,kj->k", vectors, v, vectors), vectors


class Fit:
    """n, S, the leading eigenpairs and the trace of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], second: np.ndarray, centre: np.ndarray, most: int):
        self.n, self.sums = n, sums
        off = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
        # n^2 V = n sum(y y') - sum(y) sum(y)', y = x - centre: whole numbers, so no digit cancels.
        d = len(sums)
        v = np.array([[float(Fraction(n * int(second[i, j]) - off[i] * off[j], n * n)) for j in range(d)] for i in range(d)]).reshape(d, d)
        self.values, self.vectors = eigenpairs(v, most) if d else (np.zeros(0), np.zeros((0, 0)))
        self.trace = float(np.trace(v))
        # Below this an eigenvalue can't be told from zero.
        self.there = self.values > d * np.finfo(float).eps * max(self.trace, np.finfo(float).tiny)
        self.values = np.where(self.there, self.values, 0.0)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2) of each row, exact."""
        t = self.centred(x)
        if t.dtype == np.int64 and 2 * int(np.abs(t).max(initial=0)).bit_length() + int(t.shape[1]).bit_length() < 63:
            return (t * t).sum(axis=1).tolist()
        return [sum(a * a for a in r) for r in t.astype(object).tolist()]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S."""
        if self.n.bit_length() + int(np.abs(x).max(initial=0)).bit_length() < 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on each component, over the root of its eigenvalue; NaN where that is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((self.centred(x) / self.n).astype(float) @ self.vectors.T) / np.sqrt(self.values)
        return np.where(self.there, out, np.nan)


def whiten(table: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Projects vectors on the leading components of their covariance and scales them to unit variance.

    Rows count whose vector is neither null nor holds null or non-finite entries; each entry c
    becomes the whole number floor(scale * c) + offset. The covariance is over all rows that count,
    with divisor n; its sums are whole numbers and exact, so that no order of tasks and no lost
    executor changes a digit.

    Returns for each row and component (from 1, by falling eigenvalue, as many as `components` or
    the vector's length): key, component, n, deviation (decimal: sum of (n x - S)^2), whitened,
    explained (the eigenvalue's share of the trace) and identity_error (the largest entry of the
    whitened rows' covariance less the identity, over components that have a whitened value).
    Vectors of each length have a fit of their own. Where an eigenvalue is zero (constant or
    dependent entries, fewer rows than entries) whitened is null and explained 0. Empty vectors have
    no component and no row. Rows that repeat count as often as they stand there; null keys stay.
    Whole numbers beyond 2**40 count as that, deviations of over 38 digits as 38 nines. An empty table gives no rows; other columns are left
    out.

    Tasks send sums: a number for each pair of entries, whatever the rows. The driver decomposes one
    matrix for each length.
    """
    spark = table.sparkSession
    rows = table.where(finite(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key).alias("_key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("_v"))
    kind = rows.schema["_key"].dataType.simpleString()
    sent = "d int, i int, j int, total decimal(38,0)"

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each length of the batch's vectors, the rows that have it, and their whole entries."""
        column = b.column("_v")
        width = column.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(width):
            at = np.flatnonzero(width == d)
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield int(d), at, entries(flat.reshape(-1, d), scale, offset)

    def summed(of: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
        out: dict[int, dict[tuple[int, int], int]] = {}
        for r in of.groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
            out.setdefault(r["d"], {})[r["i"], r["j"]] = int(r["total"])
        return out

    def said(total: dict[int, np.ndarray], mirrored: bool) -> pa.RecordBatch:
        """A row for each entry of each length's table of sums; of a mirrored one, for those on and above the diagonal."""
        each = [(d, i, j, Decimal(int(x))) for d, t in total.items() for (i, j), x in np.ndenumerate(t) if i <= j or not mirrored]
        return pa.RecordBatch.from_pylist([dict(zip(("d", "i", "j", "total"), e, strict=True)) for e in each], schema=SENT)

    def first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, at, x in by_length(b):
                # Row 0: how many there are, at 0; row 1: the sums.
                own = total.setdefault(d, np.zeros((2, d), object))
                own[0, 0] += len(at)
                own[1] += x.sum(axis=0)
        yield said(total, False)

    got = summed(rows.mapInArrow(tidied(first_sums), sent))
    counted = {d: (t[0, 0], [t[1, j] for j in range(d)]) for d, t in got.items()}
    centres = {d: np.array([s // n for s in sums], np.int64) for d, (n, sums) in counted.items()}

    def second_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b):
                total[d] = total.get(d, 0) + products(x - centres[d])
        yield said(total, True)

    fits: dict[int, Fit] = {}
    for d, t in summed(rows.mapInArrow(tidied(second_sums), sent)).items():
        second = np.array([[t[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
        fits[d] = Fit(*counted[d], second, centres[d], components)
    shared = spark.sparkContext.broadcast(fits)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b):
                w = np.nan_to_num(shared.value[d].whitened(x))
                total[d] = total.get(d, 0.0) + np.vstack([w.sum(axis=0), w.T @ w])
        each = [{"d": d, "i": i, "j": j, "total": x} for d, t in total.items() for (i, j), x in np.ndenumerate(t)]
        yield pa.RecordBatch.from_pylist(each, schema=SENT.set(3, pa.field("total", pa.float64())))

    moments: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(tidied(check), "d int, i int, j int, total double").groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
        k = len(fits[r["d"]].values)
        moments.setdefault(r["d"], np.zeros((k + 1, k)))[r["i"], r["j"]] = r["total"]
    errors: dict[int, float | None] = {}
    for d, m in moments.items():
        mean = m[0] / fits[d].n  # of rows that are centred already: a few roundings
        off = (m[1:] / fits[d].n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(fits[d].there, fits[d].there)]
        errors[d] = float(np.abs(off).max()) if off.size else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b):
                fit = shared.value[d]
                k = len(fit.values)
                whole = np.repeat(np.arange(len(at)), k)
                deviation = pa.array([Decimal(min(t, WIDEST)) for t in fit.deviations(x)], pa.decimal128(38, 0))
                share = fit.values / fit.trace if fit.trace else np.zeros(k)
                white = fit.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("_key").take(pa.array(at[whole])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(k * len(at), fit.n)),
                        deviation.take(pa.array(whole)), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(share, len(at))), pa.array([errors[d]] * (k * len(at)), pa.float64()),
                    ],
                    names=["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = rows.mapInArrow(tidied(project), f"_key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_key", key)

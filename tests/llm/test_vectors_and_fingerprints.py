"""Whitening, fingerprints and bit-plane clusters against plain versions, with the odd cases of their docstrings."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from palimpsest.llm import bit_planes, queries, simhash, whitening

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<float>, label int, distance string, component int, n long"


def vectors(spark, rows):
    """Vectors with clashing extra columns."""
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS)


def odd_vectors(width, rng):
    good = [(k, [float(x) for x in np.float32(rng.standard_normal(width))]) for k in range(30)]
    bad = [(100, None), (101, []), (102, [None, *good[0][1][1:]]), (103, [NAN, *good[0][1][1:]]), (104, [INF, *good[0][1][1:]]), (105, [-INF, *good[0][1][1:]])]
    return good, bad


# 11. Whitening


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "identity", "two values", "rank one", "zero"])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    q = np.linalg.qr(a)[0]
    v = {"random": a @ a.T, "identity": 3 * np.eye(d), "two values": (q * np.where(np.arange(d) < d // 2, 5.0, 2.0)) @ q.T, "rank one": np.outer(a[0], a[0]), "zero": np.zeros((d, d))}[kind]
    v = (v + v.T) / 2
    e, u = whitening.eigenpairs(v, 8)
    size = max(1e-300, np.abs(v).max())
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:8]).max() < 1e-12 * d * size
    assert np.abs(u @ u.T - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ u.T - u.T * e).max() < 1e-12 * d * size


def test_sturm_counts_are_the_eigenvalues_below():
    rng = np.random.default_rng(5)
    diagonal, off = rng.standard_normal(20), rng.standard_normal(19)
    off[7] = 0
    e = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 101)
    assert whitening.below(diagonal, off, at).tolist() == [int((e < x).sum()) for x in at]


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(6)
    for most in (10, 1 << 20, 1 << 25, 1 << 33, 1 << 40):
        y = rng.integers(-most, most + 1, (301, 3))
        z = y.astype(object)
        assert (whitening.products(y) == z.T @ z).all()


def plain_whitened(rows):
    """By numpy, and exact where the contract says so: {id: [(component, n, deviation, |whitened|, explained)]}."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    w = y @ u / np.sqrt(e)
    out = defaultdict(list)
    for (i, _), r, own in zip(rows, x, w, strict=True):
        out[i] += [(k + 1, n, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), abs(own[k]), e[k] / np.trace(y.T @ y / n)) for k in range(len(e))]
    return out


def check_whitened(got, rows):
    want, found = plain_whitened(rows), defaultdict(list)
    for r in got:
        found[r["vec_id"]].append((r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert set(found) == set(want)
    for i, own in found.items():
        for a, b in zip(sorted(own), sorted(want[i]), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6) and a[4] == pytest.approx(b[4], rel=1e-9)


def test_whitening_against_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    got = queries.op11_covariance_whitening(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = got.collect()
    check_whitened(got, rows)
    by = {k: np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == k]) for k in range(1, 9)}
    w = np.stack(list(by.values()))
    assert np.abs(w @ w.T / w.shape[1] - np.eye(8)).max() < 1e-9
    # Any deal of the rows gives the same digits.
    again = whitening.whiten(table.repartition(7, F.col("vec_id") % 5)).collect()
    assert {(r["vec_id"], r["component"]): r["whitened"] for r in got} == {(r["vec_id"], r["component"]): r["whitened"] for r in again}


def test_whitening_of_odd_rows(spark):
    good, bad = odd_vectors(12, np.random.default_rng(1))
    twice = [*good, *good[:10], (None, good[3][1])]
    check_whitened(whitening.whiten(vectors(spark, [*twice, *bad])).collect(), twice)
    # Vectors of another length are a list of their own; fewer entries than components give fewer rows.
    short = [(200 + k, [float(k % 4), float(k % 3)]) for k in range(12)]
    got = whitening.whiten(vectors(spark, [*good, *short])).collect()
    check_whitened([r for r in got if r["vec_id"] < 200], good)
    check_whitened([r for r in got if r["vec_id"] >= 200], short)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, bad)).count() == 0


def test_whitening_without_variance(spark):
    one = whitening.whiten(vectors(spark, [(7, [1.0, 2.0, 3.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(k, 1, 0, None, 0.0, None) for k in (1, 2, 3)]
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1}
    assert {r["vec_id"] for r in line} == set(range(9)) and all(r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whiten(vectors(spark, [(k, [3e38 if k else -3e38, float(k)]) for k in range(4)])).collect()
    assert len(huge) == 8 and all(r["identity_error"] < 1e-6 for r in huge)


# 12. Fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts):
    """xxhash64 of columns: each is hashed with the hash before it as its seed; nulls are passed over."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.to_bytes(4, "little") if isinstance(p, int) else p.encode(), seed)
    return seed


def words_of(text):
    import re

    return re.split(simhash.WHITE, text.lower())


def plain_fingerprint(text):
    total, votes, words = 0, [0] * 128, words_of(text)
    for a, b in zip(words, [*words[1:], None], strict=True):
        weight = min(len(a.encode()), simhash.HEAVIEST)
        total += weight
        for k, h in enumerate((chained(a, b), chained(b, 1, a))):
            for bit in range(64):
                votes[64 * k + bit] += weight * (h >> bit & 1)
    return [sum(1 << bit for bit in range(64) if 2 * votes[64 * k + bit] > total) for k in range(2)]


def plain_fingerprints(rows):
    """All columns of all documents, as a multiset."""
    order = sorted(((i is None, -(i or 0), signed(chained(t or "")), t or "") for i, t in rows))
    prints = {t: plain_fingerprint(t) for _, _, _, t in order}
    near = {t: sum(sum((x ^ y).bit_count() for x, y in zip(prints[t], prints[u[3]], strict=True)) <= simhash.RADIUS for u in order) for t in prints}
    like = lambda a, b: 1 - sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) / 128
    hexed = lambda f: "".join(f"{x:016x}" for x in f)
    out = Counter()
    for (no, i, _, t), (_, _, _, u) in zip(order, [*order[1:], *order[:1]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        f, e, g = prints[t], plain_fingerprint(edited), prints[u]
        out[None if no else -i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e), like(f, e), like(f, g), near[t]] += 1
    return out


def found_fingerprints(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")) for r in df.collect())


def test_fingerprints_against_plain_votes(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op12_simhash_fingerprints(spark, DATA)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    assert found_fingerprints(got) == plain_fingerprints(rows)


def test_fingerprints_of_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    texts = [None, "", "  \n", "one two", "Ä é ß 中文 ñ 😀😀😀", long, "x" * 5000, "ONE two", " one\ttwo ", long + " end"]
    rows = [*enumerate(texts), (3, "one two"), (3, "one two"), (3, "three"), (None, "null key"), (None, "null key"), (None, "other"), (-5, "minus"), (-(2**63), "least"), (2**63 - 1, "most")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"f0": F.lit("x"), "_id": F.lit(1), "n_chars": F.lit(2), "_text": F.lit("y")})
    assert found_fingerprints(simhash.fingerprints(table)) == plain_fingerprints(rows)
    for few in ([], [(4, "alone here")], [(4, "same"), (4, "same")]):
        assert found_fingerprints(simhash.fingerprints(spark.createDataFrame(few, "doc_id long, text string"))) == (plain_fingerprints(few) if few else Counter())


def test_half_a_text_shows(spark):
    got = queries.op12_simhash_fingerprints(spark, DATA).where("n_chars > 400").collect()
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.1


@pytest.mark.parametrize("block", [7, 512])
def test_block_tables_find_all_within_the_radius(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for base in prints[:10]:
        for _ in range(20):
            x = base
            for bit in rng.sample(range(128), rng.randrange(0, 9)):
                x ^= 1 << bit
            prints.append(x)
    # A hot key: many fingerprints with one word in common.
    prints += [(5 << 64) | rng.getrandbits(6) << 40 | rng.getrandbits(3) for _ in range(150)]
    prints += prints[:15]
    low = lambda x: signed(x & (1 << 64) - 1)
    table = spark.createDataFrame([(low(x), low(x >> 64)) for x in prints] + [(None, 3)], "f0 long, f1 long")
    for radius in (0, 3, 6):
        got = {(r["f0"], r["f1"]): r["n_near"] for r in simhash.within(table, radius).collect()}
        assert got == {(low(x), low(x >> 64)): sum((x ^ y).bit_count() <= radius for y in prints) for x in prints}


def test_tables_share_a_key_within_the_radius():
    rng = random.Random(2)
    for n, radius in ((10, 3), (10**6, 3), (10**6, 6), (10**9, 6)):
        masks = [sum(w << (64 * k) for k, w in enumerate(m)) for m in simhash.tables_for(n, radius)]
        assert min(m.bit_count() for m in masks) >= min(128, int(math.log2(n)))
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(128), radius))
            assert any(not x & m for m in masks)


# 13. Bit planes


def plain_clusters(rows, clusters, rounds):
    """(id, cluster, distance, cluster's sum, sum of all, digest) of each row, with Python's integers."""
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    named = lambda i: "null" if i is None else str(i)
    first = sorted(range(len(x)), key=lambda k: (hashlib.sha256(f"2:{named(rows[k][0])}".encode()).hexdigest(), rows[k][1]))[:clusters]
    centroids = [list(x[k]) for k in first]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for v in x]
        if r < rounds:
            for k in range(len(centroids)):
                if own := [v for v, (_, j) in zip(x, near, strict=True) if j == k]:
                    centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = Counter()
    for d, k in near:
        total[k] += d
    return Counter((i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(rows, near, strict=True))


def found_clusters(df):
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())


def test_popcounts_are_dot_products():
    rng = np.random.default_rng(3)
    for planes in (1, 5, 9, 29):
        x = rng.integers(0, 1 << planes, (50, 64))
        words = bit_planes.packed(x, planes)
        assert (bit_planes.unpacked(words).astype(np.int64) << np.arange(planes)[None, :, None]).sum(axis=1).tolist() == x.tolist()
        assert bit_planes.dots(words, words[7]).tolist() == (x @ x[7]).tolist()
        assert bit_planes.dots(words, words).tolist() == (x * x).sum(axis=1).tolist()
        cluster = rng.integers(0, 4, 50)
        assert bit_planes.sums(words, cluster, 6).tolist() == [x[cluster == k].sum(axis=0).tolist() for k in range(6)]


def test_clusters_against_plain_rounds(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert found_clusters(queries.op13_bit_plane_clusters(spark, DATA)) == plain_clusters(rows, 40, 5)


def test_clusters_of_odd_rows(spark):
    good, bad = odd_vectors(64, np.random.default_rng(2))
    bad += [(106, good[0][1][:63]), (107, [*good[0][1], 1.0])]
    # Repeated rows, a null key, and a group of equal vectors of a third of all rows: ties for the smaller number, empty clusters.
    rows = [*good, *good[:7], (None, good[4][1]), *((300 + k, good[5][1]) for k in range(20))]
    assert found_clusters(bit_planes.cluster(vectors(spark, [*rows, *bad]), clusters=12)) == plain_clusters(rows, 12, 5)
    assert found_clusters(bit_planes.cluster(vectors(spark, good[:3]))) == plain_clusters(good[:3], 40, 5)
    same = [(k, good[0][1]) for k in range(5)]
    assert found_clusters(bit_planes.cluster(vectors(spark, same))) == plain_clusters(same, 40, 5)
    assert bit_planes.cluster(vectors(spark, [])).count() == 0
    assert bit_planes.cluster(vectors(spark, bad)).count() == 0


def test_clusters_of_huge_entries(spark):
    rows = [(k, [3e38 * (-1) ** k] * 64) for k in range(6)]
    got = bit_planes.cluster(vectors(spark, rows), clusters=1).collect()
    assert len(got) == 6 and {r["inertia"] for r in got} == {min(2**63 - 1, sum(r["distance"] for r in got))}

"""Exact Jaccard self-join of word n-gram sets, by T-occurrence search over inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, cut, dealt, mixed, pieces, slices, text_bytes, tidied
from .components import connected_components

SLICE = 2 << 20
#: Input bytes for each bucket of hashes.
BUCKET = 10 << 20
#: Rows of a group that are searched by one task; larger groups are dealt into chunks that share one member.
CHUNK = 64
#: Bytes of a shingle's hash that are kept inside its bucket; the bucket says up to fifteen bits more.
ID_BYTES = 6
#: Rows of a token that meet in one task; those of a token with more go in pairs of blocks.
TOKEN_BLOCK = 512
#: At most so many groups count as large, which bounds what is broadcast.
MOST_LARGE = 500_000
#: Min-hash keys of the first, coarse round.
KEYS = 2
#: DivideSkip's weight of a probe against a merged posting.
MU = 0.01

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin in them (n + 1 offsets)."""
    data = _LOWER[data]
    ink = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])))
    end = np.flatnonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]]))) + 1
    return Rolling(data).of(begin, end), np.searchsorted(begin, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles, and n + 1 offsets.

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    w, at = words(data, bounds)
    factor = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.diff(at)
    full = np.zeros(len(w), np.uint64)
    for j in range(n):
        full[: max(0, len(w) - n + 1)] += w[j : max(j, len(w) - n + 1 + j)] * factor[j]
    full = mixed(full)
    out, sizes = [], np.zeros(len(count), np.int64)
    for k, c in enumerate(count):
        if c >= n:
            h = np.sort(full[at[k] : at[k + 1] - n + 1])
            h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif c:
            h = mixed((w[at[k] : at[k + 1]] * factor[:c]).sum(keepdims=True) + np.uint64(c))
        else:
            continue
        out.append(h)
        sizes[k] = len(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of these sizes are similar enough: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, occurrences) of all members of at least `least` of the sorted lists, in order.

    The longest lists are set aside and only probed by binary search; the others are merged on a
    heap, on which members that can't occur often enough are skipped.
    """
    lists = sorted((x for x in lists if x), key=len)
    if not lists or len(lists) < least:
        return
    aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    long = lists[len(lists) - aside :]
    short = lists[: len(lists) - aside]
    enough = least - len(long)
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= enough:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        seen = len(popped)
        if seen >= enough:
            for x in long:
                i = bisect_left(x, top)
                seen += i < len(x) and x[i] == top
            if seen >= least:
                yield top, seen
            after = top + 1
        else:
            while heap and len(popped) < enough - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            after = heap[0][0]
        for _, k, i in popped:
            i = bisect_left(short[k], after, i)
            if i < len(short[k]):
                heapq.heappush(heap, (short[k][i], k, i))


def forest(names: list[int], sizes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar members: each member is searched in the inverted lists of those not larger.

    Members that are joined already are not compared again.
    """
    order = sorted(range(len(names)), key=lambda k: (sizes[k], names[k]))
    names, sizes, sets = [names[k] for k in order], [sizes[k] for k in order], [sets[k] for k in order]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.lexsort((owner, flat))
    _, first = np.unique(flat[by], return_index=True)
    member = owner[by].tolist()
    lists = {int(flat[by[i]]): member[i:j] for i, j in zip(first, [*first[1:], len(by)], strict=True) if j - i > 1}
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for q in range(1, len(names)):
        low = bisect_left(sizes, -(-percent * sizes[q] // 100), 0, q)
        if low == q:
            continue
        apart = {root(i) for i in range(low, q)}
        own = []
        for t in sets[q].tolist():
            x = lists.get(t)
            if x and x[0] < q:
                i, j = bisect_left(x, low), bisect_left(x, q)
                if i < j:
                    own.append(x[i:j])
        for c, overlap in divide_skip(own, needed(sizes[q], sizes[low], percent)):
            r = root(c)
            if r in apart and overlap >= needed(sizes[q], sizes[c], percent):
                links.append((names[q], names[c]))
                parent[r] = root(q)
                apart.discard(r)
                if not apart:
                    break
    return links


def _binary(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _packed(ids: np.ndarray) -> bytes:
    """The lower ID_BYTES bytes of each id."""
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()


def _ids(table: pa.Table) -> list[np.ndarray]:
    out = []
    for x in table.column("ids"):
        raw = np.frombuffer(x.as_py() or b"", np.uint8).reshape(-1, ID_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :ID_BYTES] = raw
        out.append(wide.view("<u8").ravel())
    return out


def _all(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", kind) for x in table.column(name)]


def shared_sets(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members has key, sig and n for each row, sig being a hash of its whole set (null: empty).

    sets has a row for each distinct set of which at least `percent` of the shingles occur in
    another set too, the only ones that can have a partner: sig, n, and ids of those shingles in
    order of their document frequency, rarest first.
    """
    buckets = pieces(docs, BUCKET)
    a_schema = "bucket int, sigs binary, ns binary, counts binary, ids binary, _key long, sig long, n long"
    a_arrow = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "ns", "counts", "ids")), *((c, pa.int64()) for c in ("_key", "sig", "n"))])

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            h, at = shingle_sets(*text_bytes(part.column("_text")), n)
            size = np.diff(at)
            begin = np.minimum(at[:-1], max(0, len(h) - 1))
            sums = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin) if len(h) else np.zeros(len(size), np.uint64)
            sig = mixed(sums + size.astype(np.uint64)).astype(np.int64)
            rows = [(-1 - k % buckets, None, None, None, None, x, int(s) if c else None, int(c)) for k, (x, s, c) in enumerate(zip(part.column("_key").to_pylist(), sig, size, strict=True))]
            _, once = np.unique(sig, return_index=True)
            once = np.sort(once[size[once] > 0])
            own = np.zeros(len(size), bool)
            own[once] = True
            h = h[np.repeat(own, size)]
            doc = np.repeat(np.arange(len(once)), size[once])
            place = ((h >> np.uint64(8 * ID_BYTES)) % np.uint64(buckets)).astype(np.int64) if buckets <= 1 << 15 else (mixed(h) % np.uint64(buckets)).astype(np.int64)
            for b, here in dealt(place):
                d, count = np.unique(doc[here], return_counts=True)
                rows.append((b, _binary(sig[once[d]], "<i8"), _binary(size[once[d]], "<i4"), _binary(count, "<i4"), _packed(h[here]), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), a_arrow, strict=True)], schema=a_arrow)

    b_schema = "part int, bucket int, sigs binary, ns binary, counts binary, ids binary, dfs binary, _key long, sig long, n long"
    b_arrow = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "ns", "counts", "ids", "dfs")), *((c, pa.int64()) for c in ("_key", "sig", "n"))])

    def common(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            none = lambda f: pa.nulls(group.num_rows, f.type)
            return pa.table([group.column(f.name) if f.name in ("_key", "sig", "n") else none(f) for f in b_arrow], schema=b_arrow)
        count = np.concatenate(_all(group, "counts", "<i4"))
        sig = np.concatenate(_all(group, "sigs", "<i8"))
        size = np.concatenate(_all(group, "ns", "<i4"))
        ids = np.concatenate(_ids(group))
        doc = np.repeat(np.arange(len(sig), dtype=np.int32), count)
        by = np.argsort(ids, kind="stable")
        same = ids[by][1:] == ids[by][:-1]
        by = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        ids, owner, doc = ids[by], sig[doc[by]], doc[by]
        by = np.lexsort((owner, ids))
        ids, owner, doc = ids[by], owner[by], doc[by]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
        ids, owner, doc = ids[new], owner[new], doc[new]
        _, back, df = np.unique(ids, return_inverse=True, return_counts=True)
        df = df[back] if len(ids) else np.zeros(0, np.int64)
        ids, owner, doc, df = ids[df > 1], owner[df > 1], doc[df > 1], df[df > 1]
        part = owner % buckets
        by = np.lexsort((owner, part))
        ids, owner, doc, df, part = ids[by], owner[by], doc[by], df[by], part[by]
        rows = []
        for p, s in dealt(part):
            own, first, n_each = np.unique(owner[s], return_index=True, return_counts=True)
            rows.append((int(p), bucket, _binary(own, "<i8"), _binary(size[doc[s][first]], "<i4"), _binary(n_each, "<i4"), _packed(ids[s]), _binary(df[s], "<u4"), None, None, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(b_arrow), b_arrow, strict=True)], schema=b_arrow)

    c_arrow = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def whole(group: pa.Table) -> pa.Table:
        count = _all(group, "counts", "<i4")
        sig = np.concatenate([np.repeat(s, c) for s, c in zip(_all(group, "sigs", "<i8"), count, strict=True)])
        size = np.concatenate([np.repeat(s, c) for s, c in zip(_all(group, "ns", "<i4"), count, strict=True)])
        base = group.column("bucket").to_numpy()
        ids = np.concatenate([x.astype(np.int64) | (int(b) % (1 << 15) << 8 * ID_BYTES) for x, b in zip(_ids(group), base, strict=True)])
        df = np.concatenate(_all(group, "dfs", "<u4"))
        by = np.lexsort((ids, df, sig))
        sig, size, ids = sig[by], size[by], ids[by]
        own, first, got = np.unique(sig, return_index=True, return_counts=True)
        rows = []
        for s, f, c in zip(own.tolist(), first.tolist(), got.tolist(), strict=True):
            total = int(size[f])
            if 100 * c >= percent * total:
                mine = ids[f : f + c]
                keys = [int(mixed(mine.astype(np.uint64) ^ np.uint64(k + 1)).min().astype(np.int64)) for k in range(KEYS)]
                rows.append((s, total, _binary(mine, "<i8"), keys))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, c_arrow, strict=True)], schema=c_arrow)

    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text"))
    found = cut(source.mapInArrow(tidied(scattered), a_schema).groupBy("bucket").applyInArrow(tidied(common), b_schema))
    members = found.where("part is null").select("_key", "sig", "n")
    sets = cut(found.where("part is not null").groupBy("part").applyInArrow(tidied(whole), "sig long, n long, ids binary, keys array<bigint>"))
    return members, sets


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], schema=LINKS)


def coarse_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links found among sets that share a min-hash key; a large group's chunks share the member with the fewest shingles of its own."""
    keyed = sets.select("sig", "n", "ids", F.explode("keys").alias("key"))
    sizes = cut(sets.select("sig", F.col("n") - F.length("ids") / 8, F.explode("keys").alias("key")).toDF("sig", "own", "key").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min_by("sig", F.struct("own", "sig")).alias("lead")).where("rows > 1"))
    most = max(CHUNK, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // MOST_LARGE))
    large = sizes.where(F.col("rows") > most).withColumn("chunks", F.ceil(F.col("rows") / most).cast("int")).drop("rows")
    # Large groups are dealt to their chunks where they are read; only keys of small ones are looked up by a shuffle.
    large = F.broadcast(cut(large))
    own = F.array(F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    chunk = F.explode(F.when(F.col("sig") == F.col("lead"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own))
    dealt_out = keyed.join(large, "key").withColumn("chunk", chunk).drop("chunks", "lead")
    small = keyed.join(large.select("key"), "key", "left_anti").join(sizes.select("key"), "key", "left_semi").withColumn("chunk", F.lit(0))
    keyed = dealt_out.unionByName(small)

    def search(group: pa.Table) -> pa.Table:
        return _links(forest(group.column("sig").to_pylist(), group.column("n").to_pylist(), _all(group, "ids", "<i8"), percent))

    return keyed.select("key", "chunk", "sig", "n", "ids").groupBy("key", "chunk").applyInArrow(search, "a long, b long")


def candidate_pairs(sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that share a shingle early enough in the order of frequency.

    In that order, where the shingles that no other set has come first, the first common shingle of
    two similar sets has all their needed overlap at or after it in both. For the smaller set that
    overlap is at least the one it needs with a set of its own size.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, sig, size, left = [], [], [], []
            for s, n, ids in zip(b.column("sig").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<i8")
                rest = np.arange(len(ids), -(-percent * n // 100) - 1, -1)
                token.append(ids[: len(rest)])
                sig.append(np.full(len(rest), s))
                size.append(np.full(len(rest), n))
                left.append(rest)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (token, sig, size, left)], names=["token", "sig", "n", "left"])

    part = sets.select("sig", "n", "ids").mapInArrow(tidied(prefixes), "token long, sig long, n long, left long")
    part = cut(part.join(component, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    split = cut(part.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"))
    part = part.join(split, "token", "left_semi")
    # Rows of a hot token are dealt to blocks, and each pair of blocks meets once.
    large = cut(part.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > TOKEN_BLOCK).select("token", F.ceil(F.col("rows") / TOKEN_BLOCK).cast("int").alias("blocks")))
    part = part.join(large, "token", "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    a, b = (part.select("token", "lo", "hi", *(F.col(c).alias(f"{c}_{x}") for c in ("sig", "n", "left", "component", "own"))) for x in "ab")
    least = lambda total: F.expr(f"({percent} * ({total}) + {99 + percent}) div {100 + percent}")
    b = b.where(F.col("left_b") >= least("2 * n_b"))
    larger = "(n_a > n_b or (n_a = n_b and sig_a < sig_b)) and component_a <> component_b"
    pairs = a.join(b, ["token", "lo", "hi"]).where("lo = hi or own_a <> own_b").where(larger).where(F.least("left_a", "left_b") >= least("n_a + n_b"))
    return pairs.select("sig_a", "sig_b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("sig", "n", "ids"))) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            columns = [t.column(c).to_pylist() for c in ("sig_a", "sig_b", "n_a", "n_b", "ids_a", "ids_b")]
            rows = [(p, q) for p, q, m, n, x, y in zip(*columns, strict=True) if len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True)) >= needed(m, n, percent)]
            yield pa.RecordBatch.from_arrays(_links(rows).combine_chunks().columns and [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], schema=LINKS)

    both = pairs.join(a, "sig_a").join(b, "sig_b")
    return both.select("sig_a", "sig_b", "n_a", "n_b", "ids_a", "ids_b").mapInArrow(tidied(check), "a long, b long")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Components of texts whose sets of n-word shingles have a Jaccard similarity of at least percent / 100.

    Texts are lower-cased (A-Z) and split at ASCII white space. Returns key, n_shingles and
    component_id (the smallest key reachable by links, itself included), a row for each row.

    Equal sets are one member. Shingles that no other set has can't be shared, so that only sets of
    which enough shingles are shared go on. A first round searches the members of each min-hash
    group by T-occurrence; where members of different components still share a shingle of their
    prefixes, pairs are compared one by one, so that no link is lost.

    Null and empty texts and such of white space alone have n_shingles 0 and link with nothing; a
    null key has a null component. Repeated rows are members of one set. An empty table gives no
    rows; other columns are left out.
    """
    members, sets = shared_sets(docs, key, text, n, percent)
    links = cut(coarse_links(sets, percent))
    found = cut(connected_components(links).select(F.col("node").alias("sig"), "component"))
    more = cut(verified(candidate_pairs(sets, found, percent), sets, percent))
    if more.head(1):
        found = cut(connected_components(links.union(more)).select(F.col("node").alias("sig"), "component"))
    least = members.where("sig is not null and _key is not null").groupBy("sig").agg(F.min("_key").alias("_least")).join(found, "sig", "left")
    least = least.withColumn("component", F.coalesce("component", "sig"))
    tops = cut(least.groupBy("component").agg(F.min("_least").alias("_top")))
    by_sig = cut(least.select("sig", "component")).join(tops, "component").select("sig", "_top")
    out = members.join(cut(by_sig), "sig", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("_key").isNotNull(), F.coalesce("_top", "_key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The row with the smallest key of each component of similar texts, with all its columns.

    Rows with a null key stay as they are; of rows that repeat a kept key and its text, one stays.
    """
    found = similar_texts(docs, key, text, n, percent)
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("_record"), F.col(key).alias("_key"), F.xxhash64(text).alias("_same"))
    once = rows.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key", "_same"])
    out = once.select("_record").unionByName(rows.where("_key is null").select("_record"))
    return out.select(*(F.col(f"_record.`{c}`").alias(c) for c in docs.columns))

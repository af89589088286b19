"""Removal of long byte strings that occur more than once in a corpus, by anchors, suffix order and exact comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import window_anchors
from .common import Rolling, cut, dealt, input_bytes, slices, text_bytes, tidied
from .suffix import common_prefixes, suffix_order

SLICE = 1 << 20
#: Bytes of a gram: its smallest hash in a window is the window's anchor.
GRAM = 100
#: Bytes of a block, the suffix order's symbol.
BLOCK = 50
#: Input bytes for each bucket of anchors, and of contexts.
BUCKET, CONTEXTS = 16 << 20, 4 << 20
#: Contexts of one anchor that a task orders; the windows of anchors with more are counted by hash.
MOST_CONTEXTS = 256


def _ints(x: np.ndarray, kind: str = "<i4") -> bytes:
    return x.astype(kind).tobytes()


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in a sorted array."""
    edge = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], edge + 1])], starts[np.concatenate([edge, [len(starts) - 1]])]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def repeated_anchors(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(sig, hash, pos, first, last) of all anchors whose gram occurs elsewhere too, for texts (sig, text).

    Windows known as repeated from their own text alone have no hash and no pos.
    """
    gram = min(GRAM, max(1, length // 4))
    a = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("hashes", pa.binary()), ("pos", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sig = part.column("sig").to_numpy()
            _, once = np.unique(sig, return_index=True)
            part = part.take(pa.array(np.sort(once)))
            sig = part.column("sig").to_numpy()
            data, bounds = text_bytes(part.column("text"))
            text, pos, h, first, last, done = window_anchors(data, bounds, length, gram)
            place = (h % np.uint64(buckets)).astype(np.int64)
            rows = []
            for b, k in dealt(place):
                base = bounds[text[k]]
                rows.append((b, _ints(sig[text[k]], "<i8"), _ints(h[k], "<u8"), _ints(pos[k] - base), _ints(first[k] - base), _ints(last[k] - base)))
            if len(done):
                own = np.searchsorted(bounds, done, side="right") - 1
                for d in np.unique(own):
                    lo, hi = _runs(done[own == d] - bounds[d])
                    rows.append((-1 - int(d) % buckets, _ints(np.full(len(lo), sig[d]), "<i8"), None, None, _ints(lo), _ints(hi)))
            if rows:
                yield _batch(rows, a)

    b = pa.schema([(c, pa.int64()) for c in ("sig", "hash")] + [(c, pa.int32()) for c in ("pos", "first", "last")])

    def common(group: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(c)])
        sig, first, last = get("sigs", "<i8"), get("first", "<i4"), get("last", "<i4")
        if group.column("bucket")[0].as_py() < 0:
            return pa.table([pa.array(sig), pa.nulls(len(sig), pa.int64()), pa.nulls(len(sig), pa.int32()), pa.array(first), pa.array(last)], schema=b)
        h, pos = get("hashes", "<u8"), get("pos", "<i4")
        by = np.lexsort((pos, sig, h))
        h, sig, pos, first, last = h[by], sig[by], pos[by], first[by], last[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (pos[1:] != pos[:-1])
        h, sig, pos, first, last = h[new], sig[new], pos[new], first[new], last[new]
        same = h[1:] == h[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.table([pa.array(x[many]) for x in (sig, h.astype(np.int64), pos, first, last)], schema=b)

    rows = texts.mapInArrow(tidied(scattered), "bucket int, sigs binary, hashes binary, pos binary, first binary, last binary")
    return rows.groupBy("bucket").applyInArrow(tidied(common), "sig long, hash long, pos int, first int, last int")


FOUND = pa.schema([("sig", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary())])
FOUND_SQL = "sig long, lo binary, hi binary"


def _found(sig: np.ndarray, start: np.ndarray) -> pa.Table:
    """Runs of repeated windows, by text."""
    by = np.lexsort((start, sig))
    sig, start = sig[by], start[by]
    rows = []
    edge = np.flatnonzero(np.diff(sig)) + 1
    for i, j in zip([0, *edge], [*edge, len(sig)], strict=True):
        if j > i:
            lo, hi = _runs(start[i:j])
            rows.append((int(sig[i]), _ints(lo), _ints(hi)))
    return _table(rows, FOUND)


def ordered_windows(group: pa.Table, length: int) -> pa.Table:
    """The windows of some anchors' contexts that occur twice, from the suffix order of the contexts' blocks.

    Blocks lie at fixed distances from the anchor, so that equal windows share the blocks inside
    them. Where a suffix shares so many blocks with a neighbour in the order, the windows around it
    are compared as a whole.
    """
    block = min(BLOCK, max(1, length // 8))
    inner = (length - block + 1) // block
    texts = group.column("context").to_pylist()
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    off = group.column("off").to_numpy().astype(np.int64)
    head = off % block
    n = np.maximum(0, (size - head) // block)
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = base[row] + head[row] + k * block
    r = Rolling(data)
    _, name = np.unique(r.of(begin, begin + block), return_inverse=True)
    # A different end for each context, smaller than all blocks.
    at = np.arange(len(row)) + row
    symbols = np.zeros(len(row) + len(texts), np.int64)
    symbols[at] = name.ravel() + len(texts)
    symbols[np.cumsum(n) + np.arange(len(texts))] = np.arange(len(texts))
    symbols = symbols.tolist()
    order = suffix_order(symbols)
    shared = np.array([*common_prefixes(symbols, order), 0])
    near = np.zeros(len(symbols), bool)
    near[order] = np.maximum(shared[:-1], shared[1:]) >= inner
    hit = begin[near[at]]
    windows = np.zeros(len(data) + 1, np.int64)
    np.add.at(windows, np.maximum(hit - block + 1, base[row[near[at]]]), 1)
    np.add.at(windows, hit + 1, -1)
    start = np.flatnonzero(np.cumsum(windows)[:-1] > 0)
    own = np.searchsorted(base, start, side="right") - 1
    inside = start + length <= base[own] + size[own]
    start, own = start[inside], own[inside]
    _, back, count = np.unique(r.of(start, start + length), return_inverse=True, return_counts=True)
    twice = count[back.ravel()] > 1 if len(start) else np.zeros(0, bool)
    own, start = own[twice], start[twice]
    return _found(group.column("sig").to_numpy()[own], group.column("first").to_numpy()[own] + start - base[own])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, sig, more and text (binary, null: empty) of each row; sig and more are two hashes of the text."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(key).alias("_key"), body.alias("text")).withColumns({"sig": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")})


def repeated_starts(rows: DataFrame, length: int, size: int) -> DataFrame:
    """(sig, more, text, copies, arrays, plain) of each different text in rows (_key, sig, more, text) that repeats anything.

    arrays and plain hold the runs of starts of strings of `length` bytes that start anywhere else
    too; copies, the rows that have this text: above one, all of it repeats. The number of groups
    follows from `size`, the bytes of the texts.
    """
    long = rows.where(F.length("text") >= length)
    copies = cut(long.groupBy("sig", "more").agg(F.count(F.lit(1)).alias("copies"), F.min("_key").alias("_own")))
    anchors = cut(repeated_anchors(long.select("sig", "text"), length, max(8, -(-size // BUCKET))))
    # One row of each text with repeated anchors, or of which there are copies.
    marks = anchors.groupBy("sig").agg(F.collect_list(F.struct("hash", "pos", "first", "last")).alias("anchors"))
    wanted = copies.join(marks, "sig", "left").where("copies > 1 or anchors is not null")
    own = long.join(wanted, ["sig", "more"]).where(F.col("_key").eqNullSafe(F.col("_own")))
    held = cut(own.select("sig", "more", "text", "copies", "anchors").dropDuplicates(["sig", "more"]))

    # Anchors' contexts, the equal ones together.
    c = pa.schema([("sig", pa.int64()), ("hash", pa.int64()), ("off", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("content", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            data, bounds = text_bytes(part.column("text"))
            r = Rolling(data)
            rows = []
            for sig, b, own in zip(part.column("sig").to_pylist(), bounds[:-1].tolist(), part.column("anchors").to_pylist(), strict=True):
                seen = {(x["hash"], x["pos"], x["first"], x["last"]) for x in own or [] if x["hash"] is not None}
                rows += [(sig, h, p - f, f, z, (b + f, b + z + length)) for h, p, f, z in seen]
            if rows:
                span = np.array([x[5] for x in rows])
                content = r.of(span[:, 0], span[:, 1]).astype(np.int64).tolist()
                yield _batch([(*x[:5], y) for x, y in zip(rows, content, strict=True)], c)

    occurs = cut(held.where("anchors is not null").select("sig", "text", "anchors").mapInArrow(tidied(digests), "sig long, hash long, off int, first int, last int, content long"))
    same = ["hash", "off", "content"]
    classes = cut(occurs.withColumn("size", F.col("last") - F.col("first")).groupBy(*same, "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sig", "first")).alias("lead")))
    whole = occurs.withColumn("size", F.col("last") - F.col("first")).join(classes.where("n > 1").select(*same, "size"), [*same, "size"], "left_semi")
    by_anchor = cut(classes.groupBy("hash").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"))
    leads = classes.select("hash", "off", "size", "lead.sig", "lead.first").join(by_anchor, "hash")
    pick = cut(leads.groupBy("sig").agg(F.collect_list(F.struct("hash", "off", "first", "size", (F.col("contexts") > MOST_CONTEXTS).alias("large"))).alias("picked")))
    picked = held.select("sig", "text").join(pick, "sig")
    groups = max(8, -(-size // CONTEXTS))
    d = pa.schema([("bucket", pa.int32()), ("sig", pa.int64()), ("first", pa.int32()), ("off", pa.int32()), ("context", pa.binary())])
    e = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            rows = [
                (x["hash"] % groups, sig, x["first"], x["off"], t[x["first"] : x["first"] + x["size"] + length])
                for sig, t, own in zip(*(part.column(n).to_pylist() for n in ("sig", "text", "picked")), strict=True)
                for x in own
                if not x["large"]
            ]
            if rows:
                yield _batch(rows, d)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            data, bounds = text_bytes(part.column("text"))
            r = Rolling(data)
            sig, start, at = [], [], []
            for s, b, own in zip(part.column("sig").to_pylist(), bounds[:-1].tolist(), part.column("picked").to_pylist(), strict=True):
                for x in own:
                    if x["large"]:
                        w = np.arange(x["first"], x["first"] + x["size"] + 1)
                        start.append(w)
                        at.append(b + w)
                        sig.append(np.full(len(w), s))
            if not sig:
                continue
            sig, start, at = (np.concatenate(x) for x in (sig, start, at))
            h = r.of(at, at + length)
            place = (h % np.uint64(groups)).astype(np.int64)
            yield _batch([(b, _ints(sig[k], "<i8"), _ints(start[k]), _ints(h[k], "<u8")) for b, k in dealt(place)], e)

    def counted(group: pa.Table) -> pa.Table:
        sig, start, h = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(n)]) for n, kind in (("sigs", "<i8"), ("starts", "<i4"), ("hashes", "<u8")))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = count[back.ravel()] > 1
        return _found(sig[twice], start[twice].astype(np.int64))

    small = picked.where(F.exists("picked", lambda x: ~x["large"])).mapInArrow(tidied(contexts), "bucket int, sig long, first int, off int, context binary")
    large = picked.where(F.exists("picked", lambda x: x["large"])).mapInArrow(tidied(hashed), "bucket int, sigs binary, starts binary, hashes binary")
    found = small.groupBy("bucket").applyInArrow(tidied(lambda g: ordered_windows(g, length)), FOUND_SQL)
    found = found.union(large.groupBy("bucket").applyInArrow(tidied(counted), FOUND_SQL))
    runs = found.groupBy("sig").agg(F.collect_list(F.struct("lo", "hi")).alias("arrays"))
    plain = whole.select("sig", "first", "last").union(anchors.where("hash is null").select("sig", "first", "last"))
    plain = plain.groupBy("sig").agg(F.collect_list(F.struct("first", "last")).alias("plain"))

    marked = held.select("sig", "more", "text", "copies").join(runs, "sig", "left").join(plain, "sig", "left")
    return marked.where("copies > 1 or arrays is not null or plain is not null")


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<begin: long, end: long>>"


def _spans(text: bytes, copies: int, arrays: list | None, plain: list | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by repeated strings."""
    if copies > 1:
        return [(0, len(text))]
    pairs = [(x["first"], x["last"]) for x in plain or []]
    for x in arrays or []:
        pairs += zip(np.frombuffer(x["lo"], "<i4").tolist(), np.frombuffer(x["hi"], "<i4").tolist(), strict=True)
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(pairs):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], hi + length))
        else:
            spans.append((lo, hi + length))
    return spans


KINDS = {"sig": pa.int64(), "more": pa.int64(), "text": pa.binary(), "copies": pa.int64(), "spans": SPANS, "kept_text": pa.string()}
SQL_KINDS = {"sig": "long", "more": "long", "text": "binary", "copies": "long", "spans": SPANS_SQL, "kept_text": "string"}


def _schema(names: list[str]) -> tuple[pa.Schema, str]:
    return pa.schema([(c, KINDS[c]) for c in names]), ", ".join(f"{c} {SQL_KINDS[c]}" for c in names)


def with_spans(marked: DataFrame, length: int, keep: list[str], words: int = 0) -> DataFrame:
    """The columns `keep` of `repeated_starts` and spans, the runs of repeated bytes with `words` words at least; texts without one go.

    Among `keep`, kept_text is the text outside of the spans, without what is left of a character cut in two.
    """
    schema, sql = _schema([*keep, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            spans, texts, stay = [], [], []
            for k, x in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "copies", "arrays", "plain")), strict=True)):
                own = [(b, e) for b, e in _spans(*x, length) if not words or len(x[0][b:e].split()) >= words]
                if own:
                    spans.append([{"begin": b, "end": e} for b, e in own])
                    stay.append(k)
                    if "kept_text" in keep:
                        texts.append(_outside(x[0], own).decode(errors="ignore"))
            if stay:
                own = part.take(pa.array(stay))
                columns = [pa.array(texts, pa.string()) if c == "kept_text" else own.column(c).cast(KINDS[c]) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPANS)], schema=schema)

    return marked.mapInArrow(tidied(run), sql)


def _outside(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))


DIGESTS = pa.schema([("_sig", pa.int64()), ("_more", pa.int64()), ("_removed", pa.int64()), ("_spans", pa.int64()), ("_sha", pa.string()), ("_passage", pa.int64())])


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, passage: int = 220, words: int = 50) -> DataFrame:
    """What remains of each text without repeated strings, as numbers and a digest.

    Returns key, n_bytes, n_removed, n_spans and kept_sha256 for each row; see `remove_repeats`.
    n_passage counts the bytes of shorter repeated passages too: runs of `words` words and more that
    are covered by strings of `passage` bytes which also start elsewhere. A string of `length`
    bytes can repeat only inside such runs of bytes, so that the second search reads these alone.
    """
    rows = _texts(docs, key, text)
    short = min(passage, length)
    runs = cut(with_spans(repeated_starts(rows, short, input_bytes(docs)), short, ["sig", "more", "text", "copies"]))
    long = runs.select("sig", "more", "text", F.explode("spans").alias("_run")).where(F.col("_run.end") - F.col("_run.begin") >= length)
    piece = F.expr("substring(text, cast(_run.begin + 1 as int), cast(_run.end - _run.begin as int))")
    parts = cut(long.select(F.struct("sig", "more", F.col("_run.begin").alias("begin")).alias("_key"), piece.alias("text")).withColumns({"sig": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")}))
    size = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    found = with_spans(repeated_starts(parts, length, size), length, ["sig", "more"])
    moved = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("_key.begin")).alias("begin"), (x["end"] + F.col("_key.begin")).alias("end")))
    found = parts.select("_key", "sig", "more").join(found, ["sig", "more"]).select(F.col("_key.sig").alias("sig"), F.col("_key.more").alias("more"), moved.alias("own"))
    found = found.groupBy("sig", "more").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            out = []
            for sig, more, t, copies, runs, own in zip(*(part.column(c).to_pylist() for c in ("sig", "more", "text", "copies", "spans", "own")), strict=True):
                own = [(x["begin"], x["end"]) for x in own or []]
                if copies > 1 and len(t) >= length:
                    own = [(0, len(t))]
                left = _outside(t, own)
                said = sum(x["end"] - x["begin"] for x in runs if len(t[x["begin"] : x["end"]].split()) >= words)
                out.append((sig, more, len(t) - len(left), len(own), hashlib.sha256(left).hexdigest(), said))
            yield _batch(out, DIGESTS)

    digest = cut(runs.join(found, ["sig", "more"], "left").mapInArrow(tidied(digested), "_sig long, _more long, _removed long, _spans long, _sha string, _passage long"))
    rows = rows.select("_key", "sig", "more", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_whole"))
    # Short texts have hashes of their own, but are never in digest.
    out = rows.join(digest, (rows["sig"] == digest["_sig"]) & (rows["more"] == digest["_more"]) & (F.col("n_bytes") >= short), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        F.col("_key").alias(key), "n_bytes", count("_removed").alias("n_removed"), count("_spans").alias("n_spans"),
        F.coalesce("_sha", "_whole").alias("kept_sha256"), count("_passage").alias("n_passage"),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, words: int = 0) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else in the corpus.

    Texts are taken as UTF-8; strings don't cross texts and are judged on the input. With `words`,
    runs of such bytes with fewer words stay. Returns the table with the remaining text (what is
    left of a character cut in two goes too) and a column `spans` of what was removed (array of
    begin and end, null if nothing).

    Null texts stay null and match nothing, as empty and short ones do. Of texts that occur twice,
    repeated rows included, nothing remains. An empty table gives no rows. Other columns stay,
    but for one named spans, which is replaced.
    """
    marked = repeated_starts(_texts(docs, key, text), length, input_bytes(docs))
    found = cut(with_spans(marked, length, ["sig", "more", "kept_text"], words))
    found = found.select(F.col("sig").alias("_sig"), F.col("more").alias("_also"), F.col("spans").alias("_spans"), "kept_text")
    body = F.col(text).cast("binary")
    own = lambda *x: F.when(F.length(body) >= length, F.xxhash64(*x, body))
    rows = docs.drop("spans").select(F.struct("*").alias("_row"), own().alias("_own"), own(F.lit(1)).alias("_more"), F.col(text).alias("_text"))
    out = rows.join(found, (F.col("_own") == F.col("_sig")) & (F.col("_more") == F.col("_also")), "left")
    left = F.when(F.col("_sig").isNull(), F.col("_text")).otherwise(F.col("kept_text"))
    others = [F.col(f"_row.`{c}`").alias(c) if c != text else left.alias(c) for c in docs.columns if c != "spans"]
    return out.select(*others, F.col("_spans").alias("spans"))

"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius by permuted block tables; DataFrame functions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, input_bytes

#: What parts words, and the bytes of a word that weigh.
WHITE, HEAVIEST = r"[\x20\x09-\x0D]+", 12
#: Words of 64 bits in a fingerprint, and votes that one long counts.
LONGS, LANES = 2, 2
STEPS = 64 // LANES
_LANE = sum(1 << (STEPS * k) for k in range(LANES))
#: Differing bits of fingerprints that count as near.
RADIUS = 6
#: Fingerprints of one side of a comparison: a bucket with more goes in blocks of this size.
BLOCK = 512
#: Bytes of keys that one range of the documents' order holds.
RANGE = 16 << 20
_ALL = (1 << 64) - 1


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def voted(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, f0, f1): the fingerprint's words, a row for each value of `by` that has a word.

    Terms are pairs of following words, lower-cased (the last word's with nothing); each occurrence
    weighs the bytes of its first word, HEAVIEST at most. A term's 128 hashed bits vote for or
    against each bit of the fingerprint; a tie is 0. A long counts the votes of LANES bits, STEPS
    apart: weights of a text sum up to less than its bytes, so no lane runs into the next.
    """
    words = rows.select(*by, F.split(F.lower(F.col(text)), WHITE).alias("_words"))
    each = words.select(*by, "_words", F.posexplode_outer("_words").alias("_at", "_word")).select(
        *by, F.least(F.octet_length("_word"), F.lit(HEAVIEST)).cast("long").alias("_weight"), "_word", F.get("_words", F.col("_at") + 1).alias("_next")
    )
    hashes = [F.xxhash64("_word", "_next"), F.xxhash64("_next", F.lit(1), "_word")]
    each = each.select(*by, "_weight", *(h.alias(f"_h{k}") for k, h in enumerate(hashes[:LONGS])))
    lane = lambda k, s: F.sum(F.shiftrightunsigned(f"_h{k}", s).bitwiseAND(_long(_LANE)) * F.col("_weight"))
    votes = each.groupBy(*by).agg(F.sum("_weight").alias("_all"), *(lane(k, s).alias(f"_v{k}_{s}") for k in range(LONGS) for s in range(STEPS)))

    def word(k: int) -> Column:
        bits = None
        for s in range(STEPS):
            for m in range(LANES):
                count = F.shiftrightunsigned(f"_v{k}_{s}", m * STEPS).bitwiseAND(_long((1 << STEPS) - 1))
                bit = F.when(count * 2 > F.col("_all"), _long(1 << (s + m * STEPS))).otherwise(F.lit(0).cast("long"))
                bits = bit if bits is None else bits.bitwiseOR(bit)
        return bits

    return votes.select(*by, *(word(k).alias(f"f{k}") for k in range(LONGS)))


def hexadecimal(words: list[Column]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(w), 16, "0")) for w in words))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits that differ."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def likeness(a: list[Column], b: list[Column]) -> Column:
    return 1.0 - distance(a, b) / float(64 * len(a))


def tables_for(n: int, radius: int, bits: int = 64 * LONGS) -> list[list[int]]:
    """Masks, one for each permuted table: of so many blocks that the blocks left over by `radius` make a key of log2(n) bits and more.

    Two fingerprints that differ in at most `radius` bits agree in all but `radius` blocks, so in
    the key of at least one table. More blocks make longer keys and more tables.
    """
    blocks = radius + 1
    while bits * (blocks - radius) // blocks < math.log2(n + 1) and math.comb(blocks + 1, radius) <= 1000:
        blocks += 1
    edges = [bits * k // blocks for k in range(blocks + 1)]
    out = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept)
        out.append([(mask >> (64 * k)) & _ALL for k in range(bits // 64)])
    return out


def within(fingerprints: DataFrame, radius: int = RADIUS, count: str | None = None) -> DataFrame:
    """For each distinct fingerprint (f0, f1): n_near, how many rows' fingerprints differ from it in at most `radius` bits, itself included.

    count: a column of how many rows a row stands for. Rows with a null word are left out, and an
    empty table gives no rows. Each table keys the fingerprints by its blocks, and only those of one
    bucket are compared, every one with lists of at most BLOCK others, so that a bucket of any size
    is spread and no pairs are made. A pair counts in the first table whose key it shares.
    """
    words = [f"f{k}" for k in range(LONGS)]
    rows = fingerprints.where(" and ".join(f"{w} is not null" for w in words))
    distinct = cut(rows.groupBy(*words).agg(F.sum(F.col(count) if count else F.lit(1)).cast("long").alias("_n")))
    masks = tables_for(distinct.count(), radius)
    key = lambda m: F.xxhash64(*(F.col(w).bitwiseAND(_long(x)) for w, x in zip(words, m, strict=True)))
    keyed = distinct.select(*words, "_n", F.posexplode(F.array(*(key(m) for m in masks))).alias("_t", "_key"))
    sizes = keyed.groupBy("_t", "_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    met = cut(keyed.join(sizes, ["_t", "_key"]).withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int")))
    part = F.pmod(F.xxhash64(*words), F.col("_blocks")).cast("int")
    lists = met.groupBy("_t", "_key", part.alias("_part")).agg(F.collect_list(F.struct(*words, "_n")).alias("_others"))
    asks = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def first(x: list[Column], y: list[Column]) -> Column:
        """No table before this one holds both."""
        met_before = F.lit(False)
        for t, m in enumerate(masks[:-1]):
            same = F.lit(True)
            for a, b, w in zip(x, y, m, strict=True):
                if w:
                    same = same & (a.bitwiseXOR(b).bitwiseAND(_long(w)) == 0)
            met_before = met_before | ((F.col("_t") > t) & same)
        return ~met_before

    own = [F.col(w) for w in words]
    fields = lambda o: [o[w] for w in words]
    near = lambda o: (distance(own, fields(o)) <= radius) & (distance(own, fields(o)) > 0) & first(own, fields(o))
    found = F.aggregate("_others", F.lit(0).cast("long"), lambda total, o: total + F.when(near(o), o["_n"]).otherwise(F.lit(0).cast("long")))
    counts = asks.join(lists, ["_t", "_key", "_part"]).select(*words, found.alias("_found")).where("_found > 0").groupBy(*words).agg(F.sum("_found").alias("_found"))
    return distinct.join(counts, words, "left").select(*words, (F.col("_n") + F.coalesce("_found", F.lit(0).cast("long"))).alias("n_near"))


def following(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each different (key, text) in falling order of keys, in a ring: _no and _id (the key), _sum (the text's digest), _chars, and those of its neighbours, _after and _before.

    Null keys come last; equal keys follow their texts' digests. Ranges of the order are numbered in
    windows of their own, and the few first and last rows of the ranges tie them together.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(F.col(key).isNull().alias("_no"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(body).alias("_sum"), F.char_length(body).cast("long").alias("_chars"))
    keys = keys.groupBy("_no", "_id", "_sum").agg(F.max("_chars").alias("_chars"))
    keys = keys.withColumn("_falling", F.bitwise_not("_id"))
    order = ["_no", "_falling", "_sum"]
    ranges = max(8, input_bytes(docs) // (8 * RANGE))
    keys = cut(keys.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    row = F.struct(*order, "_id", "_chars")
    window = Window.partitionBy("_range").orderBy(*order)
    ends = keys.groupBy("_range").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    whole = Window.orderBy("_range")  # a row for each range
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_range", F.coalesce(F.lead("_first").over(whole), F.first("_first").over(every)).alias("_onward"), F.coalesce(F.lag("_last").over(whole), F.last("_last").over(every)).alias("_back"))
    keys = keys.withColumns({"_after": F.lead(row).over(window), "_before": F.lag(row).over(window)}).join(ends, "_range")
    return keys.select("_no", "_id", "_sum", "_chars", F.coalesce("_after", "_onward").alias("_after"), F.coalesce("_before", "_back").alias("_before"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints every whole text and its edited text, and compares them.

    The edited text has the text's first code points, and instead of the last floor(n_chars / 2) as
    many of the next document's first ones, or all it has; documents follow one another by falling
    key, after the last comes the first. Returns key, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (32 hexadecimal digits), near_edited and near_next (the share of equal bits
    with the edited text's and the next document's fingerprint) and n_near (rows, itself included,
    whose fingerprints differ in at most `radius` bits), a row for each document.

    A null text counts as empty; a text without words has the fingerprint 0. Null keys come last, and
    rows with equal keys follow their texts' hashes; of rows equal in key and text each is next to
    another of them, but for the last. A single document is its own next. An empty table gives no
    rows; other columns are left out.

    Texts are shuffled once, by key, with the neighbours' keys; then each sends its first code points
    to the document before it. Votes need no further shuffle. Rows equal in key and text are put
    together where they are read.
    """
    at = ["_no", "_id", "_sum"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).isNull().alias("_no"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(body).alias("_sum"), body.alias("_text"))
    texts = rows.groupBy(*at).agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    ring = cut(following(docs, key, text))
    own = texts.join(ring, at)
    half = lambda n: F.floor(n / 2).cast("int")
    # having copies, which all rows do, keeps both uses of the texts alike, so that one shuffle serves both.
    sent = own.where("_copies > 0").select(*(F.col(f"_before.{c}").alias(c) for c in at), F.left("_text", half(F.col("_before._chars"))).alias("_tail"))
    both = own.select(*at, "_text", "_copies", "_chars", F.left("_text", (F.col("_chars") - half(F.col("_chars"))).cast("int")).alias("_head")).join(sent, at)
    edited = F.concat("_head", "_tail")
    repeated = F.concat("_head", F.left("_text", half(F.col("_chars"))))
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit(0).alias("_kind"), F.col("_text").alias("_body"), none.alias("_sha")),
        F.struct(F.lit(1).alias("_kind"), edited.alias("_body"), F.sha2(edited, 256).alias("_sha")),
        F.when(F.col("_copies") > 1, F.struct(F.lit(2).alias("_kind"), repeated.alias("_body"), F.sha2(repeated, 256).alias("_sha"))),
    )
    each = both.select(*at, "_copies", F.explode(kinds).alias("_k")).where("_k is not null").select(*at, "_copies", "_k._kind", "_k._sha", "_k._body")
    found = cut(voted(each, [*at, "_copies", "_kind", "_sha"], "_body"))

    words = [f"f{k}" for k in range(LONGS)]
    of = lambda kind, name: found.where(f"_kind = {kind}").select(*at, *(F.col(w).alias(f"{name}{w}") for w in words))
    cols = lambda name: [F.col(f"{name}{w}") for w in words]
    plain = cut(of(0, "").join(found.where("_kind = 0").select(*at, "_copies"), at))
    near = cut(within(plain, radius, "_copies"))
    nexts = plain.select(*(F.col(c).alias(f"_n{c}") for c in at), *(F.col(w).alias(f"n{w}") for w in words))
    line = ring.select(*at, "_chars", *(F.col(f"_after.{c}").alias(f"_n{c}") for c in at)).join(plain, at).join(nexts, [f"_n{c}" for c in at]).join(near, words)
    changed = found.where("_kind > 0").select(*at, "_kind", "_sha", *(F.col(w).alias(f"e{w}") for w in words))
    out = line.join(changed, at)
    # Of m equal rows, m - 1 have one of themselves next.
    times = F.when(F.col("_kind") == 1, F.lit(1).cast("long")).otherwise(F.col("_copies") - 1)
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    next_words = [F.when(F.col("_kind") == 1, n).otherwise(w) for n, w in zip(cols("n"), cols(""), strict=True)]
    return out.select(
        F.when(~F.col("_no"), F.col("_id")).alias(key), F.col("_chars").alias("n_chars"), F.col("_sha").alias("edited_sha256"),
        hexadecimal(cols("")).alias("fingerprint"), hexadecimal(cols("e")).alias("edited_fingerprint"),
        likeness(cols(""), cols("e")).alias("near_edited"), likeness(cols(""), next_words).alias("near_next"), "n_near",
    )

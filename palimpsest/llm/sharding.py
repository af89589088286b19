"""Weighted rendezvous hashing of record keys over shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, numbered

#: A score's uniform number is made of so many hexadecimal digits (52 bits) of an MD5.
DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the smallest -ln(u) / weight, u being a hash of key and shard in (0, 1).

    A shard of weight w gets its share w / sum(w); a new shard takes keys only into itself, and a
    shard that goes gives its keys to the others. Null keys count as the text 'null'; equal scores
    go to the smaller shard. Weights of 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", text, F.lit(str(shard)))), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))
        return F.struct((-F.ln(u) / F.lit(float(weights[shard]))).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(k) for k in range(len(weights)) if weights[k] > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Puts each record into a shard by its key alone and numbers the records of each shard.

    Returns key, size (bytes of the text plus `overhead`; null text: none), text_crc32, law ('key'),
    shard, slot (gapless from 0 in the shard) and grown_shard (the shard, if one more of weight 1
    stood at the end). Rows with equal keys share a shard; repeated rows get slots of their own. An
    empty table gives no rows; other columns, whatever their names, are left out.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias(key), (F.length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.select(
        key, "size", "text_crc32", F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    parts = max(8, input_bytes(docs) // (len(weights) << 20))
    out = numbered(rows, ["shard"], [key, "text_crc32", "size"], "slot", parts)
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

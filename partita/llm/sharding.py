"""Rendezvous hashing of records over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import fresh


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: each shard draws -ln(u) / weight, u from the hash of key and shard, and the least draw wins.

    A new shard takes only keys for which its own draw is the least, so no key moves between old shards; shard s holds
    weight s of the sum of weights of all keys. A null key is the key "null" of its own.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights have to be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def draw(s: int, w: float) -> Column:
        u = (F.xxhash64(name, F.lit(s)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / w).alias("draw"), F.lit(s).alias("shard"))

    draws = [draw(s, float(w)) for s, w in enumerate(weights)]
    return F.array_min(F.array(*draws))["shard"]


def shard_records(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot and grown_shard of every row.

    size is the bytes of the text (null: none) plus 1. slot numbers the rows of a shard from 0 without gaps, in the order of
    the key's hash; it is counted in two steps (a count per shard and slice of the hash range, then ranks inside the slice),
    so no task holds a shard. grown_shard is the shard with one more of `grown_weight`. Equal rows get slots in any order.
    Null keys form one key. Other columns are ignored; an empty table gives no rows.
    """
    key, order, part = (fresh(docs, n) for n in ("__key", "__order", "__part"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("slot")).alias(order),
    )
    rows = rows.withColumn(part, F.shiftrightunsigned(order, 63 - (buckets - 1).bit_length() + 1).cast("int"))
    # at most shards x slices rows
    counts = rows.groupBy("shard", part).agg(F.count("*").alias(key))
    before = F.sum(key).over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", part, F.coalesce(before, F.lit(0)).alias(key))
    rank = F.row_number().over(Window.partitionBy("shard", part).orderBy(order, "doc_id", "text_crc32", "size"))
    out = rows.join(F.broadcast(counts), ["shard", part]).withColumn("slot", (F.col(key) + rank - 1).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

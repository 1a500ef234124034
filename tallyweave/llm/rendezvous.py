"""Sharding by rendezvous hashing, with DataFrame functions only.

Every (key, shard) pair gets a number u in (0, 1) from md5; the shard with the largest -weight / ln(u) wins. Which
shard wins depends on the key, the shards and their weights alone, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import cut

SHARDS = 16
#: Pieces into which a shard's rows are dealt while slots are counted; each piece is numbered on its own.
PIECES = 1024


def _draw(key: Column, shard: int) -> Column:
    """(n + 1/2) / 2^52 for the first 52 bits n of md5(key:shard)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard for a string key; a null key counts as the empty string."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    key = F.coalesce(key, F.lit(""))
    # of equal scores the lower shard wins
    entries = [F.struct((-F.lit(float(w)) / F.ln(_draw(key, s))).alias("score"), F.lit(-s).alias("low")) for s, w in enumerate(weights)]
    return -F.array_max(F.array(*entries))["low"]


def shard(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, doc_id: str = "doc_id", text: str = "text", pieces: int = PIECES,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    grown_shard is the shard once one more of mean weight exists. Slots number a shard's rows from 0 without gaps:
    rows are numbered inside (shard, piece) and shifted by the pieces before, so no shard passes through one task. A
    null text has size 1 and the CRC of no bytes; rows with a null doc_id are sharded as the empty key, and since a
    piece depends on the text too, they spread over the pieces. Rows alike in every column take neighbouring slots.
    """
    key = F.col(doc_id).cast("string")
    more = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, more).alias("grown_shard"),
    )
    mixed = F.md5(F.concat_ws(":", F.coalesce(key, F.lit("")), "text_crc32", "size").cast("binary"))
    rows = rows.withColumn("piece", F.pmod(F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint"), F.lit(pieces)).cast("int"))
    rows = cut(rows)  # a few dozen bytes a row; the texts are read once
    # at most shards * pieces rows, whatever the input: small enough to broadcast
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )

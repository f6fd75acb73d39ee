"""Rendezvous hashing of record keys over weighted shards; DataFrame functions only.

Each (key, shard) pair gets a pseudo-random draw u in (0, 1) from the key and the shard's
name alone, and the key goes to the shard with the largest -weight / ln(u). A new shard
can only win keys, so nothing moves between the old ones; a shard's share is its weight's.

Cases: a null key is a key of its own ("null"), repeated keys share a shard and take slots
of their own, null or empty texts count one byte, an empty table gives an empty result, and
other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

DRAW = float(1 << 52)


def draw(key: Column, shard: str) -> Column:
    """52 bits of md5(key ':' shard), as a double strictly between 0 and 1."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(DRAW)


def rendezvous(key: Column, weights: Sequence[float], names: Sequence[str] | None = None) -> Column:
    """The position of the winning shard. Ties (same score) go to the earliest shard."""
    names = names or [str(k) for k in range(len(weights))]
    if not names or len(names) != len(weights) or min(weights) <= 0:
        raise ValueError("shards need one positive weight each")
    scores = [F.struct((-F.lit(float(w)) / F.ln(draw(key, n))).alias("s"), F.lit(-k).alias("k")) for k, (n, w) in enumerate(zip(names, weights, strict=True))]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("k")


def slots(df: DataFrame, shard: str, order: Sequence[str], out: str, buckets: int = 4096) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    Rows are ranked within shard x bucket (a hash of the order columns and the row's place, so that
    neither a shard nor a row repeated very often is sorted by one task); the offsets come from the counts, shards x buckets rows at most.
    """
    # a stored table gives a row the same number each time that it is read
    held = stored(df, "shard-rows", compression="zstd").withColumn("_t", F.monotonically_increasing_id())
    cut = held.withColumn("_b", F.pmod(F.xxhash64(*order, "_t"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(shard, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*order, "_t")) - 1)
    return (
        ranked.join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_c")))
        .withColumn(out, (F.col("_r") + F.col("_o")).cast("long"))
        .drop("_b", "_c", "_s", "_o", "_r", "_t")
    )


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard of weight `grown` more)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    placed = keyed.select(
        "*",
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"),
        (rendezvous(F.col("doc_id"), [*weights, grown]).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

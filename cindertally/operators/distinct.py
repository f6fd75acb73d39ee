"""Distinct hashes within a Hamming radius: the first in order stays, later ones near a kept one go."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from ..session import stored

#: Buckets with more hashes than this get longer keys.
LARGE = 4096


def masks(bits: Sequence[int], radius: int) -> list[list[int]]:
    """Bits of every choice of three among radius + 3 bands: two hashes that differ in `radius` bits agree on one of them."""
    if radius == 0 or len(bits) < radius + 3:
        return [list(bits)] if radius == 0 else [[]]
    n = radius + 3
    bands = [list(bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]
    return [sum(c, []) for c in combinations(bands, 3)]


def signed(bits: Sequence[int]) -> int:
    """A mask of these bits as a 64-bit long."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def posted(firsts: DataFrame, radius: int) -> DataFrame:
    """key, hash and bucket of every band choice; overfull buckets are parted again by choices among their other bits."""
    first = masks(range(64), radius)
    own = lambda name, choice: F.struct(F.lit(name).alias("name"), F.col("hash").bitwiseAND(F.lit(signed(choice))).alias("bits"))
    posts = firsts.select("key", "hash", F.explode(F.array(*[own(i, c) for i, c in enumerate(first)])).alias("bucket"))
    posts = stored(posts, "hash-posts", compression="zstd")
    sizes = posts.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    large = stored(sizes.withColumn("large", F.col("n") > LARGE).select(F.col("bucket").alias("_b"), "large"), "hash-buckets", compression="zstd")
    met = posts.join(large, F.col("bucket") == F.col("_b")).drop("_b")
    rest = [masks([b for b in range(64) if b not in c], radius) for c in first]
    finer = F.array(*[F.array(*[F.lit(signed(sorted({*c, *d}))) for d in more]) for c, more in zip(first, rest, strict=True)])
    again = F.transform(F.get(finer, F.col("bucket.name")), lambda m, j: F.struct((F.col("bucket.name") * 1000 + 1000 + j).alias("name"), F.col("hash").bitwiseAND(m).alias("bits")))
    return met.select("key", "hash", F.explode(F.when(F.col("large") & (radius > 0), again).otherwise(F.array("bucket"))).alias("bucket"))


def distinct_within(df: DataFrame, key: str, hash_: str, radius: int, shown: int = 16) -> DataFrame:
    """key, hash of the rows that are kept: going by key, a row stays unless its hash is within `radius` bits of a kept one.

    Equal hashes are one, the earliest. Hashes are posted to buckets of agreeing bits, so that any two
    within the radius share one. In each round every bucket shows its `shown` earliest hashes to all it has: a
    hash of which all earlier ones are seen and none is near is sure to stay, and hashes near a sure one
    go; both leave. So a round costs a row a posting, however many hashes a bucket has, and pairs aren't
    listed. Rounds: about as many as near hashes hang on one another in a row, and as a bucket's hashes
    that stay go into `shown`; a few unless very many share 48 bits. Null hashes and keys are left out.
    """
    whole = df.select(F.col(key).alias("key"), F.col(hash_).cast("long").alias("hash")).filter(F.col("key").isNotNull() & F.col("hash").isNotNull())
    firsts = stored(whole.groupBy("hash").agg(F.min("key").alias("key")), "hash-firsts", compression="zstd")
    posts, gone, me = stored(posted(firsts, radius), "hash-round", compression="zstd"), None, F.struct("key", "hash")
    while radius and posts.limit(1).count():
        early = posts.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "hash"))).filter(F.col("k") <= shown)
        seen = early.groupBy(F.col("bucket").alias("_b")).agg(F.sort_array(F.collect_list(me)).alias("seen")).filter(F.size("seen") > 1)
        seen = stored(seen, "hash-seen", compression="zstd")
        near = F.transform(F.filter("seen", lambda x: (x < me) & (hamming(x.getField("hash"), F.col("hash")) <= radius)), lambda x: x.getField("hash"))
        all_seen = (F.size("seen") < shown) | (me <= F.element_at("seen", -1))
        met = posts.join(seen, F.col("bucket") == F.col("_b")).select("key", "hash", "bucket", near.alias("near"), all_seen.alias("all_seen"))
        met = stored(met, "hash-met", compression="zstd")
        of = met.groupBy("hash").agg(F.min((F.col("all_seen") & (F.size("near") == 0)).cast("int")).alias("sure"))
        sure = stored(of.filter("sure = 1").select("hash"), "hash-sure", compression="zstd")
        lost = met.select(F.col("hash").alias("lost"), F.explode("near").alias("hash")).join(sure, "hash", "left_semi").select(F.col("lost").alias("hash")).distinct()
        lost = stored(lost, "hash-lost", compression="zstd")
        gone = lost if gone is None else gone.unionByName(lost)
        posts = stored(met.select("key", "hash", "bucket").join(sure.unionByName(lost), "hash", "left_anti"), "hash-round", compression="zstd")
    kept = firsts if gone is None else firsts.join(gone, "hash", "left_anti")
    return kept.select(F.col("key").alias(key), F.col("hash").alias(hash_))

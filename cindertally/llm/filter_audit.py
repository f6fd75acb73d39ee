"""Filter interaction audit: what each filter removes, at each step of every order of the filters.

A row is a mask of the filters that it fails. Rows meet in cells (part, mask) with weights, of which
there are 2^filters a part at most. A matrix of masks (0 where the mask fails a filter, else infinite)
and one of positions (the inverse of each order's permutation) are combined by minimum over filters of
the sum: the step that removes a mask in an order. That product is a table of fixed size, masks x
orders x steps, which says for every cell what it adds to each count; the counts are one sum over it.

Rows are read once; what is shuffled of them is a digest, a key, a mask and labels. Texts that stand
more than once are found by counting digests, and only their rows are joined to the first key.

Cases: a null text counts as empty, a null lang as ''. A row without doc_id is no copy and makes none.
Repeated rows (same doc_id) are rows of their own and no copies of each other. Of labels with one doc_id
several times, one 1 is enough. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .columns import words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def removal_steps(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders; the step of each filter in each order (0-based); the step that removes each mask, `filters` if none."""
    orders = list(permutations(range(filters)))
    place = np.argsort(np.array(orders), axis=1)  # the inverse permutations
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    far = np.where(fails == 1, 0, filters)
    return orders, place, np.minimum((far[:, None, :] + place[None, :, :]).min(axis=2), filters)


def scatter_table(spark: SparkSession, names: str) -> DataFrame:
    """mask, filter_order, step, and by 0 or 1 what a row of the mask adds there: 2^n n! n rows."""
    n = len(names)
    orders, place, gone = removal_steps(n)
    mask, order, step = (x.ravel() for x in np.meshgrid(np.arange(1 << n), np.arange(len(orders)), np.arange(n), indexing="ij"))
    filters = np.array(orders)[order, step]
    at = gone[mask, order]
    fails = (mask >> filters) & 1
    removed = (gone[:, :, None] == place[None, :, :]).astype(np.int64) * ((np.arange(1 << n)[:, None, None] >> np.arange(n)) & 1)
    columns = [mask, np.array(["".join(names[k] for k in o) for o in orders])[order], step + 1, at > step, at == step, (fails == 1) & (at < step), mask == 1 << filters, removed.sum(axis=1)[mask, filters]]
    rows = zip(*(c.astype(np.int64).tolist() if c.dtype.kind != "U" else c.tolist() for c in columns), strict=True)
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long")


def interactions(rows: DataFrame, part: str, mask: str, names: str, weights: Sequence[str]) -> DataFrame:
    """Counts by part, order and step; for each weight (a column of 0 or 1) also the weight of what is removed."""
    cells = rows.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(F.count("*").alias("n"), *[F.sum(w).alias(w) for w in weights])
    table = scatter_table(rows.sparkSession, names)
    met = cells.join(F.broadcast(table), "mask")  # of fixed size
    counts = [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")]
    lost = [F.sum(F.col(w) * F.col("removed")).alias(f"{w}_lost") for w in weights]
    return met.groupBy("part", "filter_order", "step").agg(*counts, *lost, F.sum(F.col("n") * F.col("shapley")).alias("shapley"))


def failures(text: Column) -> list[Column]:
    """Short, repetitive, loud, and marked texts."""
    found = words(text)
    return [
        (F.size(found) < 100),
        (100 * F.size(F.array_distinct(found)) < 80 * F.size(found)),
        (100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text)),
        text.rlike("[#$%&*|]"),
    ]


def with_copies(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Adds `copy`: whether a row of smaller key has the same digest.

    The first keys are stored, so that both sides of the join are plain shuffles and a text that very many
    rows hold can be split over tasks.
    """
    known = rows.filter(F.col(key).isNotNull())
    first = known.groupBy(digest).agg(F.min(key).alias("_first"), F.max(key).alias("_last")).filter("_first < _last").select(digest, "_first")
    return rows.join(stored(first, "audit-first", compression="zstd"), digest, "left").withColumn("copy", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over docs: a row for each lang, order and step."""
    text = F.coalesce("text", F.lit(""))
    own = failures(F.col("body"))
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(own)), F.lit(0))
    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", text.alias("body")).select("lang", "doc_id", F.unhex(F.sha2("body", 256)).alias("digest"), bits.alias("bits"))
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flagged = with_copies(stored(read, "audit-rows", compression="zstd"), "digest", "doc_id").join(marked, "doc_id", "left")
    rows = flagged.select("lang", (F.col("bits") + F.when(F.col("copy"), 16).otherwise(0)).cast("int").alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return interactions(rows, "lang", "mask", "ABCDE", ["good", "toxic"])

"""Helpers that several operators share: batch sizes, native word splitting, id bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds Arrow batches, so that very long texts can't fill a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def sliced(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `most` bytes each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        floor = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


BREAKS = "\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null. Cut at one literal space, which needs no pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in BREAKS:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(out, " "), "")


def without_breaks(text: Column) -> Column:
    """The text without the characters that part words."""
    for c in " " + BREAKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Rows of ids that may be broadcast, by count.
BROADCAST_MOST = 1 << 21


def sized(ids: DataFrame, most: int = BROADCAST_MOST) -> DataFrame:
    """ids (a few numbers a row), to be broadcast in a join if there are `most` at most; else to be shuffled."""
    few = ids.limit(most + 1).count() <= most
    return F.broadcast(ids) if few else ids.hint("merge")

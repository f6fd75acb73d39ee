"""Ordered rows: sampling, last-kept dedup, caps, top k, intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordered import met, prefix_sums, starts_of_groups


def kept_places(values: np.ndarray, begins: np.ndarray, last: float | None, threshold: float) -> tuple[np.ndarray, float | None]:
    """Places that the fold keeps, and the last kept value; begins: where groups start, last: the value carried in.

    From each kept value the next one is looked for in windows that double, so that long stretches
    without a change cost vector operations only. Null values (NaN here) are kept only at a group's start.
    """
    out: list[int] = []
    edges = [0, *(int(b) for b in begins if b), len(values)]
    starts = set(begins.tolist())
    for lo, hi in zip(edges, edges[1:], strict=False):
        at = lo
        if lo in starts:
            out.append(lo)
            last, at = float(values[lo]), lo + 1
        while at < hi:
            size, found = 16, -1
            while at < hi:
                part = values[at : min(at + size, hi)]
                far = np.flatnonzero(np.abs(part - last) >= threshold) if last == last else np.flatnonzero(part == part)
                if len(far):
                    found = at + int(far[0])
                    break
                at, size = at + len(part), min(2 * size, 1 << 16)
            if found < 0:
                break
            out.append(found)
            last, at = float(values[found]), found + 1
    return np.array(out, dtype=np.int64), last


def last_kept(df: DataFrame, by: str, order: Sequence[str], value: str, key: str, threshold: float) -> DataFrame:
    """by, key of the rows that differ from the last *kept* row of their group by `threshold` or more.

    Sequential by nature: the rows of a group are sorted within their partition and pass a fold over Arrow
    batches, which carries one value; nothing of a group is held but a batch. The first row of a group is
    kept; a null value is kept only there, and then the first value that isn't null is.
    """
    dealt = df.select(by, *[c for c in order if c not in (by, key)], *([key] if key != by else []), F.col(value).cast("double").alias("_v")).repartition(by).sortWithinPartitions(by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            if batch.num_rows:
                values = batch.column("_v").to_numpy(zero_copy_only=False).astype(np.float64)
                kept, last = kept_places(values, np.flatnonzero(starts_of_groups(batch, [by], before)), last, threshold)
                before = [batch.column(by).slice(batch.num_rows - 1)]
                yield batch.select([by, key]).take(pa.array(kept))

    kind = dict(df.dtypes)
    return dealt.mapInArrow(run, f"`{by}` {kind[by]}, `{key}` {kind[key]}")


def two_level_cap(df: DataFrame, group: str, item: str, available: str, cap: int) -> DataFrame:
    """kept of each item: an even share of the group's cap at most, then what the cap leaves, in order of items.

    Running sums replace the sequential rule: kept = min(cap, S) - min(cap, S before). Items after the
    cap is reached get no row.
    """
    whole = Window.partitionBy(group)
    upto = Window.partitionBy(group).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    share = F.ceil(F.lit(cap) / F.count("*").over(whole))
    own = df.withColumn("_a", F.least(F.col(available), share))
    sums = own.withColumn("_s", F.sum("_a").over(upto))
    kept = F.least(F.lit(cap), F.col("_s")) - F.least(F.lit(cap), F.col("_s") - F.col("_a"))
    return sums.filter(F.col("_s") - F.col("_a") < cap).select(group, item, kept.cast("long").alias("kept"))


def top_per_kind(df: DataFrame, kind: Column, limits: dict[str, int], order: Sequence[str | Column]) -> DataFrame:
    """The first rows of each kind, as many as its limit."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in limits.items()])
    ranked = df.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    return ranked.filter(F.col("k") <= max(limits.values())).filter(F.col("k") <= limit)


def systematic(df: DataFrame, by: Sequence[str], order: Sequence[str], m: int, with_last: bool = False) -> DataFrame:
    """Every max(1, n // m)-th row of a group; the last one too if asked for. Places are prefix sums over ranges."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = met(prefix_sums(df.withColumn("_1", F.lit(1)), by, order, "_1", "_k").drop("_1"), sizes, by)
    keep = F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_n") / m)) == 0
    return ranked.filter(keep | (F.col("_k") == F.col("_n") - 1) if with_last else keep).drop("_n", "_k")


def stride_sample(df: DataFrame, index: str, native: float, fps: float) -> DataFrame:
    """Rows whose index is a multiple of max(1, round(native / fps)); halves round to even."""
    step = max(1, round(native / fps))
    return df.filter(F.col(index) % step == 0)


def numbered(df: DataFrame, order: Sequence[str], out: str = "i") -> DataFrame:
    """Adds the position of each row in a total order, from 0.

    Rows are dealt by range and stored, counted by part, and numbered within their part: no task sees
    them all. The offsets are one row a part.
    """
    held = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = held.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    k = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return held.withColumn("_k", k).join(F.broadcast(offsets), "_p").withColumn(out, (F.col("_k") + F.col("_o")).cast("long")).drop("_p", "_k", "_o")


def page_layout(df: DataFrame, order: Sequence[str], per_page: int, columns: int) -> DataFrame:
    """page, row and column of each row in a grid, and its number padded to five digits or more; order must be total."""
    i = F.col("i")
    made = numbered(df, order)
    return made.select("*", F.floor(i / per_page).cast("long").alias("page"), F.floor(i % per_page / columns).cast("long").alias("r"), (i % per_page % columns).cast("long").alias("c"), F.lpad(i.cast("string"), F.greatest(F.lit(5), F.length(i.cast("string"))), F.lit("0")).alias("serial")).drop("i")


def first_pass_else_best(df: DataFrame, by: Sequence[str], attempt: Sequence[str], score: str, floor: float) -> DataFrame:
    """The first attempt whose score reaches the floor, else the best (earliest of equals); fell_back tells.

    Where attempts aren't unique, the lower score of the same attempt comes first.
    """
    passed = F.col(score) >= floor
    order = F.struct(F.when(passed, 0).otherwise(1).alias("f"), F.when(passed, F.lit(0.0)).otherwise(-F.col(score)).alias("s"), *attempt, F.col(score).alias("_score"))
    got = df.groupBy(*by).agg(F.min(order).alias("_m"))
    return got.select(*by, *[F.col(f"_m.{a}").alias(a) for a in attempt], F.col("_m._score").alias(score), (F.col("_m.f") == 1).alias("fell_back"))


def times_closed(a: Column, b: Column, fps: int) -> Column:
    """Sample times of [a, b] at fps, both ends in: (b - a) fps + 1 of them."""
    return F.transform(F.sequence(F.lit(0), (b - a) * fps), lambda j: a + j / F.lit(float(fps)))


def times_halfopen(a: Column, b: Column, fps: int) -> Column:
    """Sample times of [a, b + 1) at fps: (b - a + 1) fps of them."""
    return F.transform(F.sequence(F.lit(0), (b - a + 1) * fps - 1), lambda j: a + j / F.lit(float(fps)))


def grid_times(duration: Column, stride: int) -> Column:
    """0, stride, ... below duration."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.ceil(duration / stride).cast("int")), lambda j: j * stride), lambda t: t < duration)


def dyadic_cover(a: Column, b: Column, levels: int = 62) -> Column:
    """The fewest aligned ranges of a power of two that make up the whole numbers a to b: (level, place) with place = t >> level.

    Two ranges a level at most: a span of n numbers has under 2 log2(n) + 2.
    """
    low = lambda k: F.shiftright(a + F.shiftleft(F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: F.shiftright(b + 1, k)
    node = lambda k, at: F.struct(F.lit(k).alias("level"), at.alias("place"))
    ends = []
    for k in range(levels):
        open_ = low(k) < high(k)
        ends += [F.when(open_ & (low(k) % 2 != 0), node(k, low(k))), F.when(open_ & (high(k) % 2 != 0), node(k, high(k) - 1))]
    return F.array_compact(F.array(*ends))


def interval_join(points: DataFrame, at: str, spans: DataFrame, closed: bool = True) -> DataFrame:
    """Points within spans (a, b): t <= b, or t < b + 1 if not closed.

    A span becomes the aligned ranges of powers of two that cover it, some 2 log2 of its length, and a point
    those that it lies in, one for each level that some span has: the join is on equal keys, and neither
    long nor short spans cost more than that. Times lie within 2^61; a null time or bound meets nothing.
    """
    end = F.col("b") if closed else F.col("b") + 1
    first, last = F.floor("a").cast("long"), F.floor(end).cast("long")
    top = spans.agg(F.max(last - first)).first()[0]
    if top is None:
        return points.join(spans, F.lit(False))
    levels = max(1, int(top).bit_length() + 1)
    cut = stored(spans.filter("a is not null and b is not null").withColumn("_c", F.explode(dyadic_cover(first, last, levels))), "covers", compression="zstd")
    used = [r["level"] for r in cut.select("_c.level").distinct().collect()]  # 62 at most
    t = F.floor(at).cast("long")
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(t, k).alias("place")) for k in sorted(used)]) if used else F.array().cast("array<struct<level:int,place:bigint>>")
    met = points.filter(F.col(at).isNotNull()).withColumn("_c", F.explode(own)).join(cut, "_c").drop("_c")
    return met.filter((F.col(at) >= F.col("a")) & (F.col(at) <= end if closed else F.col(at) < end))


def nearest_to(df: DataFrame, by: Sequence[str], at: str, target: Column, key: str) -> DataFrame:
    """The row of each group nearest to target; the earliest wins ties."""
    got = df.groupBy(*by).agg(F.min(F.struct(F.abs(F.col(at) - target).alias("gap"), F.col(at).alias("at"), F.col(key).alias("key"))).alias("_m"))
    return got.select(*by, F.col("_m.key").alias(key), F.col("_m.gap").alias("gap"))

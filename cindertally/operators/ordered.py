"""Order statistics without a task that sees a whole group: prefix sums over ranges, exact quantiles by refinement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def starts_of_groups(batch: pa.RecordBatch, by: Sequence[str], before: list[pa.Array] | None) -> np.ndarray:
    """Whether each row's group differs from the row before; before: the last row of the batch before."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = before is None
    for k, c in enumerate(by):
        column = batch.column(c)
        ids = (pa.concat_arrays([before[k], column]) if before else column).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[0 if before else 1 :] |= ids[1:] != ids[:-1]
    return new


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` (not null) over the rows before each row, within its group and in order (ties in no set order).

    Rows are dealt by range of (group, order) and summed within their part in one sorted pass. What the
    parts before add is known from their totals: only groups that reach over several parts have any, two
    rows a part at most, and these are broadcast.
    """
    kind = "double" if dict(df.dtypes)[value] in ("double", "float") else "long"
    dealt = df.withColumn(value, F.col(value).cast(kind)).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_p", F.spark_partition_id())
    number = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, number(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(number)
            begin = np.where(starts_of_groups(batch, by, before), np.arange(len(v)), -1) if by else np.full(len(v), -1)
            begin = np.maximum.accumulate(begin)
            running = np.cumsum(v) - v
            local = running - np.where(begin >= 0, running[begin], -carried)
            before, carried = [batch.column(c).slice(len(v) - 1) for c in by], local[-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*batch.schema.names, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + f", `{out}` {kind}"
    held = stored(dealt.mapInArrow(run, schema), "prefix-sums", compression="zstd")
    totals = held.groupBy(*by, "_p").agg(F.sum(value).alias("_s"))
    parts = totals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", "_s"))).alias("_l")).filter(F.size("_l") > 1)  # one a part
    empty = F.struct(F.array().cast(f"array<struct<_q:int,_o:{kind}>>").alias("o"), F.lit(0).cast(kind).alias("s"))

    def add(state: Column, part: Column) -> Column:
        here = F.struct(part.getField("_p").alias("_q"), state.getField("s").alias("_o"))
        return F.struct(F.concat(state.getField("o"), F.array(here)).alias("o"), (state.getField("s") + part.getField("_s")).alias("s"))

    offsets = parts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.explode(F.aggregate("_l", empty, add, lambda s: s.getField("o"))).alias("_x")).select("*", "_x._q", "_x._o").drop("_x")
    on = F.col("_p") == F.col("_q")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return held.join(F.broadcast(offsets), on, "left").withColumn(out, F.col(out) + F.coalesce("_o", F.lit(0).cast(kind))).select(*df.columns, out)


def binade(v: Column) -> Column:
    """A number that never falls as v grows, with some 4,400 values: sign and power of two; NaN is above all."""
    power = F.least(F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1100)), F.lit(1100)).cast("int") + 1101
    return F.when(F.isnan(v), 3000).when(v == 0, 0).when(v > 0, power).otherwise(-power)


def narrowed(counted: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """The bucket of each target (by, k, rank): rank within it, least and greatest value, and number of rows."""
    upto = Window.partitionBy(*by, "k").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    got = counted.withColumn("_c", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return got.filter((F.col("_c") <= F.col("rank")) & (F.col("rank") < F.col("_c") + F.col("n"))).select(*by, "k", (F.col("rank") - F.col("_c")).alias("rank"), "a", "b", "n")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], bins: int = 1024, few: int = 4096) -> DataFrame:
    """by and a column for each share: the exact quantile, linear between neighbours; null for groups without values.

    Each quantile lies between two rows of known rank. A histogram by powers of two gives the bucket that
    holds a rank; histograms of the bucket's own range, `bins` wide, follow until it holds one value, or
    `few` rows at most, which are sorted. What is shuffled are counts by bucket, some 4,400 a group at first
    and `bins` a rank later. Values within a bucket get apart by a factor of `bins` each time, so that eight
    rounds end any 64-bit range. Nulls don't count; NaN is above all numbers.
    """
    names = list(shares)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    sizes = stored(rows.groupBy(*by).agg(F.count("_v").alias("_n")), "quantile-sizes")
    rows = rows.filter(F.col("_v").isNotNull())
    place = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(shares[n])).alias("share")) for j, n in enumerate(names)])).alias("_t")
    wanted = sizes.filter("_n > 0").select(*by, "_n", place).select(*by, F.col("_t.j").alias("j"), ((F.col("_n") - 1) * F.col("_t.share")).alias("at"))
    ranks = wanted.select(*by, "j", "at", F.posexplode(F.array(F.floor("at"), F.ceil("at"))).alias("side", "rank")).withColumn("k", 2 * F.col("j") + F.col("side"))

    def counted(parts: DataFrame, bucket: Column, *keys: str) -> DataFrame:
        return parts.groupBy(*by, *keys, bucket.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))

    state = stored(narrowed(met(ranks.select(*by, "k", "rank"), counted(rows, binade(F.col("_v"))), by), by, "_b"), "quantile-state")
    wide, settled = f"n > {few} and not (a <=> b)", None
    while (left := state.filter(wide)).limit(1).count():
        rest = state.filter(f"not ({wide})")
        settled = rest if settled is None else settled.unionByName(rest)
        bucket = F.least(F.floor((F.col("_v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
        state = stored(narrowed(counted(within(rows, left, by), bucket, "k", "rank"), by, "_b"), "quantile-state")
    settled = state if settled is None else settled.unionByName(state)
    sorted_ = within(rows, settled.filter("not (a <=> b)"), by).groupBy(*by, "k", "rank").agg(F.sort_array(F.collect_list("_v")).alias("_l"))  # `few` at most
    found = settled.filter("a <=> b").select(*by, "k", F.col("a").alias("v")).unionByName(sorted_.select(*by, "k", F.get("_l", F.col("rank").cast("int")).alias("v")))
    share = F.col("at") - F.floor("at")
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    per = met(ranks, found, by, "k").groupBy(*by, "j", "at").agg(low.alias("_l"), high.alias("_h")).withColumn("_q", F.when(F.col("_l").eqNullSafe(F.col("_h")), F.col("_l")).otherwise(F.col("_l") + (F.col("_h") - F.col("_l")) * share))
    made = per.groupBy(*by).agg(*[F.max(F.when(F.col("j") == j, F.col("_q"))).alias(n) for j, n in enumerate(names)])
    return met(sizes.drop("_n"), made, by, how="left") if by else made


def met(left: DataFrame, right: DataFrame, by: Sequence[str], *more: str, how: str = "inner") -> DataFrame:
    """left and right joined on by (null meets null) and more; without any key, right is a few rows and broadcast."""
    other = right.select(*[F.col(c).alias(f"_{c}_") if c in (*by, *more) else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_{c}_"))
    return (left.join(other, on, how) if by or more else left.join(F.broadcast(other))).drop(*[f"_{c}_" for c in (*by, *more)])


def within(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the targets (k, rank, a, b) whose range holds their value; without groups the ranges are literals of the scan."""
    v = F.col("_v")
    if by:
        lists = targets.groupBy(*by).agg(F.collect_list(F.struct("k", "rank", "a", "b")).alias("_t"))  # two for each share
        rows, at = met(rows, lists, by), F.col("_t")
    else:
        own = targets.select("k", "rank", "a", "b").collect()  # two for each share
        if not own:
            return rows.select("_v", F.lit(0).alias("k"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")).filter("false")
        at = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("k", "rank", "a", "b")]) for r in own])
        rows = rows.filter(v.between(min(r["a"] for r in own), max(r["b"] for r in own)))
    return rows.select(*by, "_v", F.explode(F.filter(at, lambda t: v.between(t.getField("a"), t.getField("b")))).alias("_x")).select(*by, "_v", "_x.*")

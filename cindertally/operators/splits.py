"""Leakage-safe splits and their checks: groups, counts, disjointness, reconciliation, screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import draw, ratio_or_zero


def assign_groups(df: DataFrame, group: str, shares: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Adds `part`: all rows of a group go to one part, by the group's draw and the parts' shares."""
    u = draw(F.coalesce(F.col(group).cast("string"), F.lit("")), seed).cast("double") / F.lit(float(1 << 32))
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("part", F.lit(shares[0][0]) if out is None else out.otherwise(shares[-1][0]))


def spread_groups(df: DataFrame, group: str, part: str = "part") -> DataFrame:
    """Groups found in several parts: none in a sound split."""
    return df.groupBy(group).agg(F.countDistinct(part).alias("parts")).filter("parts > 1")


def leaked_content(df: DataFrame, content: Column, part: str = "part") -> DataFrame:
    """Digests of content found in several parts, with their rows."""
    return df.groupBy(F.md5(content).alias("digest")).agg(F.countDistinct(part).alias("parts"), F.count("*").alias("n")).filter("parts > 1")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value of column by row; 0 where there is none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def subtotals(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), by outer, and over all."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: status `missing` (expected alone) or `extra`."""
    left, right = expected.select(key).distinct(), actual.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(right.join(left, key, "left_anti").withColumn("status", F.lit("extra")))


def expected_vs_actual(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ (columns key, n on both sides; absent = 0), with the signed difference."""
    both = expected.select(key, F.col("n").alias("expected")).join(actual.select(key, F.col("n").alias("actual")), key, "full")
    filled = both.select(key, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
    return filled.withColumn("diff", F.col("actual") - F.col("expected")).filter("diff <> 0")


def audit(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: largest absolute difference, cells over the tolerance, cells, and PASS or FAIL."""
    met = old.select(key, F.col(value).alias("a")).join(new.select(key, F.col(value).alias("b")), key, "full")
    gap = F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(float("inf")))
    out = met.agg(F.max(gap).alias("max_diff"), F.count_if(gap > tolerance).alias("mismatches"), F.count("*").alias("cells"))
    return out.withColumn("status", F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"))


def screen_sources(df: DataFrame, source: str, positive: Column, share: float = 0.6, ratio: int = 3, least: int = 5) -> DataFrame:
    """One row of warnings: no negatives, imbalance, too few sources, one source's dominance."""
    per = df.groupBy(source).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    total = per.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.count("*").alias("sources"), F.max(F.col("p") + F.col("q")).alias("largest"))
    p, q = F.col("positives"), F.col("negatives")
    return total.select(
        "positives", "negatives", "sources",
        (q == 0).alias("no_negatives"),
        ((q > 0) & (p > 0) & (F.greatest(p, q) > ratio * F.greatest(F.lit(1), F.least(p, q)))).alias("imbalanced"),
        (F.col("sources") < least).alias("few_sources"),
        (F.col("largest") > share * (p + q)).alias("dominated"),
    )


def sample_per_class(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class, those with the least draws."""
    order = Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def keep_first_by_hash(df: DataFrame, content: Column, order: Sequence[str | Column]) -> DataFrame:
    """One row for each content, the first in order; rows without content go. A least struct, so that copies meet partly summed."""
    kept = df.withColumn("_d", F.md5(content)).filter(F.col("_d").isNotNull())
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return kept.groupBy("_d").agg(F.min(rank).alias("_m")).select("_m._row.*")


def fallback_ratio(df: DataFrame, by: Sequence[str], fell_back: Column) -> DataFrame:
    return df.groupBy(*by).agg(ratio_or_zero(F.count_if(fell_back), F.count("*")).alias("ratio"))

"""Rank statistics: exact AUROC, quantile-calibrated thresholds, argmax, paired wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio_or_null
from . import nearest
from .means import exact_means
from .ordered import exact_quantiles, prefix_sums


def auroc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """n_pos, n_neg and AUROC (ties count half); null where a class is missing.

    Rows meet by (group, score) first. The negatives below each score are prefix sums over ranges of
    scores, so that no task sees a whole group.
    """
    cells = df.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    ranked = prefix_sums(cells, by, [score], "q", "_below").withColumn("_w", F.col("_below") + F.col("q") / F.lit(2.0).cast("double"))
    out = ranked.groupBy(*by).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"), F.sum(F.col("p") * F.col("_w")).alias("_u"))
    return out.withColumn("auroc", F.try_divide(F.col("_u"), (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("_u")


def calibrated_rates(df: DataFrame, score: str, positive: Column, cluster: str, fpr: float = 0.1) -> DataFrame:
    """One row: the threshold that `fpr` of the negatives exceed, mean recall over clusters, pooled FPR."""
    cut = exact_quantiles(df.filter(~positive), [], score, {"threshold": 1 - fpr}).first()
    threshold = 0.5 if cut is None or cut["threshold"] is None else cut["threshold"]
    over = F.col(score) >= threshold
    per = df.withColumn("_p", positive).groupBy(cluster).agg(
        ratio_or_null(F.count_if(F.col("_p") & over), F.count_if(F.col("_p"))).alias("recall"),
        F.count_if(~F.col("_p") & over).alias("_f"),
        F.count_if(~F.col("_p")).alias("_n"),
    )
    return per.groupBy(F.lit(threshold).alias("threshold")).agg(F.avg("recall").alias("recall"), F.count("recall").alias("clusters"), ratio_or_null(F.sum("_f"), F.sum("_n")).alias("fpr"))


def paired_wins(df: DataFrame, unit: str, side: str, a: str, b: str, value: str) -> DataFrame:
    """One row: units in which a's mean exceeds b's, of those that have both, and the mean difference.

    Means are exact, so that equal ones are no win in any order of rows.
    """
    sides = exact_means(df.filter((F.col(side) == a) | (F.col(side) == b)), [unit, side], value, "_m")
    mean = lambda k: F.max(F.when(F.col(side) == k, F.col("_m")))  # noqa: E731  (one a side)
    both = sides.groupBy(unit).agg(mean(a).alias("x"), mean(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return exact_means(both.withColumn("d", F.col("x") - F.col("y")), [], "d", "delta", wins=F.col("x") > F.col("y"), n=F.lit(True))


def best_and_converged(df: DataFrame, by: Sequence[str], step: str, metric: str, share: float = 0.99) -> DataFrame:
    """The best metric, the first step that has it, and the first step that has `share` of it."""
    best = df.groupBy(*by).agg(F.min(F.struct((-F.col(metric)).alias("m"), F.col(step).alias("s"))).alias("_b")).select(*by, (-F.col("_b.m")).alias("best"), F.col("_b.s").alias("best_step"))
    met = df.join(best, list(by)) if by else df.join(F.broadcast(best))  # one row without groups
    return met.filter(F.col(metric) >= F.col("best") * share).groupBy(*by, "best", "best_step").agg(F.min(step).alias("converged_step"))


def knn_votes(corpus: DataFrame, queries: DataFrame, key: str, vector: str, positive: str, k: int = 5, cells: int = 64) -> DataFrame:
    """Share of positives among each query's k nearest rows by cosine, itself left out; ties go to lower keys.

    Exact, over an index of all rows (see `nearest`). Rows and queries without a direction (null, zero) take no part.
    """
    index = nearest.build(corpus, key, vector, positive, cells)
    if index is None:
        return queries.select(F.col(key).alias("query"), F.lit(None).cast("double").alias("score")).filter("false")
    return nearest.nearest(index, queries, key, vector, k).groupBy("query").agg(F.avg("y").alias("score"))

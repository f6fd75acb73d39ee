"""Detection rates: pooled, per cluster, paired, with intervals over clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio_or_null, ratio_or_zero, t_critical


def pooled_rate(df: DataFrame, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """hits, n and rate = hits / n over all rows (0 for none): not a mean of rates."""
    return df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).withColumn("rate", ratio_or_zero(F.col("hits"), F.col("n")))


def cell_rates(df: DataFrame, by: Sequence[str], hit: Column, valid: Column | None = None) -> DataFrame:
    """The rate of each cell; null where a cell has no valid row."""
    valid = F.lit(True) if valid is None else valid
    return df.groupBy(*by).agg(ratio_or_null(F.count_if(hit & valid), F.count_if(valid)).alias("rate"))


def precision_recall(df: DataFrame, by: Sequence[str], positive: Column, found: Column) -> DataFrame:
    """tp, fn, fp, recall and precision; 0 where a denominator is 0."""
    counts = df.groupBy(*by).agg(F.count_if(positive & found).alias("tp"), F.count_if(positive & ~found).alias("fn"), F.count_if(~positive & found).alias("fp"))
    return counts.withColumn("recall", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")))


def mean_sd(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and sample standard deviation (0 for one row)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def with_interval(df: DataFrame, fallback: float = 1.96) -> DataFrame:
    """Adds ci = t(n - 1) sd / sqrt(n), 0 for one row, to columns n, mean, sd."""
    return df.withColumn("ci", F.when(F.col("n") > 1, t_critical(F.col("n") - 1, fallback) * F.col("sd") / F.sqrt(F.col("n").cast("double"))).otherwise(0.0))


def cluster_interval(cells: DataFrame, group: Sequence[str], cluster: str, value: str = "rate", fallback: float = 1.96) -> DataFrame:
    """Mean over clusters of each cluster's mean, with its t interval: the cluster is the unit.

    cells may hold several rows a cluster (seeds); null values are left out, and with them
    clusters that have nothing else.
    """
    units = cells.groupBy(*group, cluster).agg(F.avg(value).alias("unit")).filter(F.col("unit").isNotNull())
    return with_interval(mean_sd(units, group, "unit"), fallback)


def max_per_item(items: DataFrame, found: DataFrame, key: str, score: str) -> DataFrame:
    """Each item's highest score; 0 where nothing was found."""
    best = found.groupBy(key).agg(F.max(score).alias("best"))
    return items.select(key).join(best, key, "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def paired_means(pairs: DataFrame, a: str, b: str, hit: float, by: Sequence[str] = ()) -> DataFrame:
    """pairs, detection rates (scores of `hit` or more) and mean scores of both sides over the same pairs, and delta.

    Only pairs that have both scores count.
    """
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rate = lambda c: F.avg((F.col(c) >= hit).cast("double"))
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), rate(a).alias("rate_a"), rate(b).alias("rate_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(F.col(a) - F.col(b)).alias("delta"))


def verdict(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The first rule that holds names the verdict; their order matters."""
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def shortcut_verdict(on: Column, off: Column, negative: Column) -> Column:
    """Does a detector need the object, or does the background do?"""
    return verdict(((on >= 0.6) & (off <= 0.2) & (negative <= 0.2), "pass"), ((off >= 0.4) | (negative >= 0.4), "shortcut"), otherwise="ambiguous")


def transfer_verdict(rate: Column) -> Column:
    return verdict((rate >= 0.6, "transfers"), (rate >= 0.3, "partial"), otherwise="weak")


def delta_verdict(treat: Column, treat_ci: Column, control: Column, control_ci: Column) -> Column:
    """Compares two means with intervals; overlap is tested on both sides, so that "worse" can be reached."""
    delta = treat - control
    apart = F.abs(delta) > treat_ci + control_ci
    return verdict((apart & (delta > 0), "better"), (apart & (delta < 0), "worse"), (F.abs(delta) <= F.greatest(treat_ci, control_ci), "same"), otherwise="unclear")


def go_verdict(delta: Column, wins: Column, n: Column, apart: Column, sane: Column) -> Column:
    """Whether a candidate is worth going on with; "worse" is an extension beyond the written rules."""
    return verdict((~sane, "withheld"), ((delta >= 0.10) & ((wins >= 0.8 * n) | apart), "go"), (F.abs(delta) < 0.05, "no-go"), (delta <= -0.05, "worse"), otherwise="ambiguous")


def focus_verdict(mean_ratio: Column) -> Column:
    return verdict((mean_ratio >= 1.3, "focused"), (mean_ratio >= 1.0, "weak"), otherwise="elsewhere")


def inside_outside(cells: DataFrame, by: Sequence[str], value: str, inside: Column) -> DataFrame:
    """Mean inside a mask over mean outside it."""
    return cells.groupBy(*by).agg((F.avg(F.when(inside, F.col(value))) / (F.avg(F.when(~inside, F.col(value))) + F.lit(1e-8))).alias("ratio"))

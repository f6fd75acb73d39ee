"""Means that don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_means(df: DataFrame, by: Sequence[str], value: str, out: str, **counted: Column) -> DataFrame:
    """by, the rows that hold each condition of `counted`, and `out`: the mean of value, null where there is none.

    A sum of doubles differs by the order of its rows, and that of two equal means either may come out as the
    greater. Here each number is a whole number of units, powers of two by its magnitude; whole numbers are
    summed for each unit, and the mean is rounded once, from the exact sum. Nulls don't count; NaN and
    infinities give what they give in any order.
    """
    v = F.col(value).cast("double")
    finite = F.abs(v) < float("inf")  # not NaN, which is above
    # 53 bits and one for the logarithm's error down to the unit, 7 for steps of 8: under 2^62 units
    power = F.when(finite, F.coalesce(F.floor((F.floor(F.log2(F.abs(v))) - 53) / 8) * 8, F.lit(0)).cast("int"))
    half = F.pow(F.lit(2.0), -F.col("_p") / 2)  # twice, since a unit's inverse can be above all doubles
    units = (v * half * half).cast("long").cast("decimal(20,0)")  # a double as decimal would be its shortest digits
    cells = df.withColumn("_p", power).groupBy(*by, "_p").agg(F.sum(units).alias("_s"), F.count(v).alias("_n"), F.sum(F.when(~finite, v)).alias("_o"), *[F.count_if(c).alias(name) for name, c in counted.items()])
    parts = F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_s")))  # some 270 at most
    sums = cells.groupBy(*by).agg(parts.alias("_l"), F.sum("_n").alias("_n"), F.sum("_o").alias("_o"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counted])

    def mean(parts, n):
        if not parts:
            return None
        low = min(0, *(p for p, _ in parts))
        return sum(int(s) << (p - low) for p, s in parts) / (n << -low)  # a quotient of ints is rounded once

    return sums.withColumn(out, F.coalesce("_o", F.udf(mean, "double")("_l", "_n"))).select(*by, *counted, out)

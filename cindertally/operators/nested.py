"""Nested values of any shape: their leaves as rows, and where two versions differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def quoted(name: Column) -> Column:
    """A field of a path; names other than letters, digits and underscores stand in brackets."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("['"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("']")))


def leaves(df: DataFrame, key: str, variant: str) -> DataFrame:
    """key, path, leaf (a variant) for every scalar, null and empty object or array of a variant column.

    A level of all trees is opened at a time, as a table of its own, until nothing is left to open: as many
    rounds as the deepest tree has levels. An absent value (SQL null) has no leaves.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.col(variant).alias("leaf")).filter(F.col("leaf").isNotNull())
    out = None
    inner = F.col("kind").startswith("OBJECT<") | F.col("kind").startswith("ARRAY<")
    while True:
        level = stored(level.withColumn("kind", F.schema_of_variant("leaf")), "variant-level", compression="zstd")
        text = F.when(inner, F.to_json("leaf"))
        bare = level.filter(~inner | text.isin("{}", "[]")).select("key", "path", "leaf")
        out = bare if out is None else out.unionByName(bare)
        open_ = level.filter(inner & ~text.isin("{}", "[]"))
        if not open_.limit(1).count():
            return out.withColumnRenamed("key", key)
        parts = open_.select(F.col("key").alias("_k"), F.col("path").alias("_p"), "leaf").lateralJoin(spark.tvf.variant_explode(F.col("leaf").outer()))
        step = F.when(F.col("key").isNotNull(), quoted(F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = parts.select(F.col("_k").alias("key"), F.concat("_p", step).alias("path"), F.col("value").alias("leaf"))


def differences(old: DataFrame, new: DataFrame, key: str, variant: str, tolerance: float = 1e-9) -> DataFrame:
    """key, path, old, new (as JSON) and status of each leaf that is missing, extra or changed.

    Numbers count as equal within the tolerance. Keys are unique on both sides.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        number = F.try_variant_get("leaf", "$", "double")
        return leaves(df, key, variant).select(key, "path", F.to_json("leaf").alias(name), F.when(~F.schema_of_variant("leaf").isin("STRING", "BOOLEAN"), number).alias(f"_{name}"))

    met = side(old, "old").join(side(new, "new"), [key, "path"], "full")
    near = F.coalesce(F.abs(F.col("_old") - F.col("_new")) <= tolerance, F.col("old") == F.col("new"), F.lit(False))
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").otherwise("changed")
    return met.filter(~near).select(key, "path", "old", "new", status.alias("status"))

"""A store of results by key that can be filled again and again, by several runs at once.

A store is a Parquet folder, parted by a bucket of the keys. Results are staged first, then every bucket
that they touch is written anew with the keys that it lacks, by dynamic partition overwrite: Spark puts
the new files into the bucket's place only when all of them are there. A key lives in one bucket, and a
bucket holds a key once, so that no run adds a key twice. A run that ends before its commit leaves the
store as it was; one that is started again computes what is missing. If two runs commit to one bucket in
the same moment, the later one stays, and what the other had there counts as missing next time.

A commit rewrites the buckets that it touches: `buckets` trades their size against the number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..session import stored

BUCKET = "key_bucket"


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def held(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What the store holds, with the bucket; empty where there is none yet."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*fields.fields]).add(BUCKET, "integer")
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], whole)


def commit(results: DataFrame, path: str, keys: Sequence[str], schema: str | StructType, buckets: int = 64) -> None:
    """Adds the results whose keys the store lacks; of results with one key one is taken."""
    spark = results.sparkSession
    keys = list(keys)
    staged = stored(results.dropDuplicates(keys).withColumn(BUCKET, bucket(keys, buckets)), "results-staged", compression="zstd")
    touched = [r[BUCKET] for r in staged.select(BUCKET).distinct().collect()]  # `buckets` at most
    there = held(spark, path, schema).filter(F.col(BUCKET).isin(touched))
    new = staged.join(there.select(*keys, BUCKET), [*keys, BUCKET], "left_anti")
    changed = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]
    if changed:
        whole = there.filter(F.col(BUCKET).isin(changed)).unionByName(new.select(*there.columns))
        whole.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_through(wanted: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema: str | StructType, buckets: int = 64) -> DataFrame:
    """Results of all wanted keys; only those that the store lacks are computed, and committed. Keys are not null."""
    spark = wanted.sparkSession
    keys = list(keys)
    missing = wanted.withColumn(BUCKET, bucket(keys, buckets)).join(held(spark, path, schema).select(*keys, BUCKET), [*keys, BUCKET], "left_anti").drop(BUCKET)
    if missing.limit(1).count():
        commit(compute(missing), path, keys, schema, buckets)
    return held(spark, path, schema).join(wanted.select(*keys).distinct(), keys, "left_semi").drop(BUCKET)

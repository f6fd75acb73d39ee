"""Scans and sinks of nested manifests, label files, folders and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import suffix

VIDEOS = "videos array<struct<site:string,dish:string,cctv:boolean,file:string,drive_id:string,bytes:bigint>>, n_videos int, n_sites int"
FLAMES = "matte struct<v0:double,core0:double,thr:double,w0:double>, sources array<struct<key:string,file:string,shots:array<array<int>>,crop:array<double>,matte:struct<v0:double,core0:double,thr:double,w0:double>>>"
REAL_FIRE = "fps int, sources array<struct<key:string,file:string,fire_shots:array<array<int>>,nofire_shots:array<array<int>>,crop:array<double>>>"
SPLIT = "assign map<string,string>, sites map<string,array<string>>, videos map<string,array<string>>, counts map<string,struct<sites:int,videos:int,dishes:map<string,int>>>"
FLAME_SPLIT = "pools map<string,array<string>>, excluded array<string>"


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON document over several lines; absent fields are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines, as `write_json` leaves them; absent fields are null."""
    return spark.read.schema(schema).json(path)


def unnested(document: DataFrame, array: str, *keep: str) -> DataFrame:
    """A row for each element of a document's array of structs, with its position and columns of the document."""
    return document.select(*keep, F.posexplode(array).alias("pos", "item")).select(*keep, "pos", "item.*")


def intervals(sources: DataFrame, shots: str) -> DataFrame:
    """key, a, b of every [a, b] of a column of shots; null and empty ones give none."""
    return sources.select("key", F.explode(shots).alias("_s")).select("key", F.get("_s", 0).alias("a"), F.get("_s", 1).alias("b"))


def folder(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """path and length of the files below a folder with one of these suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.filter(suffix(F.col("path")).isin([s.lower() for s in suffixes]))


def path_levels(files: DataFrame, names: Sequence[str], path: str = "path") -> DataFrame:
    """Adds the folders above each file as columns, the last name nearest to the file."""
    parts = F.split(F.col(path), "/")
    return files.select("*", *[F.element_at(parts, -2 - k).alias(n) for k, n in enumerate(reversed(names))])


def class_scene(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Adds class and scene from root/class[/scene]/file; without a scene folder it is _flat."""
    parts = F.split(F.regexp_extract(F.col(path), rf"{root}/(.*)$", 1), "/")
    return files.select("*", F.get(parts, 0).alias("class"), F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise("_flat").alias("scene"))


def pool_of(files: DataFrame, pools: DataFrame, name: Column) -> DataFrame:
    """Adds the pool (key, pool: a small inventory) of each file by its name's first part; unmapped files go."""
    return files.withColumn("key", F.split(name, "_").getItem(0)).join(pools, "key")


def pool_members(split: DataFrame) -> DataFrame:
    """key, pool of a pool split document."""
    return split.select(F.explode("pools").alias("pool", "_k")).select(F.explode("_k").alias("key"), "pool")


def label_lines(text: DataFrame, exact: bool = False, column: str = "value") -> DataFrame:
    """cls, cx, cy, w, h of label lines with five numbers (or more, unless exact); other columns pass."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    fits = F.size(parts) == 5 if exact else F.size(parts) >= 5
    others = [c for c in text.columns if c != column]
    return text.filter(fits).select(*others, F.get(parts, 0).cast("int").alias("cls"), *[F.get(parts, k).cast("double").alias(n) for k, n in enumerate(("cx", "cy", "w", "h"), 1)])


def label_files(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """Label lines of a folder of text files, with each file's path."""
    return label_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")), exact)


def with_polarity(items: DataFrame, labels: DataFrame, key: str, missing_is_negative: bool = True) -> DataFrame:
    """Adds boxes and is_positive. An item without labels is negative; or null, for the caller to refuse."""
    n = labels.groupBy(key).agg(F.count("*").alias("boxes"))
    out = items.join(n, key, "left")
    boxes = F.coalesce("boxes", F.lit(0)) if missing_is_negative else F.col("boxes")
    return out.withColumn("boxes", boxes).withColumn("is_positive", F.col("boxes") > 0)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """epoch and metric of a CSV log with padded headers; the stricter metric is preferred."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    metric = next((c for want in ("mAP50-95", "mAP50") for c in named.columns if want in c), None)
    if metric is None or "epoch" not in named.columns:
        raise ValueError(f"no metric or epoch among {named.columns}")
    return named.select(F.col("epoch").cast("int").alias("epoch"), F.col(f"`{metric}`").cast("double").alias("metric"))


def duration(probe: Column) -> Column:
    """Seconds from a probe's JSON; null where it failed."""
    return F.get_json_object(probe, "$.format.duration").try_cast("double")


def to_do(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a grid that aren't done: a run can be taken up again."""
    return grid.join(done, list(keys), "left_anti")


def training_rows(*parts: DataFrame) -> DataFrame:
    """All rows of the parts; a part given twice counts twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, in place of what was there; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

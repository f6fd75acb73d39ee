"""Registered queries that write to the shared folder and read back: documents, logs, labels, results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import probe, ranking, sequence
from ..session import shared_dir, table
from ..sources import folders, inventory, results


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders nested by customer, written over an older version, read with their schema and unnested."""
    at, orders = fresh(spark, "manifest"), table(spark, sf_dir, "orders")
    nest = lambda price: orders.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", price.alias("price")))).alias("items"))
    inventory.write_json(nest(F.lit(0.0)), at)
    inventory.write_json(nest(F.col("o_totalprice")), at)
    read = inventory.json_rows(spark, at, "key long, items array<struct<o_orderkey:long,price:double,note:string>>")
    return inventory.unnested(read, "items", "key").select("key", F.col("pos").cast("long").alias("pos"), "o_orderkey", "price", "note")


def log_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values by 500 events as a CSV log with padded headers, read back: the best step and the first near it."""
    at = fresh(spark, "log")
    steps = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("  epoch")).agg(F.lit(0.5).alias(" metrics/mAP50(B)"), F.round(F.avg("value"), 9).alias("   metrics/mAP50-95(B)"))
    steps.write.csv(at, header=True)
    got = ranking.best_and_converged(inventory.training_log(spark, at), [], "epoch", "metric")
    return got.select(F.round("best", 6).alias("best"), F.col("best_step").cast("long").alias("best_step"), F.col("converged_step").cast("long").alias("converged_step"))


def label_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of documents in folders by lang and source; counts of boxes of one lang's folders, which alone are opened."""
    at, docs = fresh(spark, "labels"), table(spark, sf_dir, "documents")
    line = F.concat((F.col("doc_id") % 3).cast("string"), F.lit(" 0.5 0.25 0."), (F.col("doc_id") % 9 + 1).cast("string"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(" 0.125"))
    docs.filter(F.col("lang").isNotNull() & F.col("source").isNotNull()).select("lang", "source", line.alias("value")).write.partitionBy("lang", "source").text(at)
    files = folders.labelled_folders(spark, at, ["split", "site"]).filter(F.col("split") == "lang=en")
    lines = files.select("site", F.explode(F.split("value", "\n")).alias("value"))
    boxes = inventory.label_lines(lines)
    return boxes.groupBy("site", "cls").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"))


def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by order from a store that two overlapping sets of keys have filled."""
    at, orders = fresh(spark, "results"), table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")

    def compute(missing: DataFrame) -> DataFrame:
        return lines.join(missing, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))

    schema, keys = "o_orderkey long, n long, quantity double", orders.select("o_orderkey")
    results.read_through(keys.filter("o_orderkey % 3 <> 0"), at, ["o_orderkey"], compute, schema, buckets=16)
    return results.read_through(keys, at, ["o_orderkey"], compute, schema, buckets=16)


def interval_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample time of every span, by the three rules."""
    u = F.col("user_id")
    spans = table(spark, sf_dir, "events").select("user_id").distinct().select(u.alias("span"), (u * 37).cast("int").alias("a"), (u * 37 + 20 + u % 7).cast("int").alias("b"))
    a, b = F.col("a"), F.col("b")
    rules = {"closed": sequence.times_closed(a, b, 2), "halfopen": sequence.times_halfopen(a, b, 2), "grid": F.transform(sequence.grid_times(b - a, 5), lambda x: x.cast("double"))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), t.alias("times")) for n, t in rules.items()])).alias("x")
    return spans.select("span", each).select("span", "x.rule", F.explode("x.times").alias("at"))


def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a quarter of the embeddings by a probe fitted on the others."""
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    got = probe.probe_scores(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), "embedding", "y", iterations=100)
    return got.select("vec_id", "y", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (manifest_round_trip, log_best_epoch, label_folders, result_store, interval_times, linear_probe)}
ORACLES = {
    "manifest_round_trip": "SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) - 1 AS pos, o_orderkey, o_totalprice AS price, NULL::VARCHAR AS note FROM orders",
    "log_best_epoch": """WITH s AS (SELECT CAST(event_id // 500 AS BIGINT) AS step, round(avg(value), 9) AS metric FROM events GROUP BY 1), b AS (SELECT max(metric) AS best FROM s)
SELECT round(best, 6) AS best, min(step) FILTER (WHERE metric = best) AS best_step, min(step) FILTER (WHERE metric >= best * 0.99) AS converged_step FROM s, b GROUP BY best""",
    "label_folders": "SELECT 'source=' || source AS site, CAST(doc_id % 3 AS INT) AS cls, count(*) AS n, round(sum((doc_id % 9 + 1) / 10.0::DOUBLE), 6) AS w FROM documents WHERE lang = 'en' AND source IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1, 2",
    "result_store": "SELECT l_orderkey AS o_orderkey, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "interval_times": """WITH s AS (SELECT user_id AS span, user_id * 37 AS a, user_id * 37 + 20 + user_id % 7 AS b FROM (SELECT DISTINCT user_id FROM events))
SELECT span, 'closed' AS rule, a + unnest(range(0, (b - a) * 2 + 1)) / 2.0::DOUBLE AS at FROM s UNION ALL SELECT span, 'halfopen', a + unnest(range(0, (b - a + 1) * 2)) / 2.0::DOUBLE FROM s
UNION ALL SELECT span, 'grid', unnest(range(0, b - a, 5))::DOUBLE FROM s""",
}

"""A linear probe on embeddings: balanced logistic regression by pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = rows / (classes x rows of the class); the weights sum to the rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    whole = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = counts.join(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))  # a row for each class
    return df.join(F.broadcast(weights), label)


def probe_scores(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 1.0, iterations: int = 2000) -> DataFrame:
    """test with `score`, the probability of class 1 after an L2 fit on train."""
    rows = balanced(train.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")), "label")
    fit = LogisticRegression(maxIter=iterations, regParam=1.0 / (c * rows.count()), standardization=False, weightCol="weight").fit(rows)
    seen = fit.transform(test.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    return seen.withColumn("score", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")

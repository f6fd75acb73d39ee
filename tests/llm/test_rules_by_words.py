"""Quality rules: the ratio over n-grams of words."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cindertally.llm import quality_gam, quality_rules, queries

BAD = "qxzjkv"


def grams(text):
    w = text.split()
    return [*((x,) for x in w), *zip(w, w[1:], strict=False)]


def test_ratio_equals_its_definition(make, spark):
    texts = {1: "ab cd 12 ef", 2: "xy zw 34 uv", 3: "ab xy, 34 Ef", 4: "", 5: None, 6: "ab"}
    raw, target, b = Counter(), Counter(), 1 << 16
    for i, t in texts.items():
        raw.update(grams(t or ""))
        target.update(grams(t or "") if i in (1, 3) else [])
    ratio = lambda g: math.log(0.9 * target[g] / sum(target.values()) / ((raw[g] + 1) / (sum(raw.values()) + b)) + 0.1)
    rows = quality_rules.quality_rules(make(list(texts.items())), spark.createDataFrame([(1,), (3,), (3,), (None,)], "doc_id long"), b, 0.0).collect()
    got = {r["doc_id"]: r["llr"] for r in rows}
    assert len(rows) == 6
    for i, t in texts.items():
        g = grams(t or "")
        assert abs(got[i] - (sum(map(ratio, g)) / len(g) if g else 0)) < 2e-6
    assert got[1] > got[2]  # equal in shape
    none = quality_rules.quality_rules(make(list(texts.items())), spark.createDataFrame([], "doc_id long"), b, 0.0).collect()
    assert {r["llr"] for r in none} == {0.0}


def test_shuffled_ids_give_the_same(make, spark, docs, sf, monkeypatch):
    trusted = queries.trusted(spark, sf)
    few = sorted(map(tuple, quality_rules.quality_rules(docs, trusted, 1 << 12).collect()))
    from cindertally.llm import columns

    monkeypatch.setattr(columns, "sized", lambda ids, most=0: ids.hint("merge"))
    monkeypatch.setattr(quality_rules, "sized", columns.sized)
    assert few == sorted(map(tuple, quality_rules.quality_rules(docs, trusted, 1 << 12).collect()))


def test_twins_of_random_letters_are_rejected(spark):
    """Documents with every letter replaced have the same shapes and none of the words."""
    sf = "/root/testdata/sf0.01"
    docs, good = spark.read.parquet(f"{sf}/documents.parquet"), queries.trusted(spark, sf)
    rnd = random.Random(1)
    own = docs.join(good, "doc_id").select(docs.columns).orderBy("doc_id").limit(40).collect()
    twins = [(10_000_000 + r["doc_id"], re.sub("[a-z]", lambda m: rnd.choice(BAD), r["text"]), r["lang"], r["source"], r["n_chars"]) for r in own]
    both = docs.union(spark.createDataFrame(twins, docs.schema))
    rows = quality_rules.quality_rules(both, good).filter("not base_failed").collect()
    ids = {r["doc_id"] for r in own}
    assert not any(r["kept"] for r in rows if r["doc_id"] >= 10_000_000)
    kept = [r["kept"] for r in rows if r["doc_id"] in ids]
    assert sum(kept) >= len(kept) - 1


def test_labels_that_neither_target_nor_threshold_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, queries.trusted(spark, sf)).join(labels.filter(quality_gam.held_out(F.col("doc_id"))), "doc_id").filter("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad) and len(bad) > 3


def test_accepted_returns_whole_rows(docs, odd, make, spark, sf):
    good = queries.trusted(spark, sf)
    clash = docs.selectExpr("*", "1 as _d", "2 as _h", "3 as row", "4 as key", "5 as kept")
    want = {r["doc_id"] for r in quality_rules.quality_rules(docs, good).filter("kept").collect()}
    got = quality_rules.accepted(clash, good)
    assert got.columns == clash.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want) and want
    long = " ".join(f"w{k}" for k in range(60))
    twice = make([(1, long), (1, long), (None, long), (2, None), (3, "short")])
    assert sorted((r["doc_id"] for r in quality_rules.accepted(twice, good, threshold=-9.0).collect()), key=str) == [1, 1, None]
    assert quality_rules.accepted(make([]), good).count() == 0


def test_threshold_is_of_all_held_out_documents(make, spark):
    """More of them than any bound on their number that this operator once had."""
    rnd = random.Random(5)
    usual, odd_ = [f"w{k}" for k in range(300)], [f"v{k}" for k in range(3000)]
    rows = [(i, " ".join(rnd.choice(odd_ if rnd.random() < i % 97 / 300 else usual) for _ in range(52))) for i in range(9600)]
    got = quality_rules.quality_rules(make(rows), spark.range(9600).toDF("doc_id"), 1 << 12).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 2).collect()
    own = [r["llr"] for r in got if r["own"] and not r["base_failed"]]
    assert len(own) > 2200
    low = round(float(np.quantile(own, 0.01)), 6)
    assert [r["doc_id"] for r in got if r["kept"] != (not r["base_failed"] and round(r["llr"], 6) >= low)] == []


def test_pipeline_stage_takes_its_threshold_from_all_held_out_documents(make, spark, tmp_path):
    rnd = random.Random(6)
    usual, odd_ = [f"w{k}" for k in range(300)], [f"v{k}" for k in range(3000)]
    docs = make([(i, " ".join(rnd.choice(odd_ if rnd.random() < i % 97 / 300 else usual) for _ in range(52))) for i in range(12800)])
    spark.range(12800).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    good = queries.trusted(spark, str(tmp_path))
    got = quality_rules.quality_rules(docs, good, threshold=None).join(good.withColumn("own", quality_rules.held_out(F.col("doc_id"))), "doc_id", "left").collect()
    own = [r["llr"] for r in got if r["own"] and not r["base_failed"]]
    assert len(own) > 2200
    low = round(float(np.quantile(own, 0.01)), 6)
    want = {r["doc_id"] for r in got if not r["base_failed"] and round(r["llr"], 6) >= low}
    assert {r["doc_id"] for r in corpus_pipeline.by_rules(spark, docs, str(tmp_path)).select("doc_id").collect()} == want


def test_ratios_are_broadcast_once(make, spark):
    """As a scalar subquery, the table was a literal of the tasks' binary at each of its uses, in the driver's memory."""
    ratios = spark.createDataFrame([([0.5] * 16,)], "ratios array<double>")
    plan = quality_rules.judge(make([(1, "a b c")]), ratios, 16)._jdf.queryExecution().toString()
    assert "scalar-subquery" not in plan and "BroadcastNestedLoopJoin" in plan

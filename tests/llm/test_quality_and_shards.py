"""Quality rules, the additive model, sharding, the pipeline and the registered queries."""

import ast
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from cindertally.llm import quality_gam, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    held = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)


def test_rules_count_as_defined(docs, odd, make, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    more = make([(50, "a b c a b c"), (51, "a a a a a a"), (52, "x y z\nx y z\n\nx y z"), (53, "# $ <>|&")])
    for df in (docs, odd, more):
        rows = {r["doc_id"]: r["text"] for r in df.collect()}
        got = quality_rules.quality_rules(df, labels, threshold=-1.0).collect()
        assert len(got) == df.count()
        for r in got:
            counts = base_counts(rows[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert r["kept"] == (not r["base_failed"] and round(r["llr"], 6) >= -1.0)
    assert quality_rules.quality_rules(make([]), labels).count() == 0


def test_features_are_those_of_each_text_alone(docs, odd):
    texts = [r["text"] for r in odd.collect()] + [r["text"] for r in docs.limit(30).collect()]
    whole = quality_gam.features(pa.array(texts, pa.string()))
    alone = np.vstack([quality_gam.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and whole.shape[1] == len(quality_gam.FEATURES)
    w = WORD.findall(texts[20].lower())
    assert np.isclose(whole[20][10], len(set(w)) / math.sqrt(len(w))) or not texts[20].isascii()
    assert quality_gam.features(pa.array([], pa.string())).shape == (0, len(quality_gam.FEATURES))


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in model.pairs
    assert quality_gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality_gam.fit(x, np.ones(4000)).score(x[:1])[0] > 0.99


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_gam.classify(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    flipped = labels.withColumn("quality", F.when(quality_gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r["doc_id"]: r["score"] for r in quality_gam.classify(docs, flipped).collect()}
    assert all(other[r["doc_id"]] == r["score"] for r in rows)


def test_classifier_on_odd_rows(odd, make, spark):
    labels = spark.createDataFrame([(3, 1), (7, 0), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality_gam.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_gam.classify(make([]), labels).count() == 0
    assert quality_gam.classify(odd, labels.filter("doc_id < 0")).count() == odd.count()


def test_shards(docs, odd, make):
    for df in (docs, odd):
        rows = sharding.assign_shards(df, [1.0] * 8).collect()
        assert len(rows) == df.count()
        for s in range(8):
            own = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert own == list(range(len(own)))
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
        assert all((r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "key") for r in rows)
    assert sharding.assign_shards(make([]), [1.0] * 8).count() == 0
    assert sharding.assign_shards(docs, [1.0], None).filter("shard <> 0 or grown_shard is not null").count() == 0


def test_weights_rule_the_shares(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    at = keys.select("doc_id", sharding.rendezvous(F.col("doc_id"), [1.0, 2.0, 5.0]).alias("s"), sharding.rendezvous(F.col("doc_id"), [1.0, 2.0, 6.0]).alias("t")).collect()
    share = Counter(r["s"] for r in at)
    assert all(abs(share[k] / 20_000 - w / 8) < 0.015 for k, w in enumerate([1, 2, 5]))
    assert all(r["t"] in (r["s"], 2) for r in at)  # a heavier shard only wins keys


def test_native_operators_use_no_python():
    for module in (sharding, quality_rules):
        source = Path(module.__file__).read_text()
        assert not re.search(r"mapIn|applyIn|udf|rdd|toPandas|import numpy|import pyarrow", source), module.__name__


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        before = kept[name] = spark.createDataFrame(after.collect(), docs.schema)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = quality_gam.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in quality_gam.scored(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept["quality_classifier"].collect()} == want
    assert sum(labels.get(i, 1) == 0 for i in want) <= 0.05 * len(want)
    ids = [r["doc_id"] for r in before.collect()]
    assert len(ids) == len(set(ids))
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)


def test_registered_queries(spark, sf):
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    for name in ("op1_ngram_join", "op10_sharding"):
        assert queries.QUERIES[name](spark, sf).count() == 200


def test_nothing_else_imports_this_subpackage():
    root = Path(__file__).resolve().parents[2]
    for p in (root / "cindertally").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p

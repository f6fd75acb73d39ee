"""Label folders, result stores, nested audits, spans, hashes within a radius, and the fold over event time."""

import glob
import json
import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from cindertally.operators import distinct, nested, sequence
from cindertally.sources import folders, inventory, results
from cindertally.streaming import stateful


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tree(tmp_path):
    for split in ("train", "test"):
        for site in range(4):
            at = tmp_path / split / f"s{site}"
            at.mkdir(parents=True)
            for k in range(3):
                (at / f"{k}.TXT").write_text(f"{k} .5 .5 .1 .1\n")
            (at / "x.png").write_bytes(b"\xff\xfe")
    (tmp_path / "train" / "s1" / "deeper").mkdir()
    return tmp_path


def test_only_wanted_folders_are_listed_and_opened(spark, tree):
    reader = folders.FolderReader(str(tree), ["split", "site"], [".txt"])
    left = list(reader.pushFilters([EqualTo(("split",), "train"), In(("site",), ("s1", "s3", "s9")), EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)]
    assert [(p.levels, len(p.paths)) for p in reader.partitions()] == [(("train", "s1"), 3), (("train", "s3"), 3)]
    assert len(reader.listed) == 4
    # a file that can't be read shows that the others aren't opened
    (tree / "test" / "s0" / "bad.txt").write_bytes(b"\xff")
    files = folders.labelled_folders(spark, str(tree), ["split", "site"])
    assert files.filter("split = 'train' and site in ('s1', 's2')").count() == 6
    assert inventory.label_lines(files.filter("split = 'train'")).count() == 12
    with pytest.raises(Exception, match="utf-8"):
        files.filter("split = 'test'").collect()
    both = reader.pushFilters([EqualTo(("split",), "test")])
    assert list(both) == [] and reader.partitions() == []


def test_store_adds_no_key_twice(spark, tmp_path):
    path, schema, asked = str(tmp_path / "store"), "k long, v long", []

    def compute(missing):
        asked.append(sorted(r["k"] for r in missing.collect()))
        return missing.select("k", (F.col("k") * 2).alias("v"))

    def overlapping(missing):
        # another run commits some of the same keys while this one computes
        results.read_through(spark.range(5, 15).withColumnRenamed("id", "k"), path, ["k"], compute, schema, buckets=4)
        return compute(missing)

    got = results.read_through(spark.range(10).withColumnRenamed("id", "k"), path, ["k"], overlapping, schema, buckets=4)
    assert rows(got) == [(k, 2 * k) for k in range(10)]
    assert rows(spark.read.parquet(path).groupBy("k").count().filter("count > 1")) == []
    assert spark.read.parquet(path).count() == 15
    assert asked == [list(range(5, 15)), list(range(10))]
    # a run that fails before its commit leaves nothing, and the next one takes up what is missing
    with pytest.raises(ValueError, match="lost"):
        results.read_through(spark.range(14, 20).withColumnRenamed("id", "k"), path, ["k"], lambda m: (_ for _ in ()).throw(ValueError("lost")), schema, buckets=4)
    assert spark.read.parquet(path).count() == 15
    results.read_through(spark.range(14, 20).withColumnRenamed("id", "k"), path, ["k"], compute, schema, buckets=4)
    assert asked[-1] == list(range(15, 20)) and spark.read.parquet(path).count() == 20
    results.commit(spark.range(20).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v")), path, ["k"], schema, buckets=4)
    assert spark.read.parquet(path).filter("v < 0").count() == 0
    n = len(asked)
    assert results.read_through(spark.range(20).withColumnRenamed("id", "k"), path, ["k"], compute, schema, buckets=4).count() == 20 and len(asked) == n
    assert results.held(spark, str(tmp_path / "none"), schema).count() == 0


def test_leaves_and_differences_at_any_depth(spark):
    deep = json.dumps({"a": [{"b": [[1, [2]], {}]}], "odd name": None, "x.y": "t", "e": []})
    df = spark.createDataFrame([(1, deep), (2, "3"), (3, None), (4, "[]")], "k long, j string").select("k", F.parse_json("j").alias("v"))
    got = {(r["k"], r["path"]): r["j"] for r in nested.leaves(df, "k", "v").select("k", "path", F.to_json("leaf").alias("j")).collect()}
    assert got == {(1, "$.a[0].b[0][0]"): "1", (1, "$.a[0].b[0][1][0]"): "2", (1, "$.a[0].b[1]"): "{}", (1, "$['odd name']"): "null", (1, "$['x.y']"): '"t"', (1, "$.e"): "[]", (2, "$"): "3", (4, "$"): "[]"}
    other = spark.createDataFrame([(1, deep.replace("[2]", "[2.0000000000001, 5]")), (2, "4"), (5, "true")], "k long, j string").select("k", F.parse_json("j").alias("v"))
    assert rows(nested.differences(df, other, "k", "v").select("k", "path", "status")) == [(1, "$.a[0].b[0][1][1]", "extra"), (2, "$", "changed"), (4, "$", "missing"), (5, "$", "extra")]
    assert nested.differences(df.filter("false"), df.filter("false"), "k", "v").count() == 0


def test_cover_of_a_long_span_is_short(spark):
    df = spark.createDataFrame([(0, 99_999), (5, 5), (-7, 12), (3, 2), (1, (1 << 40) + 12345)], "a long, b long").withColumn("c", sequence.dyadic_cover(F.col("a"), F.col("b"), 45))
    for r in df.filter("b < 100000").collect():
        inside = sorted(t for level, place in r["c"] for t in range(place << level, (place + 1) << level))
        assert inside == list(range(r["a"], r["b"] + 1))
        assert len(r["c"]) < 64
    long = df.filter("b > 100000").first()
    assert sum(1 << level for level, _ in long["c"]) == long["b"] - long["a"] + 1 and len(long["c"]) < 82


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_equals_all_pairs(spark, closed):
    rng = np.random.default_rng(7)
    a = rng.integers(-50, 1000, 60)
    spans = [(int(x), int(x + rng.choice([0, 1, 7, 300, 5000])), k) for k, x in enumerate(a)] + [(9, 3, 900), (None, 4, 901)]
    points = [(float(t), k) for k, t in enumerate(np.concatenate([rng.uniform(-60, 6000, 300), rng.integers(-50, 1000, 200)]))] + [(None, 9999)]
    got = sequence.interval_join(spark.createDataFrame(points, "t double, p long"), "t", spark.createDataFrame(spans, "a long, b long, s long"), closed)
    want = [(p, s) for t, p in points if t is not None for x, y, s in spans if x is not None and x <= t and (t <= y if closed else t < y + 1)]
    assert rows(got.select("p", "s")) == sorted(want, key=str)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_distinct_within_a_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(distinct, "LARGE", 20)
    rng = np.random.default_rng(radius)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    data = [(k, int(base[rng.integers(0, 12)] ^ np.bitwise_or.reduce(np.left_shift(1, rng.integers(0, 62, rng.integers(0, 4)))))) for k in range(500)]
    kept = []
    for k, h in data:
        if all(bin((h ^ x) & (1 << 64) - 1).count("1") > radius for _, x in kept):
            kept.append((k, h))
    got = distinct.distinct_within(spark.createDataFrame([*data, (None, 5), (900, None)], "k long, h long").repartition(6), "k", "h", radius)
    assert rows(got) == sorted(kept, key=str)
    if radius == 0:
        assert got.count() == len({h for _, h in data})


def test_fold_over_event_time_takes_triggers_in_any_order(spark, sf, tmp_path):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
        frame = events.toPandas().sort_values("ts").reset_index(drop=True)
        arrival = (frame.index + np.random.default_rng(0).integers(0, 120, len(frame))).to_numpy().argsort(kind="stable")
        parts = [frame.iloc[arrival[i : i + 250]] for i in range(0, len(frame), 250)]
        last = frame["ts"].max()
        parts += [pd.DataFrame({"user_id": [-1], "event_id": [-d], "ts": [last + pd.Timedelta(days=d)], "value": [1.0]}) for d in (30, 31)]
        (tmp_path / "in").mkdir()
        for k, part in enumerate(parts):
            spark.createDataFrame(part, events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
            to = tmp_path / "in" / f"{k:03d}.parquet"
            shutil.copy(glob.glob(str(tmp_path / f"x{k}" / "*.parquet"))[0], to)
            os.utime(to, (1e9 + k, 1e9 + k))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        folded = stateful.last_kept_in_time(stream, "user_id", "ts", ["event_id"], "value", "event_id", 20.0, "10 days")
        run = folded.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert rows(spark.table("folded").filter("user_id >= 0")) == rows(sequence.last_kept(events, "user_id", ["ts", "event_id"], "value", "event_id", 20.0))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)

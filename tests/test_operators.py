"""Edge cases and operators that SQL doesn't check."""

import json
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cindertally.functions import images, scalar, vectors
from cindertally.operators import matching, means, probe, ranking, rates, sequence, splits
from cindertally.sources import inventory, results
from cindertally.streaming import stateful


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_manifests(spark, tmp_path):
    path = tmp_path / "flames.json"
    path.write_text(json.dumps({"matte": {"v0": 1.0}, "sources": [{"key": "a", "file": "a.mp4", "shots": [[172, 199], [3, 4]]}, {"key": "b", "file": "b.mp4", "shots": []}, {"key": "c", "file": "c.mp4"}]}, indent=1))
    document = inventory.json_document(spark, str(path), inventory.FLAMES)
    sources = inventory.unnested(document, "sources")
    assert [(r["pos"], r["key"]) for r in sources.collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [r["key"] for r in sources.filter(scalar.has_any(F.col("shots"))).collect()] == ["a"]
    shots = inventory.intervals(sources, "shots").filter("a = 172")
    got = shots.select(F.size(sequence.times_closed(F.col("a"), F.col("b"), 2)), F.size(sequence.times_halfopen(F.col("a"), F.col("b"), 2))).first()
    assert tuple(got) == (55, 56)
    pools = spark.createDataFrame([({"train": ["x", "y"], "test": ["z"]}, ["w"])], inventory.FLAME_SPLIT)
    assert rows(inventory.pool_members(pools)) == [("x", "train"), ("y", "train"), ("z", "test")]
    files = spark.createDataFrame([("d/x_1.png",), ("d/q_2.png",)], "path string")
    assert [r["pool"] for r in inventory.pool_of(files, inventory.pool_members(pools), scalar.stem(F.col("path"))).collect()] == ["train"]


def test_folders_and_labels(spark, tmp_path):
    for name, text in {"train/s1/a.JPG": "x", "train/s1/b.txt": "0 .5 .5 .1 .1\n1 2 3\n0 1 2 3 4 5\n", "test/c.jpeg": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = inventory.folder(spark, str(tmp_path), [".jpg", ".jpeg"])
    assert files.count() == 2
    split = inventory.path_levels(files.filter("path like '%JPG'"), ["split", "site"]).select("split", "site").first()
    assert tuple(split) == ("train", "s1")
    assert rows(inventory.class_scene(files, tmp_path.name).select("class", "scene")) == [("test", "_flat"), ("train", "s1")]
    assert inventory.label_files(spark, str(tmp_path / "train/s1/b.txt")).count() == 2
    assert inventory.label_files(spark, str(tmp_path / "train/s1/b.txt"), exact=True).count() == 1
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    labels = spark.createDataFrame([("a",)], "k string")
    assert rows(inventory.with_polarity(items, labels, "k")) == [("a", 1, True), ("b", 0, False)]
    assert rows(inventory.with_polarity(items, labels, "k", False)) == [("a", 1, True), ("b", None, None)]


def test_training_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("  epoch,  metrics/mAP50(B),   metrics/mAP50-95(B)\n 1, .9, .5\n 2, .9, .7\n 3, .9, .7\n")
    got = ranking.best_and_converged(inventory.training_log(spark, str(path)), [], "epoch", "metric").first()
    assert tuple(got) == (0.7, 2, 2)
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no metric"):
        inventory.training_log(spark, str(path))


def test_read_through_and_sinks(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(missing):
        asked.append(sorted(r["k"] for r in missing.collect()))
        return missing.select("k", (F.col("k") * 2).alias("v"))

    wanted = spark.createDataFrame([(1,), (2,)], "k long")
    assert rows(results.read_through(wanted, path, ["k"], compute, "k long, v long")) == [(1, 2), (2, 4)]
    more = spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(results.read_through(more, path, ["k"], compute, "k long, v long")) == [(2, 4), (3, 6)]
    assert asked == [[1, 2], [3]]
    inventory.write_json(wanted, str(tmp_path / "out"))
    inventory.write_json(more, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_names(spark):
    df = spark.createDataFrame([("x/00012_a.b.png", "v8_a_b_s12", 65.9, "é", '{"format": {"duration": "12.5"}}'), ("a", "v8_s1", 600.0, None, "bad")], "p string, r string, t double, u string, j string")
    got = df.select(scalar.strip_serial(scalar.stem(F.col("p"))), scalar.run_parts(F.col("r")), scalar.minutes(F.col("t")), scalar.nfc("u"), inventory.duration(F.col("j"))).collect()
    assert tuple(got[0]) == ("a.b", ("v8", "a_b", 12), "1:05", "é", 12.5)
    assert tuple(got[1]) == ("a", None, "10:00", None, None)


def test_ratios_and_intervals(spark):
    cells = spark.createDataFrame([("A", "v1", 0.5), ("A", "v1", 0.7), ("A", "v2", 0.2), ("A", "v3", None), ("B", "v1", 0.4)], "c string, v string, rate double")
    got = {r["c"]: r for r in rates.cluster_interval(cells, ["c"], "v").collect()}
    assert got["A"]["n"] == 2 and np.isclose(got["A"]["mean"], 0.4) and np.isclose(got["A"]["ci"], 12.71 * np.std([0.6, 0.2], ddof=1) / np.sqrt(2))
    assert (got["B"]["mean"], got["B"]["sd"], got["B"]["ci"]) == (0.4, 0.0, 0.0)
    one = spark.range(1).select(scalar.t_critical(F.lit(12), 2.0), scalar.ratio_or_zero(F.lit(1), F.lit(0)), scalar.ratio_or_null(F.lit(1), F.lit(0))).first()
    assert tuple(one) == (2.0, 0.0, None)
    names = [rates.delta_verdict(*map(F.lit, x)) for x in ((0.9, 0.1, 0.5, 0.1), (0.1, 0.1, 0.5, 0.1), (0.5, 0.2, 0.45, 0.1), (0.65, 0.1, 0.5, 0.1))]
    assert tuple(spark.range(1).select(*names).first()) == ("better", "worse", "same", "unclear")
    go = [rates.go_verdict(*map(F.lit, x)) for x in ((0.2, 4, 4, False, False), (0.2, 4, 5, False, True), (0.2, 1, 5, False, True), (0.01, 0, 5, False, True), (-0.2, 0, 5, False, True))]
    assert tuple(spark.range(1).select(*go).first()) == ("withheld", "go", "ambiguous", "no-go", "worse")


def test_auroc(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("b", True, 3.0), ("b", False, 2.0), ("b", False, 3.0), ("c", True, 1.0)], "g string, y boolean, s double")
    got = {r["g"]: r["auroc"] for r in ranking.auroc(df, "s", F.col("y"), ["g"]).collect()}
    assert got == {"a": 0.5, "b": 0.75, "c": None}
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 2
    want = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    big = spark.createDataFrame(pd.DataFrame({"y": y.astype(bool), "s": s}))
    assert np.isclose(ranking.auroc(big, "s", F.col("y")).first()["auroc"], want)


def test_equal_means_are_no_win_in_any_order(spark):
    a, b = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]  # as sums in order 0.6000000000000001 and 0.6
    data = [("u", "a", v) for v in a] + [("u", "b", v) for v in b] + [("v", "a", v) for v in b] + [("v", "b", v) for v in a]
    data += [("w", "a", 1.0 + 2.0**-52), ("w", "b", 1.0), ("x", "a", 1e16), ("x", "a", 1.0), ("x", "a", -1e16), ("x", "b", 0.5), ("y", "a", 5.0), ("y", "b", None), ("z", "c", 9.0)]
    want = (1, 4, (2.0**-52 + (1 / 3 - 0.5)) / 4)
    for rows_ in (data, data[::-1]):
        df = spark.createDataFrame(rows_, "u string, s string, v double").coalesce(1)
        for d in (df, df.repartition(5)):
            assert tuple(ranking.paired_wins(d, "u", "s", "a", "b", "v").first()) == want
    assert tuple(ranking.paired_wins(df.filter("false"), "u", "s", "a", "b", "v").first()) == (0, 0, None)


def test_exact_means(spark):
    rng, inf, nan = np.random.default_rng(8), float("inf"), float("nan")
    groups = {g: (rng.normal(size=40) * 2.0 ** rng.integers(-1074, 1020, 40)).tolist() for g in range(20)}
    groups |= {20: [5e-324, 5e-324], 21: [1.7e308] * 3, 22: [8.0, 2.0**-3, 2.0**52, 0.0], 23: [-0.0], 24: rng.exponential(50, 999).round(2).tolist(), 25: [2.0**k for k in range(-1074, 1024)]}
    want = {g: (lambda q: q.numerator / q.denominator)(sum(map(Fraction, v)) / len(v)) for g, v in groups.items()}
    odd = {26: ([1.0, nan], nan), 27: ([1.0, inf], inf), 28: ([inf, -inf], nan), 29: ([None, None], None), 30: ([None, 3.0], 3.0), None: ([1.0, 2.0], 1.5)}
    data = [(g, x) for g, v in [*groups.items(), *((g, v) for g, (v, _) in odd.items())] for x in v]
    got = {r["g"]: (r["big"], r["m"]) for r in means.exact_means(spark.createDataFrame(data, "g int, v double").repartition(7), ["g"], "v", "m", big=F.col("v") > 1).collect()}
    assert repr({g: got[g][1] for g in (*want, *odd)}) == repr(want | {g: m for g, (_, m) in odd.items()})
    assert len(got) == len(groups) + len(odd) and got[24][0] == sum(x > 1 for x in groups[24]) and got[29][0] == 0


def test_last_kept_is_not_lag(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.6), (1, 3, 1.2), (2, 1, 5.0)], "g long, k long, v double")
    assert rows(sequence.last_kept(df, "g", ["k"], "v", "k", 1.0)) == [(1, 1), (1, 3), (2, 1)]


def test_two_level_cap_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame([(g, i, int(rng.integers(0, 90))) for g in range(12) for i in range(int(rng.integers(1, 9)))], columns=["g", "i", "n"])
    got = {(r["g"], r["i"]): r["kept"] for r in sequence.two_level_cap(spark.createDataFrame(frame), "g", "i", "n", 100).collect()}
    want = {}
    for g, own in frame.groupby("g"):
        used, share = 0, -(-100 // len(own))
        for i, n in zip(own["i"], own["n"], strict=True):
            if used >= 100:
                break
            want[g, i] = min(n, share, 100 - used)
            used += want[g, i]
    assert got == want


def test_matching(spark):
    names = spark.createDataFrame([("ab cd",), ("cd ef",)], "name string")
    frags = spark.createDataFrame([("ab",), ("cd",), ("zz",)], "frag string")
    assert rows(matching.unique_match(frags, names, "frag", "name")) == [("ab", "ab cd")]
    assert rows(matching.first_match(frags, names, "frag", "name")) == [("ab", "ab cd"), ("cd", "ab cd")]
    assert rows(matching.match_status(frags, names, "frag", "name")) == [("ab", 1, "one"), ("cd", 2, "ambiguous"), ("zz", 0, "none")]


def test_splits(spark):
    df = spark.createDataFrame([("s1", "t", 0), ("s1", "u", 1), ("s2", "t", 2), (None, None, 3)], "site string, text string, id long")
    parted = splits.assign_groups(df, "site", [("a", 0.5), ("b", 0.5)])
    assert splits.spread_groups(parted, "site").count() == 0
    assert splits.keep_first_by_hash(df, F.col("text"), ["site", "id"]).count() == 2
    audit = splits.audit(df.select("id", F.lit(1.0).alias("v")), df.filter("id < 3").select("id", F.lit(1.0).alias("v")), "id", "v").first()
    assert (audit["mismatches"], audit["status"]) == (1, "FAIL")


def test_vectors(spark):
    got = spark.range(1).select(vectors.pooled(F.array(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(0.0)))), vectors.similarity(F.array(F.lit(0), F.lit(255)), F.array(F.lit(0), F.lit(0))), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert tuple(got) == ([2.0, 2.0, 3.0, 4.0], 0.5, None)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, v[i].tolist(), bool(i % 3 == 0)) for i in range(120)], "id long, v array<double>, y boolean").repartition(5)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = {r["query"]: r["score"] for r in ranking.knn_votes(df, df.filter("id % 10 = 0"), "id", "v", "y").collect()}
    for q in range(0, 120, 10):
        near = sorted((i for i in range(120) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:5]
        assert np.isclose(got[q], np.mean([i % 3 == 0 for i in near]))


def test_noise(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (24, 30, 3), dtype=np.uint8)
    for name in images.NOISE:
        assert (images.corrupt(x, name, 0, 1) == x).all()
        for s in range(1, 6):
            y = images.corrupt(x, name, s, 7)
            assert y.shape == x.shape and y.dtype == np.uint8 and (y == images.corrupt(x, name, s, 7)).all() and (y != x).any()
    df = spark.createDataFrame([(1, 24, 30, bytearray(x.tobytes()), "contrast", 3)], "id long, height int, width int, pixels binary, noise string, severity int")
    assert bytes(images.corrupted(df).first()["pixels"]) == images.corrupt(x, "contrast", 3, 0).tobytes()
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (images.corrupt(flat, "defocus", 3, 0) == 77).all() and (images.corrupt(flat, "motion_blur", 2, 0) == 77).all()


def test_random_noise_is_drawn_by_id(spark):
    x = np.random.default_rng(5).integers(0, 256, (17, 23, 3), dtype=np.uint8)
    df = spark.createDataFrame([(i, 17, 23, bytearray(x.tobytes())) for i in range(60)], "id long, height int, width int, pixels binary")
    got = images.augmented(df, images.ALL9).collect()
    assert len({r["noise"] for r in got}) >= 7 and {r["severity"] for r in got} <= {1, 2, 3, 4, 5}
    assert sorted(map(str, got)) == sorted(map(str, images.augmented(df.repartition(3), images.ALL9).collect()))
    assert set(images.ALL9) == set(images.NOISE)


def test_jpeg_loses_more_at_higher_severity():
    rows, columns = np.mgrid[:40, :56]
    x = np.stack([rows * 6, columns * 4, 255 - rows * 3], axis=-1).clip(0, 255).astype(np.uint8)
    x[10:20, 10:20] = np.random.default_rng(1).integers(0, 256, (10, 10, 3))
    lost = [np.abs(images.corrupt(x, "jpeg", s, 0).astype(int) - x).mean() for s in range(6)]
    assert lost[0] == 0 and lost[1] > 0 and lost[5] > 2 * lost[1]
    grey = np.full((16, 16, 3), 128, np.uint8)
    assert (images.corrupt(grey, "jpeg", 5, 0) == 128).all()


def test_composite():
    under = np.full((60, 80, 3), 40, np.uint8)
    sprite = np.zeros((20, 20, 4), np.uint8)
    sprite[5:15, 5:15] = (255, 220, 120, 255)
    plain = images.composite(under, sprite, (40, 30), feather=False, colour=False, screened=False, bloom=False, spill=False)
    assert images.bounding_box((plain != under).any(-1)) == (35, 25, 45, 35) and tuple(plain[30, 40]) == (255, 220, 120)
    edge = images.composite(under, sprite, (-50, 500), False, False, False, False, False)
    assert images.bounding_box((edge != under).any(-1)) == (5, 45, 15, 55)
    lit = images.composite(under, sprite, (40, 30))
    assert lit[30, 40, 0] == 255 and lit[30, 46, 0] > lit[30, 46, 2] > 40 and (lit[0, 0] == 40).all()


def test_backbones(spark):
    from cindertally.operators import backbones

    def broken():
        raise OSError("no weights")

    registry = {"a": [broken, lambda: None, backbones.hashed_text], "b": [broken], "c": [backbones.stored_vectors]}
    assert backbones.available(["c", "b", "a", "z"], registry) == ["c", "a"]
    df = spark.createDataFrame([(1, "a b b"), (2, None)], "id long, t string")
    got = {r["id"]: r for r in backbones.embedded(df, "id", "t", "a", registry, batch=1).collect()}
    assert got[1]["used"] == 2 and sum(map(abs, got[1]["embedding"])) == 3 and not any(got[2]["embedding"])


def test_shapes_in_images():
    mask = np.zeros((40, 40), bool)
    mask[2:12, 3:20] = True
    mask[30, 30] = True
    alpha = mask * 0.5
    assert images.bounding_box(images.cleaned(alpha)) == (3, 2, 20, 12)
    two = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)
    assert images.components(two).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 0], [2, 2, 0]]
    ramp = np.tile(np.arange(36), (16, 1))
    assert images.gradient_bits(ramp) == (1 << 64) - 1 and images.gradient_bits(-ramp) == 0
    spot = np.zeros((5, 5, 4))
    spot[2, 3] = [1, 2, 3, 4]
    assert np.unravel_index(images.principal_map(spot).argmax(), (5, 5)) == (2, 3)


def test_probe(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("y", (F.col("label") < 5).cast("int"))
    got = probe.probe_scores(e.filter("vec_id % 4 <> 0"), e.filter("vec_id % 4 = 0"), "embedding", "y", iterations=50)
    assert got.filter("score < 0 or score > 1").count() == 0
    assert ranking.auroc(got, "score", F.col("y") == 1).first()["auroc"] > 0.5


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    events.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    kept = stateful.last_kept_stream(stream, "user_id", ["event_id"], "value", "event_id", 20.0)
    run = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("kept")) == rows(sequence.last_kept(events, "user_id", ["event_id"], "value", "event_id", 20.0))
    out = str(tmp_path / "out")
    append = stateful.append_new(out, ["user_id"], lambda new: new.select("user_id", F.lit(1).alias("v")), "user_id long, v int")
    for _ in range(2):
        append(events, 0)
    assert spark.read.parquet(out).count() == events.select("user_id").distinct().count()

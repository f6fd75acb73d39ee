"""Prefix sums, exact quantiles, folds, nearest neighbours and fragment matching against plain versions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cindertally.operators import matching, nearest, ordered, ranking, sequence


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_prefix_sums_over_parts(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], 4000, p=[0.9, 0.05, 0.05]), "o": rng.permutation(4000), "v": rng.integers(0, 9, 4000)})
    df = spark.createDataFrame(frame, "g string, o long, v long").repartition(7)
    got = {(r["g"], r["o"]): r["s"] for r in ordered.prefix_sums(df, ["g"], ["o"], "v", "s").collect()}
    frame = frame.sort_values("o")
    frame["s"] = frame.groupby("g", dropna=False)["v"].cumsum() - frame["v"]
    assert got == {(g if isinstance(g, str) else None, o): s for g, o, s in zip(frame["g"], frame["o"], frame["s"], strict=True)}
    whole = {r["o"]: r["s"] for r in ordered.prefix_sums(df, [], ["o"], "v", "s").collect()}
    frame["w"] = frame["v"].cumsum() - frame["v"]
    assert whole == dict(zip(frame["o"], frame["w"], strict=True))
    assert ordered.prefix_sums(df.filter("false"), ["g"], ["o"], "v", "s").count() == 0


def test_no_window_sees_all_rows(spark):
    df = spark.range(100).select((F.col("id") % 2 == 0).alias("y"), F.col("id").cast("double").alias("s"))
    got = ranking.auroc(df, "s", F.col("y"))
    assert "Window" not in plan(got) and "SinglePartition, REPARTITION" not in plan(got)
    assert got.first()["auroc"] == np.mean([(a > b) for a in range(0, 100, 2) for b in range(1, 100, 2)])


@pytest.mark.parametrize("few", [1, 4096])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(1)
    kinds = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(0, 3, 2000).astype(float),
        "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 500), -(10.0 ** rng.integers(-300, 300, 501)), [0.0, 5e-324, -5e-324]]),
        "one": np.array([7.5]),
        "endless": np.array([np.inf, -np.inf, 1.0, 2.0, 3.0]),
        "near": 1.0 + np.arange(300) * 2.0**-52,
    }
    frame = pd.DataFrame([(k, v) for k, own in kinds.items() for v in own], columns=["g", "v"])
    df = spark.createDataFrame([*frame.itertuples(index=False, name=None), ("nothing", None), (None, 4.0), (None, None)], "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.95, "q10": 1.0}
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", shares, bins=64, few=few).collect()}
    for k, own in kinds.items():
        x = np.sort(own)
        for name, share in shares.items():
            at = (len(x) - 1) * share
            lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
            want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
            assert got[k][name] == want or (want != want and got[k][name] != got[k][name]), (k, name)
    assert got["nothing"]["q5"] is None and got[None]["q5"] == 4.0
    one = ordered.exact_quantiles(df.filter("g = 'normal'"), [], "v", {"m": 0.5}, few=few).first()
    assert one["m"] == np.median(kinds["normal"])
    assert ordered.exact_quantiles(df.filter("false"), [], "v", {"m": 0.5}).filter("m is not null").count() == 0


def test_last_kept_of_a_million_rows_in_one_group(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("g").alias("g"), F.col("id").alias("k"), ((F.col("id") * 7919) % 1000 / 10.0).alias("v"))
    got = sequence.last_kept(df, "g", ["k"], "v", "k", 60.0)
    assert "collect_list" not in plan(got)
    last, want = None, 0
    for i in range(1_000_000):
        v = i * 7919 % 1000 / 10.0
        if last is None or abs(v - last) >= 60.0:
            last, want = v, want + 1
    assert got.count() == want


def test_last_kept_with_nulls_and_many_groups(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(0, 40)) if rng.random() > 0.1 else None, k, None if rng.random() < 0.2 else float(rng.integers(0, 50))) for k in range(3000)]
    got = rows(sequence.last_kept(spark.createDataFrame(data, "g long, k long, v double").repartition(9), "g", ["k"], "v", "k", 10.0))
    want = []
    for g in {d[0] for d in data}:
        last, began = None, False
        for _, k, v in sorted((d for d in data if d[0] == g), key=lambda d: d[1]):
            if not began or (v is not None and (last is None or abs(v - last) >= 10.0)):
                want.append((g, k))
                last, began = v, True
    assert got == sorted(want, key=str)


def test_systematic_equals_the_rule(spark):
    df = spark.createDataFrame([(g, k) for g in range(5) for k in range(13 * g + 1)], "g long, k long").repartition(6)
    want = []
    for g in range(5):
        n = 13 * g + 1
        want += [(g, k) for k in range(n) if k % max(1, n // 7) == 0 or k == n - 1]
    assert rows(sequence.systematic(df, ["g"], ["k"], 7, with_last=True)) == sorted(want, key=str)


def test_neighbours_are_exact_and_pruned(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 10
    v = np.concatenate([centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.3, np.tile(centres[0], (1500, 1))])  # a third is one vector
    data = [(i, v[i].tolist(), bool(i % 3 == 0)) for i in range(len(v))]
    df = spark.createDataFrame([*data, (9000, None, True), (9001, [0.0] * 16, True), (9002, [], False)], "id long, v array<double>, y boolean").repartition(6)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    index = nearest.build(df, "id", "v", "y", cells=32, sample=512, rows=100)
    assert index.blocks.agg(F.max("n"), F.sum("n")).first()[:] == (100, len(v))
    asked = df.filter("id % 50 = 0")
    got = {}
    for r in nearest.nearest(index, asked, "id", "v", 5).collect():
        got.setdefault(r["query"], []).append((-r["score"], r["id"]))
    for q in range(0, len(v), 50):
        s = np.round(unit @ unit[q], 9)
        s[q] = -2
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(len(v)), -s))[:5].tolist()
    assert set(got) == set(range(0, len(v), 50))
    assert nearest.share_of_pairs(index, asked, "id", "v", 5) < 0.5
    assert ranking.knn_votes(df.filter("id > 8999"), asked, "id", "v", "y").count() == 0
    few = ranking.knn_votes(df.filter("id < 3"), df.filter("id < 3"), "id", "v", "y").collect()
    assert len(few) == 3


def test_fragments_by_grams(spark):
    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abcé日 "), n))
    names = [draw(rng.integers(0, 30)) for _ in range(300)] + ["ab" * 40, "", None, "ab" * 40]
    frags = [draw(rng.integers(0, 6)) for _ in range(80)] + ["", "a", "ab", "日", None, "zzz", "aba", "aba"]
    f, n = spark.createDataFrame([(x,) for x in frags], "f string"), spark.createDataFrame([(x,) for x in names], "n string")
    want = [(a, b) for a, b in itertools.product(frags, names) if a is not None and b is not None and a in b]
    assert rows(matching.fragment_hits(f, n, "f", "n").select("f", "n")) == sorted(want, key=str)
    assert matching.fragment_hits(f.filter("false"), n, "f", "n").count() == 0
    assert matching.fragment_hits(f, n.filter("false"), "f", "n").count() == 0
    status = {r["f"]: r["hits"] for r in matching.match_status(f.distinct(), n, "f", "n").collect()}
    assert status["zzz"] == 0 and status["ab"] == sum("ab" in x for x in names if x)

"""Boosting, draws, clashing columns, the shuffle path of the join, and the pipeline on odd rows."""

import bisect
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs_and_lines import components_of, sets_of

import corpus_pipeline
from cindertally.llm import media_gif, ngram_join, packing, quality_gam, sharding, token_counts, token_files
from cindertally.llm.queries import tokenizer


def squared(g, h):
    return g * g / (h + 1.0)


def best_cut(g, h, parts):
    """The cut of one of the parts that lowers the loss most, by trying all; None if none does."""
    best = None
    for a, b in parts:
        for c in range(a + 1, b):
            more = squared(sum(g[a:c]), sum(h[a:c])) + squared(sum(g[c:b]), sum(h[c:b])) - squared(sum(g[a:b]), sum(h[a:b]))
            if more > 1e-12 and (best is None or more > best[0] + 1e-12):
                best = (more, a, b, c)
    return best


def plain_tree(g, h):
    parts = [(0, len(g))]
    for _ in range(2):
        found = best_cut(g, h, parts)
        if not found:
            break
        _, a, b, c = found
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        for k in range(a, b):
            out[k] = sum(g[a:b]) / (sum(h[a:b]) + 1.0)
    return out


def test_trees_equal_trying_all_cuts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        g, h = rng.normal(size=n), rng.uniform(0.1, 2, n)
        assert np.allclose(quality_gam.three_leaves(g, h), plain_tree(g.tolist(), h.tolist()))
        m = int(rng.integers(2, 6))
        g, h = rng.normal(size=(max(n, 2), m)), rng.uniform(0.1, 2, (max(n, 2), m))
        gain, values = quality_gam.four_leaves(g, h)
        tried = []
        for i in range(1, len(g)):
            for j in range(1, m):
                quarters = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, m)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, m))]
                tried.append((sum(squared(g[q].sum(), h[q].sum()) for q in quarters), quarters))
        top, quarters = max(tried, key=lambda t: t[0])
        assert np.isclose(gain, top)
        assert all(np.allclose(values[q], g[q].sum() / (h[q].sum() + 1.0)) for q in quarters)


def test_boosting_equals_a_row_by_row_version():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (80, 3)).astype(float)
    y = (x[:, 0] + rng.normal(size=80) > 2).astype(float)
    model = quality_gam.fit(x, y, bins=4, rounds=6, n_pairs=0, pair_rounds=0)
    total = [math.log(y.mean() / (1 - y.mean()))] * 80
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]
    for _ in range(6):
        for k in range(3):
            at = [bisect.bisect_right(model.cuts[k].tolist(), v) for v in x[:, k]]
            g, h = [0.0] * len(tables[k]), [0.0] * len(tables[k])
            for row in range(80):
                p = 1 / (1 + math.exp(-total[row]))
                g[at[row]] += y[row] - p
                h[at[row]] += p * (1 - p)
            add = [0.1 * v for v in plain_tree(g, h)]
            tables[k] = [a + b for a, b in zip(tables[k], add, strict=True)]
            total = [t + add[a] for t, a in zip(total, at, strict=True)]
    for got, want in zip(model.tables, tables, strict=True):
        assert np.allclose(got, want)
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-t)) for t in total])


def test_draws_equal_the_definition(spark):
    weights = [1.0, 2.5, 0.5, 1.0]
    ids = [*range(300), None]
    got = [r["s"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).select(sharding.rendezvous(F.col("doc_id"), weights).alias("s")).collect()]

    def score(i, k):
        u = (int(hashlib.md5(f"{'null' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -weights[k] / math.log(u)

    assert got == [max(range(4), key=lambda k: (score(i, k), -k)) for i in ids]


def test_join_by_shuffle_equals_brute_force(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "sized", lambda ids: ids.hint("merge"))
    rng = np.random.default_rng(2)
    base = [rng.choice(500, 60).astype(str).tolist() for _ in range(6)]
    rows = []
    for k in range(70):
        own = list(base[k % 6])
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(0, 60))] = "x" + str(rng.integers(0, 9))
        rows.append((k, " ".join(own[: int(rng.integers(50, 61))])))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(make(rows)).collect()}
    assert got == components_of(sets_of(rows))


CLASHES = ("token", "label", "n", "stays", "row", "key", "id", "a", "b", "slot", "shard", "size", "score", "predicted", "content", "k", "_t", "_b", "queue", "part", "start", "h", "body", "words", "digest")


@pytest.mark.parametrize("name", ["join", "one_of_each", "files", "gif", "counts", "packing", "classifier", "shards"])
def test_columns_may_bear_any_names(spark, sf, docs, tmp_path, name):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.filter("doc_id < 60")
    run = {
        "join": ngram_join.ngram_join,
        "one_of_each": ngram_join.one_of_each,
        "files": lambda d: token_files.token_digests(d, tokenizer("byte_bpe_50k.json"), keeps_space=True, end_id=0),
        "gif": media_gif.text_as_gif,
        "counts": lambda d: token_counts.token_counts(d, str(tmp_path / str(len(d.columns))), tokenizer("piece_bpe_32k.model")),
        "packing": lambda d: packing.pack(d, tokenizer("word_bpe_49k.json"), end_id=1, window=2048),
        "classifier": lambda d: quality_gam.accepted(d, quality_gam.train(d, labels)),
        "shards": lambda d: sharding.assign_shards(d, [1.0] * 8).drop("slot"),
    }[name]
    plain = run(some)
    crowded = run(some.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, crowded.collect()))


def test_pipeline_on_odd_rows(spark, sf, docs, odd, tmp_path):
    some = docs.filter("doc_id < 80")
    odd_rows = odd.select(F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 5000).alias("doc_id"), *odd.columns[1:]).withColumn("source", F.lit(None).cast("string"))
    tables = {"odd": some.unionByName(some.filter("doc_id < 20")).unionByName(odd_rows.select(*some.columns)), "empty": some.filter("false")}
    for name, table in tables.items():
        at = tmp_path / name
        table.write.parquet(str(at / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(at / "labels.parquet"))
        pieces = corpus_pipeline.run(spark, str(at)).collect()
        if name == "empty":
            assert pieces == []
            continue
        held = {}
        for p in pieces:
            held.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
        assert len(held) > 5
        for own in held.values():
            at_, own = 0, sorted(own)
            for start, length, total in own:
                assert start == at_
                at_ += length
            assert at_ == total

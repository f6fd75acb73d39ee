"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut at quantiles of the training rows and of their distinct values, at most
2 x `bins` of them. Boosting visits
the features in turn; each visit fits a shallow tree (three leaves) to the gradient of the log
loss over the feature's bins and adds a small step of it to the feature's table. The pairs of
features that then lower the loss most are boosted in the same way, by trees of one cut on either
feature. What is left of training is a table for each feature and each pair: a score is the sum of
looked-up numbers, through the logistic function.

Training rows are a sample bounded by `most` (those with the smallest hashes of doc_id among the
labelled rows allowed); scoring takes every document, whole. Labels, lang, source and doc_id are no
features.

Cases: null and empty texts have all-zero features and get a score of their own; repeated rows are
scored alike; with no labelled row, or labels of one class only, the score is the share of label 1
(0.5 without labels). An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import sliced, small_batches
from .textbytes import SPACE, mix, split_words

FEATURES = ("log_words", "mean_word", "upper", "digits", "symbols", "links", "pipes", "marks", "stops", "lines", "distinct", "repeats", "runs", "same_lines", "longest")
CUT = 0.7


def marked(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, SYMBOL, LINK, PIPE, MARK, STOP, LINE = (marked(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>^~", "@_=+/\\{}[]", "|", "!?", ".,;:", "\n"))


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, from its whole bytes."""
    w = split_words(texts)
    n = len(w.ends_of) - 1
    size, words = np.diff(w.ends_of), np.diff(w.first)

    def per_text(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return run[w.ends_of[1:]] - run[w.ends_of[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    h = w.hashes(lower=True)
    of = np.repeat(np.arange(n, dtype=np.uint64), words)
    with np.errstate(over="ignore"):
        keyed = mix(h + of * np.uint64(0x9E3779B97F4A7C15))
    # distinct words of each text, by sorting (word, text) hashes
    order = np.sort(keyed)
    fresh = np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.zeros(0, bool)
    index = np.searchsorted(order[fresh], keyed)
    seen = np.zeros(int(fresh.sum()), dtype=bool)
    seen[index] = True
    owner = np.zeros(len(seen), dtype=np.int64)
    owner[index] = of.astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    again = np.zeros(len(h), dtype=bool)  # a pair of words found before in this text
    if len(h) > 1:
        with np.errstate(over="ignore"):
            pair = mix(keyed[1:] * np.uint64(3) + h[:-1])
        inside = np.flatnonzero(of[1:] == of[:-1])
        _, at = np.unique(pair[inside], return_index=True)
        again[1 + inside] = True
        again[1 + inside[at]] = False
    upto = lambda m: (lambda run: run[w.first[1:]] - run[w.first[:-1]])(np.concatenate([[0], np.cumsum(m, dtype=np.int64)]))
    # lines: texts cut at line feeds as words are at spaces
    v = split_words(texts, LINE)
    lines = np.diff(v.first)
    with np.errstate(over="ignore"):
        line_key = mix(v.hashes() + np.repeat(np.arange(n, dtype=np.uint64), lines) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(line_key, return_index=True)
    only = np.bincount(np.repeat(np.arange(n), lines)[at], minlength=n)
    width = w.end - w.start
    longest = np.zeros(n)
    if len(width):
        has = words > 0
        longest[has] = np.maximum.reduceat(width, w.first[:-1][has])
    return np.column_stack([
        np.log1p(words), share(upto(width), words), share(per_text(UPPER[w.raw]), size), share(per_text(DIGIT[w.raw]), size), share(per_text(SYMBOL[w.raw]), size), share(per_text(LINK[w.raw]), size),
        share(per_text(PIPE[w.raw]), words), share(per_text(MARK[w.raw]), words), share(per_text(STOP[w.raw]), words), share(lines, words), share(distinct, np.sqrt(words)),
        share(upto(again), words), share(upto(same), words), share(lines - only, lines), np.log1p(longest),
    ]).astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Gam:
    """Cuts and a table of additions for each feature, and tables for pairs of features."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        at = self.bins(x)
        for k, t in enumerate(self.tables):
            total += t[at[k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[at[i], at[j]]
        return sigmoid(total)


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of leaves with these sums of gradients and weights."""
    return g / (h + 1.0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values for each bin of the tree of at most two cuts that lowers the loss most, found cut by cut."""
    parts = [(0, len(g))]
    run_g, run_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(2):
        best, where = 1e-12, None
        for a, b in parts:
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            left = gain(run_g[c] - run_g[a], run_h[c] - run_h[a])
            right = gain(run_g[b] - run_g[c], run_h[b] - run_h[c])
            more = left + right - gain(run_g[b] - run_g[a], run_h[b] - run_h[a])
            if more.max() > best:
                best, where = more.max(), (a, b, int(c[more.argmax()]))
        if where is None:
            break
        a, b, c = where
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf(run_g[b] - run_g[a], run_h[b] - run_h[a])
    return out


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values over a grid of two features' bins: one cut on each, the best of a few rows and columns."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, ch_ = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = cg[-1, -1] - a - b - c, ch[-1, -1] - ah - bh - ch_
    total = gain(a, ah) + gain(b, bh) + gain(c, ch_) + gain(d, dh)
    i, j = np.unravel_index(total.argmax(), total.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = leaf(a[i, j], ah[i, j]), leaf(b[i, j], bh[i, j])
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf(c[i, j], ch_[i, j]), leaf(d[i, j], dh[i, j])
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, step: float = 0.1) -> Gam:
    """Boosts the tables on rows x with labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Gam(base=float(np.log(share / (1 - share))))
    share = y.mean()
    model = Gam(base=float(np.log(share / (1 - share))))
    at = np.linspace(0, 1, bins + 1)[1:-1]
    # quantiles of the distinct values too: most rows of a sparse feature are 0
    model.cuts = [np.unique(np.concatenate([np.quantile(x[:, k], at), np.quantile(np.unique(x[:, k]), at)])) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = sigmoid(total)
            add = step * three_leaves(np.bincount(at[k], weights=y - p, minlength=len(table)), np.bincount(at[k], weights=p * (1 - p), minlength=len(table)))
            table += add
            total += add[at[k]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat, p = at[i] * shape[1] + at[j], sigmoid(total)
        return tuple(np.bincount(flat, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    found = sorted(((four_leaves(*grids(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in found[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            add = step * four_leaves(*grids(i, j))[1]
            table += add
            total += add[at[i], at[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Gam:
    """Fits on at most `most` labelled rows, none of them held out."""
    small_batches(docs.sparkSession)
    allowed = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = allowed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, quality long, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # `most` rows: one for a doc_id
    got = got.sort_values("doc_id", kind="stable")
    return fit(np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES))), got["quality"].to_numpy())


def scored(docs: DataFrame, model: Gam, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                s = model.score(features(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, cut: float = CUT) -> DataFrame:
    """Trains on `labels` and scores all docs."""
    return scored(docs, train(docs, labels, most), cut)


def accepted(docs: DataFrame, model: Gam, cut: float = CUT) -> DataFrame:
    """The rows of docs that score `cut` or more, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= cut))

    return docs.mapInArrow(run, docs.schema)

"""Exact nearest neighbours by cosine over an index of pivots and distance-sorted blocks.

On the unit sphere cosine orders like distance, and distance obeys the triangle inequality: with
pivot p, |d(q, p) - d(x, p)| is at most d(q, x). Pivots are fitted on a bounded sample; every row
belongs to its nearest pivot's cell and to a block of `rows` rows that are neighbours in (cell, distance to
the pivot). A query starts from the k-th best of the sample, which bounds its k-th best of all, and visits
only blocks whose span of distances the bound doesn't rule out. A block meets its queries as one
matrix product each batch.

Nothing that grows is broadcast: pivots, the sample and one span a cell are. Blocks come from a range
shuffle over (cell, distance, hash of the key), so that very many equal vectors fill blocks of their own
like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import draw
from ..session import stored

#: What rounding may add to a distance; scores are rounded to nine digits.
SLACK = 1e-6
DIGITS = 9


@dataclass
class Index:
    """blocks: a row for each block of vectors; spans: least and greatest distance of each cell."""

    pivots: np.ndarray
    sample: np.ndarray
    sample_keys: np.ndarray
    blocks: DataFrame
    spans: dict[int, tuple[float, float]]
    key: str


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have a direction, as unit vectors, and their places."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    if not sizes.any():
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    dim = int(sizes.max())
    full = np.flatnonzero(sizes == dim)
    v = column.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(v, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return v[fine] / norm[fine, None], full[fine]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def fitted(sample: np.ndarray, cells: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Pivots: centres of the sample's clusters, on the sphere."""
    cells = min(cells, len(sample))
    centres = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


BLOCK = "cell int, least double, most double, n int, ids array<{key}>, ys array<double>, vectors binary"


def build(corpus: DataFrame, key: str, vector: str, positive: str, cells: int = 64, sample: int = 4096, rows: int = 1024) -> Index | None:
    """An index of all rows with a direction; None if there are none. The fit sees the `sample` rows of least draw."""
    usable = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(positive).cast("double").alias("y")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    some = usable.select("id", "v").orderBy(draw(F.col("id"), "sample"), "id").limit(sample).toArrow()  # bounded by `sample`
    taken, at = units(some.column("v").combine_chunks())
    if not len(taken):
        return None
    names = some.column("id").to_numpy()[at]
    pivots = fitted(taken, cells)
    kind = dict(usable.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = units(batch.column("v"))
            if len(at):
                d = distances(v, pivots)
                cell = d.argmin(axis=1)
                own = [batch.column(c).take(pa.array(at)) for c in ("id", "y")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(at)), cell]), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "y", "cell", "d", "unit"])

    placed = usable.mapInArrow(place, f"id {kind}, y double, cell int, d double, unit binary").withColumn("h", F.xxhash64("id"))
    dealt = placed.repartitionByRange("cell", "d", "h").sortWithinPartitions("cell", "d", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of at most `rows` rows of one cell, in order of distance."""
        held: list[pa.RecordBatch] = []

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            d = t.column("d")
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("id", "y")]
            ends = [pa.array([x.as_py()], pa.float64()) for x in (d[0], d[-1])]
            return pa.RecordBatch.from_arrays([pa.array([t.column("cell")[0].as_py()], pa.int32()), *ends, pa.array([t.num_rows], pa.int32()), *lists, pa.array([b"".join(t.column("unit").to_pylist())], pa.binary())], ["cell", "least", "most", "n", "ids", "ys", "vectors"])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0].column("cell")[0].as_py() != cell[a]:
                    yield out(held)
                    held = []
                while a < b:
                    take = min(b - a, rows - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(h.num_rows for h in held) == rows:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    blocks = stored(dealt.mapInArrow(pack, BLOCK.format(key=kind)).withColumn("block", F.monotonically_increasing_id()), "knn-blocks", compression="zstd")
    spans = {r["cell"]: (r["a"], r["b"]) for r in blocks.groupBy("cell").agg(F.min("least").alias("a"), F.max("most").alias("b")).collect()}  # one a cell
    return Index(pivots, taken, names, blocks, spans, kind)


def visits(index: Index, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, unit, block, n: the blocks that each query has to visit."""
    pivots, sample, names, spans = index.pivots, index.sample, index.sample_keys, index.spans
    low, high = (np.array([spans.get(c, (np.inf, -np.inf))[s] for c in range(len(pivots))]) for s in (0, 1))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, at = units(batch.column("v"))
            if not len(at):
                continue
            ids = batch.column("query").take(pa.array(at))
            near = distances(q, sample)
            near[ids.to_numpy(zero_copy_only=False)[:, None] == names[None, :]] = np.inf
            tau = (np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(q), np.inf)) + SLACK
            d = distances(q, pivots)
            row, cell = np.nonzero((d - tau[:, None] <= high) & (d + tau[:, None] >= low))
            unit = pa.array([r.tobytes() for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), unit.take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(d[row, cell] - tau[row]), pa.array(d[row, cell] + tau[row])], ["query", "unit", "cell", "lo", "hi"])

    kind = dict(queries.dtypes)[key]
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    reach = asked.mapInArrow(bound, f"query {kind}, unit binary, cell int, lo double, hi double")
    return reach.join(index.blocks.select("cell", "least", "most", "n", "block"), "cell").filter("least <= hi and most >= lo").select("query", "unit", "block", "n")


def nearest(index: Index, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """query, id, y, score: the k rows nearest to each query, itself left out; ties go to lower keys."""
    kind = dict(queries.dtypes)[key]
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    blocks = index.blocks.select("block", F.lit(0).alias("what"), none(kind, "query"), F.col("vectors").alias("data"), "ids", "ys")
    asked = visits(index, queries, key, vector, k).select("block", F.lit(1).alias("what"), "query", F.col("unit").alias("data"), none(f"array<{index.key}>", "ids"), none("array<double>", "ys"))
    met = blocks.unionByName(asked).repartition("block").sortWithinPartitions("block", "what")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, ys, at = np.zeros((0, 1)), pa.array([]), pa.array([]), None
        for batch in batches:
            what, block = batch.column("what").to_numpy(), batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(what) != 0)) + 1).tolist(), len(what)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                data = batch.column("data").slice(a, b - a).to_pylist()
                if what[a] == 0:
                    ids, ys, at = batch.column("ids")[a].values, batch.column("ys")[a].values, block[a]
                    x = np.frombuffer(data[0]).reshape(len(ids), -1)
                    continue
                assert at == block[a]
                own = batch.column("query").slice(a, b - a)
                s = np.round(np.frombuffer(b"".join(data)).reshape(b - a, -1) @ x.T, DIGITS)
                keys = ids.to_numpy(zero_copy_only=False)
                s[own.to_numpy(zero_copy_only=False)[:, None] == keys[None, :]] = -np.inf
                edge = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
                row, column = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
                order = np.lexsort((np.argsort(np.argsort(keys, kind="stable"), kind="stable")[column], -s[row, column], row))
                row, column = row[order], column[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                row, column = row[keep], column[keep]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), ids.take(pa.array(column)), ys.take(pa.array(column)), pa.array(s[row, column])], ["query", "id", "y", "score"])

    local = met.mapInArrow(score, f"query {kind}, id {index.key}, y double, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return local.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k).drop("_k")


def share_of_pairs(index: Index, queries: DataFrame, key: str, vector: str, k: int = 5) -> float:
    """The share of all pairs (query, row) that are computed."""
    done = visits(index, queries, key, vector, k).agg(F.sum("n").alias("n")).first()["n"] or 0
    return done / max(1, queries.count() * (index.blocks.agg(F.sum("n").alias("n")).first()["n"] or 0))

"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Each source's documents form a queue in the order of doc_id. A round deals every queue that still
has tokens its quantum, weight share x window; the share's fraction is carried as a deficit, so
after r rounds a queue has given floor(r * window * weight / total weight) tokens. Rounds are laid
end to end in one stream that is cut every `window` tokens: each window but the last is full and
holds every source's share to within one token a source. When a queue runs dry, the others go on
with larger shares (a new phase).

That rule has a closed form, so a token's place follows from the number of tokens before it in its
queue. Documents are dealt by range of (queue, doc_id), tokenized once and stored; only the token
sums of (queue, partition) meet on the driver, at most partitions + queues rows. Deficits thus
carry over windows and partitions with no sequential pass, and a hot source is cut by range.

Cases: a null or empty text is its end id alone; a null source is a queue of its own; repeated rows
are packed once each; an empty table gives no piece. Every source has a queue of its own at any
number of sources. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import sliced, small_batches
from .encoding import load, with_end, worker_cache

WINDOW, SCALE = 2048, 1 << 15
TOKENS = "part int, queue string, before long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


class Schedule:
    """The deal of queues with `totals` tokens: shares and the rounds of each phase, from which `phases` follow.

    Memory grows with the number of queues only; time with its square, if each runs dry in its own phase.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW):
        top = max(weights, default=1)
        self.window, self.rounds = window, []
        self.totals = np.array(totals, dtype=np.int64)
        # shares as fine as products with the tokens stay below 2^62
        scale, most = SCALE, max([*totals, window]) + window
        while scale >= 1:
            self.share = np.array([max(1, round(w / top * scale)) for w in weights], dtype=np.int64)
            if most * int(self.share.sum()) < 1 << 62:
                break
            scale //= 2
        else:
            raise ValueError("too many tokens and queues for 64-bit places")
        given = np.zeros(len(totals), dtype=np.int64)
        while len(alive := np.flatnonzero(given < self.totals)):
            w, left = self.share[alive], self.totals[alive] - given[alive]
            whole = int(w.sum())
            rounds = int(((left * whole - 1) // (window * w)).min()) + 1
            # the round in which the first queue runs dry ends the phase
            self.rounds.append(rounds)
            given[alive] += np.minimum(left, rounds * window * w // whole)

    def phases(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """By phase: queues with tokens left, tokens they have given before, tokens they give, place in the stream."""
        given, base = np.zeros(len(self.totals), dtype=np.int64), 0
        for rounds in self.rounds:
            alive = np.flatnonzero(given < self.totals)
            w = self.share[alive]
            dealt = np.minimum(self.totals[alive] - given[alive], rounds * self.window * w // int(w.sum()))
            yield alive, given[alive], dealt, base
            given[alive] += dealt
            base += int(dealt.sum())


def places(schedule: Schedule, queue: np.ndarray, first: np.ndarray, last: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Cuts token ranges [first, last) of their queues: (range, first token, number, place in the stream)."""
    out: list[tuple[np.ndarray, ...]] = []
    for alive, given, dealt, base in schedule.phases():
        at = np.minimum(np.searchsorted(alive, queue), len(alive) - 1)
        a, b = np.maximum(first - given[at], 0), np.minimum(last - given[at], dealt[at])
        some = np.flatnonzero((a < b) & (alive[at] == queue))
        if not len(some):
            continue
        a, b, at = a[some], b[some], at[some]
        steps, left = schedule.window * schedule.share[alive], schedule.totals[alive] - given
        whole = int(schedule.share[alive].sum())
        # the last round that starts at or before a token: floor(r * step / whole) <= token
        r0, r1 = -(-(a + 1) * whole // steps[at]) - 1, -(-b * whole // steps[at]) - 1
        n = r1 - r0 + 1
        which = np.repeat(np.arange(len(a)), n)
        r = r0[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = at[which]
        dealt_before = r * steps[own] // whole
        start, stop = np.maximum(a[which], dealt_before), np.minimum(b[which], (r + 1) * steps[own] // whole)
        full = np.flatnonzero(stop > start)
        which, r, own, dealt_before, start, stop = (x[full] for x in (which, r, own, dealt_before, start, stop))
        place = base + start - dealt_before
        # what all queues gave before the round, and the queues before this one in it; `cells` bounds the table
        order = np.argsort(r, kind="stable")
        distinct, begin = np.unique(r[order], return_index=True)
        ends = np.append(begin[1:], len(order))
        for k in range(0, len(distinct), step := max(1, cells // len(alive))):
            rows = distinct[k : k + step]
            got = rows[:, None] * steps // whole
            turn = np.minimum((rows[:, None] + 1) * steps // whole, left) - got
            pieces = order[begin[k] : ends[k + len(rows) - 1]]
            row = np.searchsorted(rows, r[pieces])
            place[pieces] += got.sum(1)[row] + (np.cumsum(turn, 1) - turn)[row, own[pieces]]
        out.append((some[which], start + given[own], stop - start, place))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cut(which: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces that lie over the end of a window are cut there (none is longer than a window)."""
    room = window - place % window
    over = np.flatnonzero(n > room)
    tail = (which[over], start[over] + room[over], n[over] - room[over], place[over] + room[over])
    head = (which, start, np.minimum(n, room), place)
    return tuple(np.concatenate(x) for x in zip(head, tail, strict=True))


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ordered documents with their ids and the tokens before them in this part of their queue."""
    cache = worker_cache(path, False)
    part, queue, before = TaskContext.get().partitionId(), object(), 0
    narrow = load(path).get_vocab_size() < 1 << 16
    for whole in batches:
        for batch in sliced(whole, "text", 2 << 20):
            queues, at, sizes, held = batch.column("queue").to_pylist(), [], [], []
            ids, first = with_end(*cache.encode(batch.column("text")), end_id)
            ids = ids.astype("<u2" if narrow else "<u4")
            for name, a, b in zip(queues, first[:-1].tolist(), first[1:].tolist(), strict=True):
                if name != queue:
                    queue, before = name, 0
                at.append(before)
                sizes.append(b - a)
                before += b - a
                held.append(ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), batch.column("queue"), pa.array(at, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], [x.split(" ")[0] for x in TOKENS.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """The pieces of all docs (doc_id, source, text).

    weights: target share by source (default for those not named: 1); without it, each source's
    share is its share of all tokens, so that the queues end together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("source").cast("string").alias("queue"), "doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    ordered = ordered.repartitionByRange(parts, "queue", "doc_id", "h", "tie").sortWithinPartitions("queue", "doc_id", "h", "tie").select("queue", "doc_id", "text")
    held = stored(ordered.mapInArrow(lambda b: tokenized(b, tokenizer, end_id), TOKENS), "packing-tokens", compression="zstd")
    narrow = load(tokenizer).get_vocab_size() < 1 << 16

    sums = sorted(((r["queue"], r["part"], r["n"]) for r in held.groupBy("queue", "part").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))  # queues + parts rows at most
    of_queue: dict[str | None, int] = {}
    offsets: dict[tuple[str | None, int], int] = {}
    for q, p, n in sums:
        offsets[q, p] = of_queue.get(q, 0)
        of_queue[q] = offsets[q, p] + n
    names, totals = list(of_queue), list(of_queue.values())  # in the order of names
    number = {q: k for k, q in enumerate(names)}
    schedule = Schedule(totals, [float((weights or {}).get(q, 1)) for q in names] if weights else [float(t) for t in totals], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "ids"):
                queues, parts_ = batch.column("queue").to_pylist(), batch.column("part").to_pylist()
                docs_, ids = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
                n = np.asarray(batch.column("n"))
                first = np.asarray(batch.column("before")) + np.array([offsets[x] for x in zip(queues, parts_, strict=True)], dtype=np.int64)
                of = np.array([number[q] for q in queues])
                which, start, length, place = cut(*places(schedule, of, first, first + n), window)
                order = np.lexsort((start, which))
                which, start, length, place = (x[order] for x in (which, start, length, place))
                at = start - first[which]
                crcs, last, view = [], -1, memoryview(b"")
                for k, a, b in zip(which.tolist(), (4 * at).tolist(), (4 * (at + length)).tolist(), strict=True):
                    if k != last:
                        last, view = k, memoryview(np.frombuffer(ids[k], dtype="<u2").astype("<u4").tobytes() if narrow else ids[k])
                    crcs.append(zlib.crc32(view[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array([docs_[k] for k in which.tolist()], pa.int64()), pa.array(at), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[which]), pa.array(place // window), pa.array(place % window), pa.array([queues[k] for k in which.tolist()], pa.string())], [x.split(" ")[0] for x in PIECES.split(", ")])

    return held.mapInArrow(run, PIECES)

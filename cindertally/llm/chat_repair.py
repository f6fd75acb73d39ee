"""Repair of conversation structure: the cheapest edits after which roles read `(s?(ua)+)?`.

The rows of a conversation, by turn (nulls first; ties by role, then SHA-256 of the text), pass an
automaton of four states: nothing yet, after a system, user or assistant turn. Edits and their costs:
K(eep) 0, R(erole, to what is due) 2, D(elete) 3, I(nsert of an empty user or assistant turn) 2; a
truncated row that stays costs 1 more. Blank rows and duplicates (same role and text earlier) must go.
Of the cheapest edits those with the ASCII-least initials are chosen: the audit.

Hirschberg's divide and conquer: a forward vector of four costs from the start and a backward one from
the end meet at the middle row; the crossing with the least sum is taken, and both halves are solved
alike, in linear space. So that ties go to the least audit, the forward vector also carries the order
of the four best audits so far. (At one row no such audit is another's prefix: all of them end
with the letter of that row. So that order is all that later rows need.)

Long conversations are split: blocks of at most 2^12 rows are reduced to 4 x 4 costs each, the crossings
between a conversation's blocks are found by the same procedure over these matrices, and every block is
then solved by itself. Rows are placed by a range shuffle of small columns; texts move once, to meet the
edits. No task holds more of a conversation than one byte or a block's matrix for each of its blocks;
texts stream.

Cases: a null role or text counts as one space, a null conv_id is a conversation of its own. Roles are told
by their first character; an empty role can't be kept. Repeated rows are duplicates of each other.
Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Hashable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import BREAKS, small_batches

SPACE = " " + BREAKS
#: Rows of a block, as a power of two.
BLOCK_BITS = 12
FAR = 1 << 40
#: Where a turn of each role leads to, and from where it may come.
INITIALS = "sua"
NEXT = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
#: The role due in each state, and what is still to be inserted at the end.
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
#: The end of a conversation, where the state is free.
OPEN = 4

Vector = tuple[tuple[int, int], ...]


def row_matrix(code: int) -> tuple:
    """Cost and letters of the cheapest way from each state to each, over one row.

    code is 4 kinds (0 whole, 1 truncated, 2 to be deleted) by the initial (s, u, a, other).
    """
    kind, initial = divmod(code, 4)
    ways: list[list[list[tuple[int, str]]]] = [[[] for _ in range(4)] for _ in range(4)]
    for s in range(4):
        state, spent, letters = s, 0, ""
        while True:
            ways[s][state].append((spent + 3, letters + "D"))
            if kind < 2:
                if initial < 3 and state in NEXT[INITIALS[initial]][0]:
                    ways[s][NEXT[INITIALS[initial]][1]].append((spent + kind, letters + "K"))
                ways[s][NEXT[DUE[state][0]][1]].append((spent + 2 + kind, letters + "R"))
            if len(letters) == 2:  # two insertions reach every state that any number does
                break
            state, spent, letters = NEXT[DUE[state][0]][1], spent + 2, letters + "I"
    return tuple(tuple(min(ways[s][t], default=(FAR, "")) for t in range(4)) for s in range(4))


ROWS = [row_matrix(code) for code in range(12)]
START = [tuple((0 if x == s else FAR, 0) for x in range(4)) for s in range(4)]
END = [*(tuple(0 if x == s else FAR for x in range(4)) for s in range(4)), tuple(2 * len(TAIL[x]) for x in range(4))]


def matrix(step: Hashable) -> tuple:
    """Costs and keys of a step: a row's code, or a block's matrix as it is."""
    return ROWS[step] if isinstance(step, int) else step


@lru_cache(maxsize=1 << 16)
def ahead(vector: Vector, step: Hashable) -> tuple[int, Vector]:
    """The least cost taken out, and the vector after a step: cost and place in audit order of each state."""
    m = matrix(step)
    best = [min((vector[s][0] + m[s][t][0], vector[s][1], m[s][t][1]) for s in range(4) if vector[s][0] < FAR) for t in range(4)]
    least = min(b[0] for b in best)
    order = sorted(b[1:] for b in best if b[0] < FAR)
    return least, tuple((c - least, order.index((r, k))) if c < FAR else (FAR, 0) for c, r, k in best)


@lru_cache(maxsize=1 << 16)
def back(costs: tuple[int, ...], step: Hashable) -> tuple[int, ...]:
    """Costs to go before a step, less the least of them."""
    m = matrix(step)
    got = [min(m[s][t][0] + costs[t] for t in range(4)) for s in range(4)]
    least = min(got)
    return tuple(c - least if c < FAR else FAR for c in got)


def crossings(steps: Sequence[Hashable], start: int, end: int) -> list[int]:
    """The states after each step on the audit-least of the cheapest ways from start to end."""
    out = [0] * len(steps)
    todo = [(0, len(steps), start, end)] if steps else []
    while todo:
        lo, hi, s, e = todo.pop()
        mid = (lo + hi + 1) // 2
        forward = START[s]
        for k in range(lo, mid):
            forward = ahead(forward, steps[k])[1]
        backward = END[e]
        for k in range(hi - 1, mid - 1, -1):
            backward = back(backward, steps[k])
        out[mid - 1] = min(range(4), key=lambda x: (forward[x][0] + backward[x], forward[x][1]))
        if mid - lo > 1:
            todo.append((lo, mid, s, out[mid - 1]))
        if hi > mid:
            todo.append((mid, hi, out[mid - 1], e))
    return out


def reduced(codes: bytes) -> tuple:
    """A block's matrix: cost, and place in audit order, from each state to each."""
    out = []
    for s in range(4):
        vector, spent = START[s], 0
        for c in codes:
            least, vector = ahead(vector, c)
            spent += least
        out.append(tuple((c + spent, k) if c < FAR else (FAR, 0) for c, k in vector))
    return tuple(out)


def letters_of(codes: bytes, start: int, end: int) -> tuple[str, int]:
    """The audit of a block and its cost."""
    out, cost, s = [], 0, start
    for c, t in zip(codes, crossings(codes, start, end), strict=True):
        spent, letters = ROWS[c][s][t]
        out.append(letters)
        cost += spent
        s = t
    return "".join(out), cost


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text (one space for null), and the SHA-256 of the text."""
    held = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return held.withColumn("digest", F.unhex(F.sha2("text", 256)))


def initial(role: Column) -> Column:
    """0 to 2 for s, u, a; 3 for any other."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos (increasing in the order of a conversation), code and what is wrong with each row.

    The shuffle is by range over all columns of the order and a number of the row, so that neither a
    conversation nor a row repeated very often goes to one task.
    """
    body = F.rtrim("text", F.lit(SPACE))
    small = keyed(rows).select("conv_id", "turn", "role", "digest", initial(F.col("role")).alias("initial"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("_n"))
    order = ["conv_id", "turn", "role", "digest", "_n"]
    dealt = small.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(dealt.select("*", F.monotonically_increasing_id().alias("pos")).drop("_n"), "chat-rows", compression="zstd")
    first = held.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last")).filter("_first < _last")
    first = stored(first, "chat-first", compression="zstd")  # a plain shuffle on both sides, so that a hot row can be split
    met = held.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(duplicate, 2).when(F.col("open"), 3).otherwise(0)
    kind = F.when(F.col("fault").isin(1, 2), 2).when(F.col("fault") == 3, 1).otherwise(0)
    return met.select("conv_id", "turn", "pos", "initial", fault.alias("fault")).withColumn("code", 4 * kind + F.col("initial"))


BLOCKS = "conv_id {kind}, block long, codes binary, blank long, duplicate long, truncated long, illegal long, first int, last int, matrix array<int>"


def blocks(places: DataFrame) -> DataFrame:
    """The blocks of all conversations, with counts and matrices (32 numbers: costs, then places in audit order)."""
    small_batches(places.sparkSession)
    row = F.struct("pos", "code", "initial", "fault")
    grouped = places.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rows in batch.column("rows").to_pylist():
                faults, roles = [r["fault"] for r in rows], [r["initial"] for r in rows]
                codes = bytes(r["code"] for r in rows)
                m = reduced(codes)
                out.append((codes, faults.count(1), faults.count(2), faults.count(3), sum(map(illegal, roles, roles[1:])), roles[0], roles[-1], [min(c, FAR_INT) for w in m for c, _ in w] + [k for w in m for _, k in w]))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return stored(grouped.mapInArrow(run, BLOCKS.format(kind=dict(places.dtypes)["conv_id"])), "chat-blocks", compression="zstd")


#: What stands for FAR in a stored matrix.
FAR_INT = (1 << 31) - 1


def illegal(a: int, b: int) -> bool:
    """Whether initials a, b (0 to 3) aren't su, ua or au."""
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def unpacked(flat: Sequence[int]) -> tuple:
    """A matrix from its 32 numbers."""
    return tuple(tuple((FAR if flat[4 * s + t] == FAR_INT else flat[4 * s + t], flat[16 + 4 * s + t]) for t in range(4)) for s in range(4))


def audits(places: DataFrame) -> DataFrame:
    """A row for each block: conv_id, block, audit, cost and counts; a conversation's audit is theirs in order."""
    held = blocks(places)
    kind = dict(places.dtypes)["conv_id"]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                ends = crossings([unpacked(p["matrix"]) for p in parts], 0, OPEN)
                before = None
                for k, p in enumerate(parts):
                    seam = before is not None and illegal(before, p["first"])
                    out.append((conv, p["block"], ends[k - 1] if k else 0, ends[k], TAIL[ends[k]] if k == len(parts) - 1 else "", int(seam)))
                    before = p["last"]
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_c", "_b", "start", "end", "tail", "seam"])

    parts = held.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "matrix"))).alias("parts"))
    states = parts.mapInArrow(join_up, f"_c {kind}, _b long, start int, end int, tail string, seam long")
    met = held.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b", "matrix")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = [letters_of(c, s, e) for c, s, e in zip(*(batch.column(n).to_pylist() for n in ("codes", "start", "end")), strict=True)]
            tails = batch.column("tail").to_pylist()
            audit = pa.array([a + t for (a, _), t in zip(solved, tails, strict=True)], pa.string())
            cost = pa.array([c + 2 * len(t) for (_, c), t in zip(solved, tails, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "block", "blank", "duplicate", "truncated", "illegal", "seam")), audit, cost], ["conv_id", "block", "blank", "duplicate", "truncated", "illegal", "seam", "audit", "cost"])

    return stored(met.mapInArrow(solve, f"conv_id {kind}, block long, blank long, duplicate long, truncated long, illegal long, seam long, audit string, cost long"), "chat-audits", compression="zstd")


def reports(places: DataFrame, solved: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, counts of faults, cost and audit."""
    turns = places.groupBy("conv_id", "turn").agg(F.lit(1).alias("n")).groupBy(F.col("conv_id").alias("_c"))
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda b: b.getField("audit")), "")
    per = solved.groupBy("conv_id").agg(*sums, F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), F.sum("cost").alias("cost"), whole.alias("audit"))
    return per.join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R, I), turn, role, text.

    A conversation's turns lie together and in order within a partition. Its edits come first, then its
    rows, so that a task holds one letter a row and one row at a time.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)
    edits = solved.select("conv_id", F.lit(0).alias("what"), "block", F.lit(None).cast(kind["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    texts = keyed(rows).select("conv_id", F.lit(1).alias("what"), F.lit(None).cast("long").alias("block"), "turn", "role", "digest", "text")
    met = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "what", "block", "turn", "role", "digest").drop("digest", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = object()
        audit, at, state, place = "", 0, 0, 0
        pending: list[str] = []
        for batch in batches:
            out: list[tuple] = []

            def insertions() -> None:
                nonlocal at, state, place
                while audit[at : at + 1] == "I":
                    out.append((conv, place, "I", None, DUE[state], ""))  # noqa: B023
                    state, at, place = NEXT[DUE[state][0]][1], at + 1, place + 1

            for c, what, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "what", "turn", "role", "text")), strict=True):
                if c != conv:
                    conv, pending, audit, at, state, place = c, [], "", 0, 0, 0
                if what == 0:
                    pending.append(text)
                    continue
                if pending:
                    audit, pending = "".join(pending), []
                insertions()
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = DUE[state] if edit == "R" else role
                    state = NEXT[role[0]][1]
                    out.append((conv, place, edit, turn, role, text))
                    place += 1
                if at + 2 >= len(audit):  # nothing but insertions may follow the last row
                    if set(audit[at:]) <= {"I"}:
                        insertions()
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "turn", "role", "text"])

    return met.mapInArrow(run, f"conv_id {kind['conv_id']}, place long, edit string, turn {kind['turn']}, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of a repaired conversation's `role:text`, joined by line feeds.

    A hash is one chain: it takes turns as `repaired` leaves them, together and in order, and holds its state only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = None
        digest = None
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            out: list[tuple] = []
            for c, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                    digest.update(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["_c", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["_c", "repaired_sha256"])

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, f"_c {dict(turns.dtypes)['conv_id']}, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of `conversations`, about its rows in `rows`; without rows there: zeros and empty texts."""
    places = placed(rows)
    solved = audits(places)
    found = reports(places, solved).withColumnRenamed("conv_id", "_i").join(digests(repaired(rows, solved)), F.col("_i").eqNullSafe(F.col("_c")), "left").drop("_c")
    whole = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_i")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

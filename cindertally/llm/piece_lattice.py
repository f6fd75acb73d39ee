"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units wherever two neighbouring characters stand together in no piece: no merge and
no path reaches over such a place, so the units of a text have the ids of the whole. Every substring of
bounded length of a unit is exploded and equi-joined to the piece table, which is of the vocabulary's size
and broadcast; the edges found are grouped by unit again and folded to ids:
- `unigram` models: Viterbi, a Spark higher-order aggregate over the edges in order of their ends;
- `bpe` models: the library joins neighbouring symbols in order of score, which no sum over a path
  gives. The same edges are folded by that rule, in Arrow batches.
Units are counted over all texts. The most frequent ones (`hot` at most, by their exact counts) pass the
lattice once, grouped by shuffle, and their ids go to every worker. Of the others, the distinct units of
each slice of texts pass the lattice in their own task, ahead of the slice's texts: exploding and a
broadcast join keep the order of rows, so that the edges of a unit arrive together and right before the
texts that need them. Neither texts nor their ids are shuffled or stored. Decoding looks pieces up by id.

Units are found among the hot ones by 64-bit hashes under a key drawn for the run; all other joins are on
the units themselves.

Cases: null and empty texts have no ids. Characters without a piece become byte pieces, or
the unknown id where the model has none. Repeated rows are encoded each. An empty table gives an empty result. Other
columns play no part. A unit may be of any length. `decodes` is false where a text itself holds the
boundary sign, which the model turns into a space.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .columns import sliced, small_batches
from .encoding import spread
from .textbytes import Words, new_key, text_bytes

BOUNDARY = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, score of a model's ordinary pieces."""
    model = processor(path)
    n = model.get_piece_size()
    rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return spark.createDataFrame(pa.table([pa.array(x) for x in zip(*rows, strict=True)], ["piece", "id", "score"]).to_pandas(), "piece string, id int, score float")


#: An edge as one number: start, length and id; NO_ID for a single character without a piece.
START, LENGTH, NO_ID = 1 << 32, 1 << 24, (1 << 24) - 1


def spans(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """words (word and any other columns), s (first character, from 1), l and the id and score of every piece in a word.

    A single character stays without a piece (id null), so that no word is lost; a null word stays as one row.
    """
    keep = words.columns
    starts = words.select(*keep, F.explode_outer(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    ahead = starts.select(*keep, "s", F.substring(F.col("word"), F.col("s"), F.lit(longest)).alias("ahead"))
    cut = ahead.select(*keep, "s", "ahead", F.explode_outer(F.sequence(F.lit(1), F.length("ahead"))).alias("l"))
    return cut.withColumn("piece", F.substring(F.col("ahead"), F.lit(1), F.col("l"))).drop("ahead").join(F.broadcast(pieces), "piece", "left").filter("id is not null or l = 1 or l is null")


def packed() -> Column:
    """An edge of spans as one number; null for a null word."""
    return (F.col("s") - 1).cast("long") * START + F.col("l") * LENGTH + F.coalesce("id", F.lit(NO_ID))


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word and its lattice as an array of packed numbers."""
    return spans(words, pieces, longest).groupBy("word").agg(F.collect_list(packed()).alias("edges"))


def viterbi(word: Column, lattice: Column, longest: int, unknown: float, zero_byte: int | None, unknown_id: int = 0) -> Column:
    """The ids on the best path through a word: a fold over its positions, and one back over the choices.

    lattice: for each position in order the edges (start, id, score) that end there. The state holds
    the best scores of the last `longest` positions only, so that the work is linear in the edges. A
    single character without a piece is an edge of the unknown score; it becomes byte pieces
    (zero_byte is the id of <0x00>) or the unknown id. Of equal scores the earliest start stays.
    """

    def in_bytes(at: Column) -> Column:
        if zero_byte is None:
            return F.array(F.lit(unknown_id))
        pairs = F.hex(F.substring(word, at, F.lit(1)).cast("binary"))
        return F.transform(F.sequence(F.lit(1), F.length(pairs), F.lit(2)), lambda k: (F.conv(F.substring(pairs, k, F.lit(2)), 16, 10) + zero_byte).cast("int"))

    def forward(state: Column, x: Column) -> Column:
        scores, n, tail = state.getField("scores"), F.size(state.getField("scores")), state.getField("tail")
        full = F.size(tail) >= 128  # choices are kept in parts: adding one copies a part, not all
        here = F.transform(x.getField("own"), lambda e: F.struct((F.get(scores, n - (x.getField("end") - e.getField("start"))) + F.coalesce(e.getField("score").cast("double"), F.lit(unknown))).alias("score"), (-e.getField("start")).alias("s"), F.coalesce(e.getField("id"), F.lit(-1)).alias("id")))
        made = F.transform(F.array(F.array_max(here)), lambda b: F.struct(F.slice(F.concat(scores, F.array(b.getField("score"))), F.greatest(n + 2 - longest, F.lit(1)), F.lit(longest)).alias("scores"), F.when(full, F.concat(state.getField("done"), F.array(tail))).otherwise(state.getField("done")).alias("done"), F.concat(F.when(full, nothing).otherwise(tail), F.array(F.struct((-b.getField("s")).alias("start"), b.getField("id").alias("id")))).alias("tail")))
        return F.get(made, 0)

    nothing = F.array().cast("array<struct<start:int,id:int>>")
    start = F.struct(F.array(F.lit(0.0).cast("double")).alias("scores"), F.array().cast("array<array<struct<start:int,id:int>>>").alias("done"), nothing.alias("tail"))
    back = F.aggregate(lattice, start, forward, lambda state: F.flatten(F.concat(state.getField("done"), F.array(state.getField("tail")))))

    def backward(state: Column, choices: Column) -> Column:
        at = state.getField("at")
        edge = F.get(choices, at - 1)
        own = F.when(edge.getField("id") < 0, in_bytes(at)).otherwise(F.array(edge.getField("id")))
        return F.when(at > 0, F.struct(edge.getField("start").alias("at"), F.concat(own, state.getField("ids")).alias("ids"))).otherwise(state)

    ids = F.transform(F.array(back), lambda choices: F.aggregate(choices, F.struct(F.size(choices).alias("at"), F.array().cast("array<int>").alias("ids")), lambda state, _: backward(state, choices), lambda state: state.getField("ids")))
    return F.get(ids, 0)


def unigram_ids(words: DataFrame, pieces: DataFrame, longest: int, unknown: float, zero_byte: int | None) -> DataFrame:
    """word, ids by Viterbi."""
    end = (F.col("s") + F.col("l") - 1).alias("end")
    ends = spans(words, pieces, longest).groupBy("word", end).agg(F.collect_list(F.struct((F.col("s") - 1).alias("start"), "id", "score")).alias("own"))
    lattice = ends.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "own"))).alias("lattice"))
    return lattice.select("word", viterbi(F.col("word"), F.col("lattice"), longest, unknown, zero_byte).alias("ids"))


SPAN = 1 << 24


def merged(n: int, found: dict[int, int], rank: list[float]) -> list[int]:
    """Ends of the symbols of a word of n characters: joins neighbours, the best rank first and the
    leftmost of equals, while they make a piece. found: ids by start * SPAN + end; rank: by id, low is good."""
    if n > 48:
        return merged_long(n, found, rank)
    cuts = list(range(n + 1))
    get = found.get
    while len(cuts) > 2:
        best, at = None, 0
        for k in range(len(cuts) - 2):
            edge = get(cuts[k] * SPAN + cuts[k + 2])
            if edge is not None and (best is None or rank[edge] < best):
                best, at = rank[edge], k
        if best is None:
            break
        del cuts[at + 1]
    return cuts


def merged_long(n: int, found: dict[int, int], rank: list[float]) -> list[int]:
    """The same by a heap of joins, for words of any length."""
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))  # neighbours of each cut
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        middle = after[a]
        if middle < n:
            edge = found.get(a * SPAN + after[middle])
            if edge is not None:
                heapq.heappush(heap, (rank[edge], a, middle, after[middle]))

    for a in range(n):
        offer(a)
    gone = bytearray(n + 1)
    while heap:
        _, a, middle, b = heapq.heappop(heap)
        if gone[a] or gone[middle] or gone[b] or after[a] != middle or after[middle] != b:
            continue
        gone[middle] = 1
        after[a], before[b] = b, a
        offer(a)
        if a > 0:
            offer(before[a])
    return [k for k in range(n + 1) if not gone[k]]


def folded(words: list[str], flat: np.ndarray, offsets: np.ndarray, byte_id: dict[int, int], rank: list[float]) -> list[list[int]]:
    """The ids of words by merges; word k has the packed edges flat[offsets[k]:offsets[k + 1]]."""
    ids = flat & NO_ID
    start = flat // START
    key = start * SPAN + start + (flat // LENGTH & 0xFF)
    some = np.flatnonzero(ids != NO_ID)
    ends = np.searchsorted(some, offsets).tolist()
    key, ids = key[some].tolist(), ids[some].tolist()
    out = []
    for word, a, b in zip(words, ends, ends[1:], strict=False):
        found = dict(zip(key[a:b], ids[a:b], strict=True))
        cuts = merged(len(word), found, rank)
        own: list[int] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            edge = found.get(x * SPAN + y)
            if edge is None:
                own += [byte_id[v] for v in word[x:y].encode()]
            else:
                own.append(edge)
        out.append(own)
    return out


def bpe_ids(words: DataFrame, pieces: DataFrame, longest: int, byte_id: dict[int, int], rank: list[float]) -> DataFrame:
    """word, ids by merges over the lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("edges")
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out = folded(batch.column("word").to_pylist(), np.asarray(lists.flatten()), offsets, byte_id, rank)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.list_(pa.int32()))], ["word", "ids"])

    return edges(words, pieces, longest).mapInArrow(run, "word string, ids array<int>")


def lattices(words: list[str], flat: np.ndarray, offsets: np.ndarray, score: np.ndarray) -> pa.Array:
    """The lattice of each word as viterbi() takes it: its ends in order, each with the edges (start, id, score) there."""
    of = np.repeat(np.arange(len(words)), np.diff(offsets))
    start, ids = flat // START, flat & NO_ID
    end = start + (flat // LENGTH & 0xFF)
    order = np.lexsort((start, end, of))
    of, start, end, ids = of[order], start[order], end[order], ids[order]
    new = np.append(True, (of[1:] != of[:-1]) | (end[1:] != end[:-1]))[: len(of)]
    first = np.flatnonzero(new)
    none = ids == NO_ID
    edge = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(ids, pa.int32(), mask=none), pa.array(score[np.where(none, 0, ids)], pa.float32(), mask=none)], ["start", "id", "score"])
    own = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), edge)
    at = pa.StructArray.from_arrays([pa.array(end[first], pa.int32()), own], ["end", "own"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(len(words) + 1)), pa.int32()), at)


@lru_cache(maxsize=2)
def neighbours(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each code point among the characters of a model's pieces (the last for any other), which two of
    these stand together in one (bit first * n + second, the low bit of a byte first), and n."""
    model = processor(path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    code = np.frombuffer("\0".join(texts).encode("utf-32-le"), dtype="<u4")
    chars = np.unique(code[code > 0])
    n = len(chars) + 1
    number = np.full(0x110000, n - 1, dtype=np.uint16 if n < 1 << 16 else np.int32)
    number[chars] = np.arange(n - 1)
    number[ord(" ")] = number[ord(BOUNDARY)]
    meet = np.zeros(n * n, dtype=bool)
    both = (code[1:] > 0) & (code[:-1] > 0)
    meet[number[code[:-1][both]].astype(np.int64) * n + number[code[1:][both]]] = True
    return number, np.packbits(meet, bitorder="little"), n


def pieces_of(texts: pa.Array, path: str) -> Words:
    """Units of texts that begin with a space (empty ones apart): cut where two characters stand together in no piece."""
    number, meet, n = neighbours(path)
    raw, ends = text_bytes(texts)
    at = number[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype="<u4")]
    place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each character in raw
    begins, pair = np.ones(len(at), dtype=bool), at[:-1].astype(np.int32 if n * n < 1 << 31 else np.int64) * n + at[1:]
    begins[1:] = meet[pair >> 3] >> (pair & 7).astype(np.uint8) & 1 == 0
    begins[np.searchsorted(place, ends[:-1][np.diff(ends) > 0])] = True
    start = place[np.flatnonzero(begins)]
    end = np.append(start[1:], len(raw)) if len(start) else start
    return Words(raw, ends, start, end, np.searchsorted(start, ends))


def spaced(docs: DataFrame) -> DataFrame:
    """doc_id, body: the text with the leading space that the model puts before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.when(text == "", "").otherwise(F.concat(F.lit(" "), text)).alias("body"))


def distinct_words(docs: DataFrame, path: str, most: int = 200_000) -> DataFrame:
    """word (spaces as boundary signs) and n, its uses: counted by task (`most` words at a time), then by hash."""
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        words: dict[int, str] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([words[h] for h in met], pa.string()), pa.array(met.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in sliced(whole, "body", 1 << 20):
                w = pieces_of(batch.column("body"), path)
                unique, place, n = np.unique(w.hashes(key=key), return_index=True, return_counts=True)
                data = w.raw.tobytes()
                for h, a, b, c in zip(unique.tolist(), w.start[place].tolist(), w.end[place].tolist(), n.tolist(), strict=True):
                    if h in met:
                        met[h] += c
                    else:
                        met[h], words[h] = c, data[a:b].decode().replace(" ", BOUNDARY)
                if len(met) > most:
                    yield given()
                    met, words = {}, {}
        yield given()

    return spaced(docs).select("body").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Hot:
    """Ids of the most frequent words, looked up by the keyed hash of their bytes."""

    def __init__(self, rows: pa.Table):
        words = pa.array([w.replace(BOUNDARY, " ") for w in rows["word"].to_pylist()], pa.string())
        raw, ends = text_bytes(words)
        self.secret = new_key()
        key = Words(raw, ends, ends[:-1], ends[1:], ends).hashes(key=self.secret)
        order = np.argsort(key)
        ids = rows["ids"].combine_chunks()
        n = np.diff(np.asarray(ids.offsets)).astype(np.int64)
        pool = np.asarray(ids.flatten())[spread((np.cumsum(n) - n)[order], n[order])]
        self.key, self.first = key[order], np.concatenate([[0], np.cumsum(n[order])]).astype(np.int32)
        self.pool = pool.astype(np.uint16 if len(pool) and pool.max() < 1 << 16 else np.int32)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and whether it is there."""
        hashes = w.hashes(key=self.secret)
        pos = np.searchsorted(self.key, hashes)
        if not len(self.key):
            return pos, np.zeros(len(hashes), dtype=bool)
        pos[pos == len(self.key)] = 0
        return pos, self.key[pos] == hashes


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each id's bytes (with spaces for boundary signs) begin, how many they are, and all bytes."""
    model = processor(path)
    texts = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(BOUNDARY, " ").encode() for i in range(model.get_piece_size())]
    n = np.array([len(x) for x in texts])
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(texts), dtype=np.uint8)


def decoded(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of ids, with the leading space."""
    at, n, pool = piece_bytes(path)
    return pool[spread(at[ids], n[ids])]


def laid(top: Hot, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all hot words in order, how many each word has, and which words are hot."""
    pos, known = top.find(w)
    pos = pos[known]
    n = np.zeros(len(known), dtype=np.int64)
    n[known] = top.first[pos + 1] - top.first[pos]
    return top.pool[spread(top.first[pos], n[known])], n, known


ENCODED = "doc_id long, n_bytes long, ids binary, decodes boolean"
LATTICE = "array<struct<end:int,own:array<struct<start:int,id:int,score:float>>>>"
LATTICE_TYPE = pa.list_(pa.struct([("end", pa.int32()), ("own", pa.list_(pa.struct([("start", pa.int32()), ("id", pa.int32()), ("score", pa.float32())])))]))


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """The rows of units since the last texts (k is theirs), and the texts that follow them."""
    units: list[pa.RecordBatch] = []
    for batch in batches:
        of_text = np.asarray(batch.column("k").is_null())
        bounds = [0, *(np.flatnonzero(of_text[1:] != of_text[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a and of_text[a]:
                yield units, batch.column("text").slice(a, b - a)
                units = []
            elif b > a:
                units.append(batch.slice(a, b - a))
    if units:
        raise RuntimeError("units without texts after them")


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, `most` at most: those above a count that a histogram tells (64 classes a power of two)."""
    level = F.floor(F.log2("n") * 64)
    held, low = 0, None
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows a power of two
        if (held := held + r["count"]) > most:
            break
        low = r["level"]
    return words.filter(level >= low) if low is not None else words.limit(0)


def digest_of(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def encode(docs: DataFrame, path: str, kind: str = "bpe", hot: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, ids, and decodes (whether the ids give the text back) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = processor(path)
    pieces = piece_table(spark, path)
    size = model.get_piece_size()
    longest = max(len(model.id_to_piece(i)) for i in range(size))
    if longest >= 256:
        raise ValueError("pieces of 256 characters or more don't fit a packed edge")
    byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
    score = np.array([model.get_score(i) for i in range(size)])
    rank, low = (-score).tolist(), float(min(score[i] for i in range(size) if not (model.is_control(i) or model.is_unknown(i))))
    words = most_frequent(stored(distinct_words(docs, path), "word-counts", compression="zstd"), hot)
    table = bpe_ids(words, pieces, longest, byte_id, rank) if kind == "bpe" else unigram_ids(words, pieces, longest, low - 10.0, byte_id.get(0))
    top = Hot(table.select("word", "ids").toArrow())  # `hot` rows at most
    short = "<u2" if size < 1 << 16 else "<u4"

    def with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice of texts the distinct units that aren't hot, numbered through the task, then the texts.

        A text is packed into one value, since rows of edges are many and each would carry its columns as nulls:
        doc_id, n_bytes, digest, the ids of its hot units, before which of these others are missing, and their numbers.
        """
        given = 0
        for whole in batches:
            for batch in sliced(whole, "body", 1 << 19):
                w = pieces_of(batch.column("body"), path)
                ids, n, known = laid(top, w)
                ends = np.concatenate([[0], np.cumsum(n)])
                gaps, data = np.flatnonzero(~known), w.raw.tobytes()
                met: dict[bytes, int] = {}
                unit = np.array([met.setdefault(data[a:b], len(met)) for a, b in zip(w.start[gaps].tolist(), w.end[gaps].tolist(), strict=True)], dtype=np.int64)
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(range(given, given + len(met)), pa.int64()), pa.array([x.decode().replace(" ", BOUNDARY) for x in met], pa.string()), pa.nulls(len(met), pa.binary())], ["k", "word", "text"])
                of, flat = np.searchsorted(gaps, w.first), ids.astype(short)
                rows = []
                for j, doc in enumerate(batch.column("doc_id").to_pylist()):
                    a, own = w.first[j], slice(of[j], of[j + 1])
                    text = data[w.ends_of[j] : w.ends_of[j + 1]]
                    rows.append(pickle.dumps((doc, max(len(text) - 1, 0), digest_of(text), flat[ends[a] : ends[w.first[j + 1]]], ends[gaps[own]] - ends[a], unit[own] + given), 5))
                given += len(met)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.string()), pa.array(rows, pa.binary())], ["k", "word", "text"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Units (numbers, words, edges end to end, where each unit's begin; or None) and texts of a slice."""
        for units, texts in in_turn(batches):
            got = None
            if units:
                k, edge = (np.concatenate([np.asarray(x.column(c)) for x in units]) for c in ("k", "edge"))
                own = [v for x in units for v in x.column("word").drop_null().to_pylist()]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                if len(first) != len(own) or not (np.diff(k[first]) > 0).all():
                    raise RuntimeError("the edges of a unit don't stand together")
                got = k[first], own, edge, np.append(first, len(k))
            yield got, texts

    def filled(slices: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """The ids of whole texts, from those of the units before them (numbers, and a list each)."""
        number, n, at, pool = (np.zeros(0, dtype=np.int64) for _ in range(4))
        for units, texts in slices:
            if units:
                number, lists = units
                n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                at, pool = np.cumsum(n) - n, np.asarray(lists.flatten())
            rows = []
            for x in texts.to_pylist():
                doc, n_bytes, digest, whole, places, missing = pickle.loads(x)
                whole = whole.astype("<u4")
                if len(missing):
                    k = np.minimum(np.searchsorted(number, missing), len(number) - 1)
                    if not len(number) or not np.array_equal(number[k], missing):
                        raise RuntimeError("a text stands before its units")
                    whole = np.insert(whole, np.repeat(places, n[k]), pool[spread(at[k], n[k])])
                rows.append((doc, n_bytes, whole.tobytes(), digest_of(decoded(whole, path).tobytes()) == digest))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["doc_id", "n_bytes", "ids", "decodes"])

    def by_merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filled((u and (u[0], pa.array(folded(*u[1:], byte_id, rank), pa.list_(pa.int32()))), texts) for u, texts in gathered(batches))

    def to_lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, texts in gathered(batches):
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1], pa.string()), lattices(*u[1:], score), pa.nulls(len(u[1]), pa.binary())], ["k", "word", "lattice", "text"])
            none = (pa.nulls(len(texts), t) for t in (pa.int64(), pa.string(), LATTICE_TYPE))
            yield pa.RecordBatch.from_arrays([*none, texts], ["k", "word", "lattice", "text"])

    def by_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda units, c: pa.chunked_array([x.column(c) for x in units]).combine_chunks()
        yield from filled(((np.asarray(joined(units, "k")), joined(units, "ids")) if units else None, texts) for units, texts in in_turn(batches))

    mixed = spaced(docs).mapInArrow(with_units, "k long, word string, text binary")
    edged = spans(mixed, pieces, longest).select("k", F.when((F.col("s") == 1) & (F.col("l") == 1), F.col("word")).alias("word"), packed().alias("edge"), "text")
    if kind == "bpe":
        return edged.mapInArrow(by_merges, ENCODED)
    paths = edged.mapInArrow(to_lattices, f"k long, word string, lattice {LATTICE}, text binary")
    ids = F.when(F.col("k").isNotNull(), viterbi(F.col("word"), F.col("lattice"), longest, low - 10.0, byte_id.get(0)))
    return paths.select("k", ids.alias("ids"), "text").mapInArrow(by_paths, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of encoded ids (little-endian unsigned 32-bit): pieces looked up by id and laid end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(np.frombuffer(x or b"", dtype="<u4"), path).tobytes()[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

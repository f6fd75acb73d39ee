"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are dealt out by range of doc_id, encoded in that order and gathered in blocks of
about `block_tokens` ids. A block ranks its distinct ids by frequency and stores ranks in one,
two or three bytes; the lengths of four ranks at a time lie in a control byte of their own, so
that a decoder looks the four up in a table. A file is one Parquet part of blocks; each block
can be decoded alone, and knows how many ids of its part come before it.

Cases: a null or empty text has only the end id. Repeated rows are written once each, and rows of one
doc_id can lie in several parts (ordered by a hash of the text). Ids of
documents may be null (they come first). An empty table gives no block. Other columns play no
part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .columns import sliced, small_batches
from .encoding import with_end, worker_cache

BLOCK = "part int, start_in_part long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, ranked binary, control binary, data binary"
#: For each control byte, the lengths of its four ranks.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The ids by falling frequency, control bytes and data bytes."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    ranked = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids]
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    four[: len(ids)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(code, dtype=np.int64) + np.arange(1, len(ids) + 1)
    starts = ends - code - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    data[starts] = ranks & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(code >= k)
        if not len(longer):
            break
        data[starts[longer] + k] = ranks[longer] >> (8 * k) & 0xFF
    return ranked.tobytes(), control.tobytes(), data.tobytes()


def unpack(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        if not len(longer):
            break
        ranks[longer] |= raw[starts[longer] + k].astype(np.uint32) << (8 * k)
    return np.frombuffer(ranked, dtype="<u4")[ranks]


def blocks(batches: Iterator[pa.RecordBatch], path: str, keeps_space: bool, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) in order, as blocks."""
    cache = worker_cache(path, keeps_space)
    part, before = TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        nonlocal before
        sizes = np.concatenate(lengths)
        ranked, control, data = pack(np.concatenate(held))
        row = [part, before, int(sizes.sum()), docs, sizes, ranked, control, data]
        before += row[2]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split(" ")[0] for x in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for whole in batches:
        for batch in sliced(whole, "text", 2 << 20):
            ids, first = with_end(*cache.encode(batch.column("text")), end_id)
            docs += batch.column("doc_id").to_pylist()
            held.append(ids)
            lengths.append(np.diff(first))
            if sum(map(len, held)) >= block_tokens:
                yield closed()
                docs, held, lengths = [], [], []
    if docs:
        yield closed()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool = True, end_id: int = 0, parts: int | None = None, block_tokens: int = 1 << 19) -> None:
    """Encodes docs (doc_id, text) and writes their token files at `path`, in ascending order of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie")).repartitionByRange(parts, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie").select("doc_id", "text")
    ordered.mapInArrow(lambda b: blocks(b, tokenizer, keeps_space, end_id, block_tokens), BLOCK).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), from the files alone."""
    return _decoded(spark, path, lambda ids: ids, "ids binary", pa.binary())


def _decoded(spark: SparkSession, path: str, made, column: str, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema(BLOCK).parquet(path)
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row for each file
    offsets, sofar = {}, 0
    for part, n in totals:
        offsets[part], sofar = sofar, sofar + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["ranked"], row["control"], row["data"], row["n_tokens"]).astype("<u4").tobytes()
                lengths = np.asarray(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                out = [made(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = offsets[row["part"]] + row["start_in_part"] + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(out, kind)], ["doc_id", "start", "n_tokens", column.split(" ")[0]])

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_digests(docs: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = 0) -> DataFrame:
    """Writes docs to token files in the shared folder and reads back doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, keeps_space, end_id)
    return _decoded(docs.sparkSession, path, zlib.crc32, "ids_crc32 long", pa.int64())

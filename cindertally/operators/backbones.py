"""A registry of embedding functions with ordered fallback, and batched inference over them.

A backbone is a loader: it returns a function from a list of inputs to a matrix, or raises or returns
None where it can't be had (weights missing). Nothing here downloads; the box has no image backbones,
so `stored_vectors` (a column of vectors) and `hashed_text` (signed token hashing) are what is provided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list], np.ndarray]
Loader = Callable[[], Embed | None]


def stored_vectors() -> Embed:
    """Inputs are vectors already."""
    return lambda rows: np.array(rows, dtype=np.float32)


def hashed_text(width: int = 64) -> Embed:
    """Inputs are texts: signed counts of their words' hashes."""

    def embed(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), width), dtype=np.float32)
        for k, text in enumerate(rows):
            for word in (text or "").split():
                h = crc32(word.encode())
                out[k, h % width] += 1 if h >> 31 else -1
        return out

    return embed


REGISTRY: dict[str, Sequence[Loader]] = {"vectors": [stored_vectors], "text": [hashed_text]}


def loaded(loaders: Sequence[Loader]) -> tuple[int, Embed] | None:
    """The first loader of these that works, and its place; None if none does."""
    for k, loader in enumerate(loaders):
        try:
            embed = loader()
        except Exception:  # a backbone that can't be loaded is passed over, whatever the reason
            continue
        if embed is not None:
            return k, embed
    return None


def available(wanted: Sequence[str], registry: Mapping[str, Sequence[Loader]] = REGISTRY) -> list[str]:
    """The wanted backbones of which some loader works, in order; the others are left out."""
    return [name for name in wanted if loaded(registry.get(name, ())) is not None]


def embedded(df: DataFrame, key: str, column: str, backbone: str, registry: Mapping[str, Sequence[Loader]] = REGISTRY, batch: int = 64) -> DataFrame:
    """key, embedding and used (the place of the loader that worked), `batch` rows at a time."""
    loaders = list(registry[backbone])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = loaded(loaders)
        if found is None:
            raise RuntimeError(f"no loader of {backbone} works")
        used, embed = found
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                made = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made), pa.list_(pa.float32())), pa.array([used] * part.num_rows, pa.int32())], ["key", "embedding", "used"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(column).alias("x")).mapInArrow(run, f"key {kind}, embedding array<float>, used int").withColumnRenamed("key", key)

"""Words and shingles of many texts at once, in numpy, over the bytes of an Arrow column."""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: 1 for the bytes \\x20 and \\x09-\\x0D that part words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of a word that are hashed eight at a time; longer words go through a cryptographic hash.
LANES = 8
LONG = 8 * LANES
#: What is kept of a lane that holds 0 to 8 bytes of a word.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def new_key() -> int:
    """A key for the hashes of one run. Drawn anew, so that no text can be written to collide."""
    return secrets.randbits(63)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts: where each starts and ends in `raw`, and the first word of each text."""

    raw: np.ndarray  # bytes of all texts, end to end
    ends_of: np.ndarray  # n + 1 byte offsets of the texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1: words of text k are first[k]:first[k + 1]
    wide: np.ndarray | None = None  # the eight bytes from every place of raw on
    lower: bool = False

    def lane(self, k: int, some: np.ndarray | slice = slice(None), lower: bool = False) -> np.ndarray:
        """Bytes 8k to 8k + 7 of these words as a number; what lies beyond a word's end is 0."""
        if self.wide is None or self.lower != lower:
            held = np.zeros(len(self.raw) + 8 * (LANES + 1), dtype=np.uint8)
            held[: len(self.raw)] = LOWER[self.raw] if lower else self.raw
            self.wide, self.lower = np.ndarray((len(self.raw) + 8 * LANES,), dtype="<u8", buffer=held, strides=(1,)), lower
        start = self.start[some] + 8 * k
        return self.wide[start] & KEPT[np.clip(self.end[some] - start, 0, 8)]

    def hashes(self, lower: bool = False, key: int = 0) -> np.ndarray:
        """64-bit keyed hash of each word's bytes: each lane is mixed into what came before it."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) ^ np.uint64(key))
        if len(h):
            h = mix(h ^ self.lane(0, lower=lower))
        for k in range(1, LANES):
            some = np.flatnonzero(size > 8 * k)
            if not len(some):
                break
            h[some] = mix(h[some] ^ self.lane(k, some, lower))
        over = np.flatnonzero(size > LONG)
        if len(over):
            data = (LOWER[self.raw] if lower else self.raw).tobytes()
            own = key.to_bytes(8, "little")
            h[over] = [int.from_bytes(blake2b(data[a:b], digest_size=8, key=own).digest(), "little") for a, b in zip(self.start[over].tolist(), self.end[over].tolist(), strict=True)]
        return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end (null is empty), and where each text starts (n + 1)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    return raw, ends - ends[0]


def split_words(texts: pa.Array, breaks: np.ndarray = SPACE) -> Words:
    """Words (runs of bytes that `breaks` doesn't mark) of a string column; null is empty."""
    raw, ends = text_bytes(texts)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~breaks[raw]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edge = ends[(ends > 0) & (ends < len(raw))]
    begins[edge] |= inside[1:-1][edge]
    stops[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(raw, ends, start, end, np.searchsorted(start, ends))


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, in order, and each text's first one (n + 1).

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    room = np.minimum(np.repeat(first[1:], count) - at, size)
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        total = room.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        factor = np.uint64(0xE7037ED1A0B428DB)
        for k in range(size):
            total = total * factor + np.where(room > k, padded[at + k], np.uint64(0))
        return mix(total), begin

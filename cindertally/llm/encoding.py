"""Token ids of whole texts by the tokenizers library, with a cache of the words between spaces.

Texts are cut where that gives the ids of the whole text:
- byte-level BPE whose pre-tokenizer lets a space begin the next word (keeps_space): before every
  space that follows no white space, since no token reaches over such a place.
- BPE with word ends that drops white space: before every space.
Each distinct word is encoded by the library once per worker. Words are found by a hash whose key each
worker draws for itself, and every use is compared with the cached word's bytes: what differs goes to
the library. Words of more than 64 bytes are never kept. The cache has a bound in words and ids, and
drops what it hasn't met lately.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textbytes import LANES, LONG, Words, new_key, text_bytes

SEPARATOR, TOGETHER = "<|endoftext|>", 200
@lru_cache(maxsize=4)
def load(path: str):
    """One tokenizer per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def after_white(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space (Unicode's, or bytes that could be) ends right before these places."""
    held = np.concatenate([np.zeros(3, np.uint8), raw])
    one, two, three = held[at + 2], held[at + 1], held[at]
    white = (one == 0x20) | ((one >= 0x09) & (one <= 0x0D)) | ((one >= 0x1C) & (one <= 0x1F))
    white |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    return white | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))


def pieces(texts: pa.Array, keeps_space: bool) -> Words:
    """The texts cut before spaces, where that can't change their ids."""
    raw, ends = text_bytes(texts)
    space = np.flatnonzero(raw == 0x20)
    if keeps_space and len(space):
        space = space[~after_white(raw, space)]
    start = np.sort(np.concatenate([space, ends[:-1][np.diff(ends) > 0]]))
    if len(start):
        start = start[np.append(True, start[1:] != start[:-1])]
    end = np.append(start[1:], len(raw)) if len(start) else start
    return Words(raw, ends, start, end, np.searchsorted(start, ends))


class WordCache:
    """Encodes texts to unsigned 32-bit ids. most: words kept; most_ids: ids kept."""

    def __init__(self, path: str, keeps_space: bool, most: int = 1_000_000, most_ids: int = 8_000_000):
        self.tokenizer, self.keeps_space, self.most, self.most_ids = load(path), keeps_space, most, most_ids
        self.mark = self.tokenizer.token_to_id(SEPARATOR)
        self.secret = new_key()
        self.turn = 0
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)  # sorted hashes of the words known
        self.entry = np.zeros(0, dtype=np.int64)  # the number of each
        self.count = self.used = 0  # words and ids held; the arrays have room for more
        self.lanes = np.zeros((0, LANES), dtype=np.uint64)  # by number: bytes, size, place in pool, ids, turn of last use
        self.size, self.at, self.n, self.met = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.pool = np.zeros(0, dtype=np.uint32)

    def library(self, words: list[str]) -> list[np.ndarray]:
        """The library's ids of each word. Many go in one call, parted by a special token that none of them holds."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        apart = [k for k, w in enumerate(words) if self.mark is None or "<|" in w or len(w) > 1000]
        for k, e in zip(apart, self.tokenizer.encode_batch([words[k] for k in apart], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=np.uint32)
        odd = set(apart)
        rest = [k for k in range(len(words)) if k not in odd]
        groups = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([SEPARATOR.join(words[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            stops = np.flatnonzero(ids == self.mark)
            for k, a, b in zip(group, [0, *(stops + 1).tolist()], [*stops.tolist(), len(ids)], strict=True):
                out[k] = ids[a:b]
        return out

    def learn(self, keys: np.ndarray, w: Words) -> None:
        """Adds words that the cache lacks; keys are their sorted hashes."""
        got = self.library(texts_of(w))
        n = np.array([len(x) for x in got], dtype=np.int64)
        where, a, b = np.searchsorted(self.key, keys), self.count, self.count + len(keys)
        self.key, self.entry = np.insert(self.key, where, keys), np.insert(self.entry, where, np.arange(a, b))
        self.lanes, self.size, self.at, self.n, self.met = (room(x, a, b) for x in (self.lanes, self.size, self.at, self.n, self.met))
        for k in range(LANES):
            self.lanes[a:b, k] = w.lane(k)
        self.size[a:b], self.at[a:b], self.n[a:b], self.met[a:b] = w.end - w.start, self.used + np.cumsum(n) - n, n, self.turn
        self.add(got)
        self.count = b

    def add(self, ids: list[np.ndarray]) -> None:
        """Puts ids behind the pool's."""
        more = np.concatenate([np.zeros(0, np.uint32), *ids])
        self.pool = room(self.pool, self.used, self.used + len(more))
        self.pool[self.used : self.used + len(more)] = more
        self.used += len(more)

    def forget(self) -> None:
        """Keeps the words met latest: half of the bounds at most."""
        keep = np.argsort(-self.met[: self.count], kind="stable")[: self.most // 2]
        keep = np.sort(keep[np.cumsum(self.n[keep]) <= self.most_ids // 2])
        number = np.full(self.count, -1)
        number[keep] = np.arange(len(keep))
        stays = number[self.entry] >= 0
        self.key, self.entry = self.key[stays], number[self.entry[stays]]
        self.pool = self.pool[spread(self.at[keep], self.n[keep])]
        self.lanes, self.size, self.n, self.met = self.lanes[keep], self.size[keep], self.n[keep], self.met[keep]
        self.at, self.count, self.used = np.cumsum(self.n) - self.n, len(keep), len(self.pool)

    def same(self, w: Words, entry: np.ndarray) -> np.ndarray:
        """Whether each word's bytes are those of its entry."""
        size = w.end - w.start
        out = size == self.size[entry]
        for k in range(LANES):
            some = np.flatnonzero(size > 8 * k)
            if not len(some):
                break
            out[some] &= w.lane(k, some) == self.lanes[entry[some], k]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (null is empty), and each text's first one (n + 1)."""
        w = pieces(texts, self.keeps_space)
        self.turn += 1
        short = np.flatnonzero(w.end - w.start <= LONG)
        v = some_words(w, short)
        unique, place, back = np.unique(v.hashes(key=self.secret), return_index=True, return_inverse=True)
        pos = np.searchsorted(self.key, unique)
        new = np.ones(len(unique), dtype=bool)
        if len(self.key):
            new = self.key[np.minimum(pos, len(self.key) - 1)] != unique
        if new.any():
            self.learn(unique[new], some_words(v, place[new]))
            pos = np.searchsorted(self.key, unique)
        self.met[self.entry[pos]] = self.turn
        entry = self.entry[pos][back]
        known = self.same(v, entry)
        n, at = np.zeros(len(w.start), dtype=np.int64), np.zeros(len(w.start), dtype=np.int64)
        n[short], at[short] = self.n[entry], self.at[entry]
        odd = np.setdiff1d(np.arange(len(w.start)), short[known])  # long, or of another word's hash
        kept = self.used
        if len(odd):
            got = self.library(texts_of(some_words(w, odd)))
            n[odd] = [len(x) for x in got]
            at[odd] = kept + np.cumsum(n[odd]) - n[odd]
            self.add(got)  # for this call only
        ids = self.pool[spread(at, n)]
        first = np.concatenate([[0], np.cumsum(n)])[w.first]
        self.used = kept
        if self.count > self.most or kept > self.most_ids or len(self.pool) > 2 * self.most_ids:
            self.forget()
        return ids, first

    def nbytes(self) -> int:
        """Memory of the cache."""
        return sum(x.nbytes for x in (self.key, self.entry, self.lanes, self.size, self.at, self.n, self.met, self.pool))


def room(x: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """The first `used` rows of x in an array with room for `wanted`."""
    if wanted <= len(x):
        return x
    out = np.zeros((max(wanted, wanted + len(x) // 2), *x.shape[1:]), dtype=x.dtype)
    out[:used] = x[:used]
    return out


def some_words(w: Words, which: np.ndarray) -> Words:
    """These words alone."""
    return Words(w.raw, w.ends_of, w.start[which], w.end[which], np.zeros(0, np.int64), w.wide, w.lower)


def texts_of(w: Words) -> list[str]:
    data = w.raw.tobytes()
    return [data[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indexes of runs of n from `at`, end to end."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + n, n)


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with the end id after them."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    after = first + np.arange(n + 1)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
    return out, after


@lru_cache(maxsize=4)
def worker_cache(path: str, keeps_space: bool) -> WordCache:
    """The cache of this worker process; tasks that share a worker share it."""
    return WordCache(path, keeps_space)

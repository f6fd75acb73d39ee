"""Line dedup by winnowing over line hashes.

A document's lines (parted by line feeds, trimmed, those without a word left out) are hashed under a
key drawn for the run. Every shortest run of lines with `min_words` words or more, reaching forwards
from a line or backwards from one, is a window; the place of its least line hash (the last of equals)
is selected. There is one row for each selected place: its line hash, the fingerprint, and the
windows that selected it. A run of min_words words that two places share holds a window, and so a
selected place, in common.

1. Selected places are counted by fingerprint. Those whose line is selected nowhere else go.
2. The windows of the places that stay are joined, by fingerprint and window digest, with the first
   place of the same ones (least doc_id, then line). A match is extended both ways from its
   fingerprint, to the ends of all windows that agree; each is min_words long or more.
3. The lines of the later places' windows are removed.

So a line goes exactly if it lies in a run of min_words words or more that also stands earlier: in
a document of lower id or further up in its own. The first place of every line stays. A passage that
begins or ends inside a longer line is no run of lines and stays.

Groups are never gathered: counts and first places have partial sums, and both sides of the joins are
stored tables, so that a fingerprint that very many documents hold can be split over tasks. What a
document gathers is bounded by its own windows.

Cases: null texts stay null, empty ones empty; blank lines stay. Repeated rows (same doc_id and
text) are one document and treated alike; rows of one doc_id with different texts are documents of
their own, ordered by a hash of the text. A row without doc_id stays as it is and is no first place.
An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import sliced, small_batches
from .textbytes import Words, mix, new_key, split_words

MIN_WORDS = 50
LINE_FEED = np.zeros(256, dtype=bool)
LINE_FEED[10] = True
#: run: digest of a window; s, e: its first and last line among those with a word; a, b: among all lines.
WINDOW = ("run long", "s int", "e int", "a int", "b int")
PLACES = f"doc long, h long, fp long, windows array<struct<{', '.join(x.replace(' ', ':') for x in WINDOW)}>>"


def hashed_lines(texts: pa.Array, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, words and number (among all lines of its text) of each line with a word; and each text's first one."""
    lines, words = split_words(texts, LINE_FEED), split_words(texts)
    a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    full = np.flatnonzero(b > a)
    a, b = a[full], b[full]
    trimmed = Words(words.raw, words.ends_of, words.start[a] if len(a) else a, words.end[b - 1] if len(b) else b, np.zeros(0, np.int64))
    before = np.concatenate([[0], np.cumsum(words.raw == 10)])
    first = np.searchsorted(full, lines.first)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    number = before[lines.start[full]] - before[words.ends_of[of]]
    return trimmed.hashes(key=key), b - a, number, first


def windows(lines: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every window."""
    run = np.concatenate([[0], np.cumsum(words)])
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(lines))
    ahead = np.searchsorted(run, run[:-1] + min_words) - 1
    back = np.searchsorted(run, run[1:] - min_words, side="right") - 1
    f, b = ahead < first[of + 1], back >= first[of]
    both = np.unique(np.stack([np.concatenate([at[f], back[b]]), np.concatenate([ahead[f], at[b]])]), axis=1)
    return both[0], both[1]


def fingerprints(lines: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's least line hash (the last of equals) and its digest."""
    at, whole = s.copy(), mix(lines[s] + np.uint64(1))
    for k in range(1, int((e - s).max()) + 1 if len(s) else 0):
        more = np.flatnonzero(s + k <= e)
        here = s[more] + k
        at[more] = np.where(lines[here] <= lines[at[more]], here, at[more])
        whole[more] = mix(whole[more] ^ lines[here])
    return at, whole


def scan(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each selected place: PLACES."""
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                lines, words, number, first = hashed_lines(batch.column("text"), key)
                s, e = windows(lines, words, first, min_words)
                at, digest = fingerprints(lines, s, e)
                order = np.lexsort((s, at))
                s, e, at, digest = s[order], e[order], at[order], digest[order]
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                place = at[begin]
                of = np.searchsorted(first, place, side="right") - 1
                base = first[np.searchsorted(first, s, side="right") - 1]
                held = [digest.astype(np.int64), *((x).astype(np.int32) for x in (s - base, e - base, number[s], number[e]))]
                items = pa.StructArray.from_arrays([pa.array(x) for x in held], [x.split(" ")[0] for x in WINDOW])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), items)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), batch.column("h").take(pa.array(of)), pa.array(lines[place].astype(np.int64)), lists], ["doc", "h", "fp", "windows"])

    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return stored(keyed.mapInArrow(run, PLACES), "line-places", compression="zstd")


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document's matched windows: whether each line lies in one, and how many lines with a word do."""
    for batch in batches:
        out = []
        for doc, h, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "found")), strict=True):
            s, e, a, b = (np.array([r[c] for r in found], dtype=np.int64) for c in "seab")
            edges = np.zeros(int(b.max()) + 2, dtype=np.int64)
            np.add.at(edges, a, 1)
            np.add.at(edges, b + 1, -1)
            own = np.zeros(int(e.max()) + 2, dtype=np.int64)
            np.add.at(own, s, 1)
            np.add.at(own, e + 1, -1)
            out.append((doc, h, pa.array(np.cumsum(edges)[:-1] > 0), int((np.cumsum(own) > 0).sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.int64()), strict=True)], ["doc", "h", "mask", "gone"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, h (xxhash64 of the text), a mask of the lines in later repeats, and how many with a word these are."""
    small_batches(docs.sparkSession)
    places = scan(docs, min_words)
    place = F.struct("doc", "h", F.col("windows")[0]["s"])
    twice = places.groupBy("fp").agg(F.min(place).alias("p"), F.max(place).alias("last")).filter("p <> last").select("fp")
    twice = stored(twice, "line-twice", compression="zstd")
    found = stored(places.join(twice.hint("merge"), "fp").select("doc", "h", "fp", F.explode("windows").alias("w")).select("doc", "h", "fp", "w.*"), "line-windows", compression="zstd")
    place = F.struct("doc", "h", "s")
    first = found.groupBy("fp", "run").agg(F.min(place).alias("p"), F.max(place).alias("last")).filter("p <> last").select("fp", "run", "p")
    first = stored(first, "line-first", compression="zstd")
    later = found.join(first.hint("merge"), ["fp", "run"]).filter(place != F.col("p"))
    matched = later.groupBy("doc", "h").agg(F.collect_set(F.struct("s", "e", "a", "b")).alias("found"))  # a document's own windows at most
    return matched.mapInArrow(masks, "doc long, h long, mask array<boolean>, gone long")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, and kept_text, n_lines and n_removed (in place of any of these names)."""
    gone = stored(repeats(docs, min_words), "line-repeats", compression="zstd").withColumnRenamed("h", "key")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"))
    # by shuffle at any size: repeats grow with the input
    joined = keyed.join(gone.hint("merge"), ["doc", "key"], "left")
    text = F.col("row.text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get("mask", i), F.lit(False)) | ~x.rlike("[^ \\x09-\\x0D]")), "\n")
    made = joined.select(
        "row",
        F.when(F.col("mask").isNull(), text).otherwise(left).alias("kept_text"),
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
    )
    added = ("kept_text", "n_lines", "n_removed")
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with what is left of each text (and n_chars to match), less the documents of which no word is left."""
    done = line_dedup(docs, min_words).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike("[^ \\x09-\\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return done.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])

"""N-gram Jaccard join with token-combination prefixes, and its connected components.

A document's set holds its distinct runs of five words (lower-cased A-Z). Two documents link when
their sets' Jaccard similarity is 0.8 or more; the join is exact.

1. One pass hashes every set, adds its tokens up in a sketch of fixed size (counts of hashed tokens
   over all documents) and digests it. Equal sets form a class; one document stands for it.
2. Tokens have one global order: rare ones (by the sketch) first. A pair that links shares a token
   of its prefixes, the first n - ceil(0.8 n) + 1 of each; they are extended by B(n) tokens, so
   that it shares B + 1. The smaller of two sets is found by its shorter index prefix.
3. A token found in the prefixes of up to `frequent` documents is indexed alone. The others are
   dealt to B(n) buckets, and pairs of tokens of one bucket are indexed instead: among B + 1 shared
   tokens, one is rare or two share a bucket, so no link is lost. B depends on the size's power of
   two; sizes whose partners may lie in the power below use both.
4. Round one verifies documents against the first ones of their index keys: enough to join groups of
   near copies without their pairs. Each meets one partner first, and others only while they are apart. Components follow. Round two takes only keys that
   still hold several components, and of these the pairs of documents of different components for
   which sizes and positions allow a link: what two documents can still share behind a key's later
   token, and before it among frequent tokens only, must reach the overlap that a link needs, and
   their marks (256 bits a set, the parities of its tokens dealt to them) must not differ by more than
   a link allows; what is left meets wider marks, of two bits a token and more, before sets are read.
   Both hold for the pairs of round one, too. So
   documents that share a passage too short for a link never meet, however many they are, and a
   group that is already one component yields no pairs. All that remains is verified on whole sets.

Tokens are 64-bit hashes under a key drawn for the run, and sets are told apart by 128 bits: texts
can't be written to collide, and by chance two different tokens of a pair are equal once in 2^64.

Cases: null and empty texts have empty sets and link with nothing; with fewer than five words the
whole sequence is the one token. Repeated rows are equal sets. A null doc_id gets no component and
links with nothing. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .columns import sized, sliced, small_batches
from .textbytes import mix, new_key, shingles, split_words

N, KEEP, OF = 5, 4, 5  # words of a token; similarity KEEP / OF
SKETCH, SKETCH_BLOCK = 1 << 20, 1 << 12
#: A token in more prefixes than this is indexed in pairs.
FREQUENT = 16
#: Keys that the sketch holds to be this common are dealt to several tasks in round one.
CROWD = 256
#: Bits of a set's marks, in longs.
MARKS = ["p0", "p1", "p2", "p3"]
SCANNED = f"doc_id long, n int, d1 long, d2 long, {', '.join(f'{p} long' for p in MARKS)}, wide binary, block int, counts binary"


def token_sets(texts: pa.Array, n: int = N, key: int = 0) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit hashes."""
    w = split_words(texts)
    tokens, first = shingles(w.hashes(lower=True, key=key), w.first, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(tokens[a:b])
        fresh = own[1:] != own[:-1]
        out.append(own if fresh.all() else own[np.append(True, fresh)])
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mix(tokens ^ np.uint64(0x8BB84B93962EACC9)).sum(dtype=np.uint64)
        b = mix(tokens + np.uint64(0x2D358DCCAA6C78A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def marks_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of marks for each set: whether the number of its tokens dealt to a bit is odd.

    Two sets' marks differ in a bit only if a token of one of them alone was dealt to it, so that they
    differ in as many tokens as their marks in bits, at least.
    """
    width = 64 * len(MARKS)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    odd = np.bincount(owner * width + (tokens >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64), minlength=width * len(sets)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, len(MARKS))


def wide_mark(tokens: np.ndarray) -> bytes:
    """Marks as above in more than two bits a token, as a power of two and 64 at least: long sets fill the narrow ones."""
    power = max(6, (2 * len(tokens)).bit_length())
    odd = np.bincount((tokens >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide marks differ; the wider one is folded to the other's width first."""
    u, v = sorted((np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little") for m in (x, y)), key=len)
    return int((u ^ np.bitwise_xor.reduce(v.reshape(len(u), -1), axis=1)).sum())


def scan(docs: DataFrame, n: int, key: int) -> DataFrame:
    """Size and digest of every set, and rows of sketch counts: stored, a few bytes a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SCANNED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *(pa.int64() for _ in MARKS), pa.binary(), pa.int32(), pa.binary()]
        counts = np.zeros(SKETCH, dtype=np.uint32)
        some = False
        for whole in batches:
            for batch in sliced(whole, "text"):
                sets = token_sets(batch.column("text"), n, key)
                some = True
                tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                counts += np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                d = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], kinds[1]), pa.array([x for x, _ in d], kinds[2]), pa.array([x for _, x in d], kinds[3]), *(pa.array(x) for x in marks_of(sets).T), pa.array([wide_mark(s) for s in sets], pa.binary()), pa.nulls(len(sets), kinds[-2]), pa.nulls(len(sets), kinds[-1])], names)
        if some:
            k = SKETCH // SKETCH_BLOCK
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:-2]), pa.array(range(k), kinds[-2]), pa.array([x.tobytes() for x in counts.reshape(k, -1)], kinds[-1])], names)

    return stored(docs.select("doc_id", "text").mapInArrow(run, SCANNED), "ngram-scan", compression="zstd")


def levels(scanned: DataFrame) -> np.ndarray:
    """The sketch of all documents as a byte per counter, 4 log2(1 + count): one megabyte at any input size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, dtype=np.uint32).astype(np.uint64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([np.floor(4 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    rows = scanned.filter(F.col("block").isNotNull()).select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), dtype=np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def spare(n: int) -> int:
    """B(n): tokens by which prefixes are extended, and buckets of frequent tokens."""
    return max(1, 1 << n.bit_length() - 1 >> 5)


def prefixes(docs: DataFrame, standing: DataFrame, level: np.ndarray, n: int, key: int) -> DataFrame:
    """token, salt, doc, n, pos, idx of the extended prefixes of standing documents.

    A token is salted (salt >= 0) if the sketch holds it to be far more common than its counters are on average.
    """
    usual = max(CROWD, 4 * float(np.mean(2.0 ** (level / 4.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                out: list[tuple[np.ndarray, ...]] = []
                for doc, s in zip(batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), n, key), strict=True):
                    k = len(s)
                    if k < KEEP:  # fewer tokens link with equal sets only
                        continue
                    own = level[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    order = np.argsort(own.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")[: k + KEEP * -k // OF + 1 + spare(k)]
                    index = k - -(-2 * KEEP * k // (KEEP + OF)) + 1 + spare(k)
                    crowd = (2.0 ** (own[order] / 4.0) / usual).astype(np.int64)
                    salt = np.where(crowd > 0, doc % (crowd + 1), -1)
                    out.append((s[order].astype(np.int64), salt.astype(np.int32), np.full(len(order), doc), np.full(len(order), k, dtype=np.int32), np.arange(len(order), dtype=np.int32), np.arange(len(order)) < index))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "salt", "doc", "n", "pos", "idx"])

    return docs.select("doc_id", "text").join(sized(standing), "doc_id", "left_semi").mapInArrow(run, "token long, salt int, doc long, n int, pos int, idx boolean")


def may_link(na: str, pa: str, nb: str, pb: str) -> Column:
    """Whether sets of na and nb tokens that share one at pa and pb can link.

    If they do, a key exists for which at most B shared tokens come before it; the rest of the overlap
    must fit behind it.
    """
    small, large = F.least(F.col(na), F.col(nb)).cast("long"), F.greatest(F.col(na), F.col(nb)).cast("long")
    spare_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(large)) - 6, F.lit(0)))
    behind = F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb)).cast("long")
    return (OF * small >= KEEP * large) & ((KEEP + OF) * (spare_ + behind) >= KEEP * (small + large))


def close(na: str, nb: str, a: str, b: str) -> Column:
    """Whether sets of na and nb tokens can link, by their marks: columns whose names begin with a and b."""
    differ = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in MARKS), F.lit(0))
    return (KEEP + OF) * differ <= (OF - KEEP) * (F.col(na) + F.col(nb))


def marked(rows: DataFrame, marks: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows with size and marks of a column of ids; by shuffle at any size, as marks grow with the input."""
    return rows.join(marks.select(F.col("id").alias(column), *(F.col(c).alias(prefix + c) for c in ("n", *MARKS))).hint("merge"), column)


def ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs (a, b)."""
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def ruled(pairs: DataFrame, scanned: DataFrame) -> DataFrame:
    """The pairs (a, b) that can link by their wide marks."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(KEEP + OF) * bits_apart(x, y) <= (OF - KEEP) * (m + n) for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "na", "nb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = stored(ends(pairs), "ngram-ids", compression="zstd")
    wide = scanned.filter(F.col("block").isNull() & (F.col("n") > 0)).select("doc_id", "n", "wide").join(sized(ids), "doc_id", "left_semi")
    met = pairs.join(wide.toDF("a", "na", "x").hint("merge"), "a").join(wide.toDF("b", "nb", "y").hint("merge"), "b")
    return met.select("a", "b", "na", "nb", "x", "y").mapInArrow(left, "a long, b long").distinct()


def sets_of(ids: DataFrame, docs: DataFrame, n: int, key: int) -> DataFrame:
    """id, tokens (sorted 64-bit hashes) of these documents (doc_id): made again from their texts and stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in token_sets(batch.column("text"), n, key)], pa.binary())], ["id", "tokens"])

    ids = stored(ids.distinct(), "ngram-ids", compression="zstd")
    made = docs.select("doc_id", "text").join(sized(ids), "doc_id", "left_semi").mapInArrow(sets, "id long, tokens binary")
    return stored(made, "ngram-sets", compression="none")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, and other ids that go along) whose sets link."""
    names = pairs.columns

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = len(y) - 1
                both = int((y[at] == x).sum())
                keep.append(OF * both >= KEEP * (len(x) + len(y) - both))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(*names, "x", "y").mapInArrow(linked, ", ".join(f"{c} long" for c in names)).distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """Pairs (a, b) and (b, a), once each: stored."""
    return stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")


def settled(edges: DataFrame, most: int = 200) -> DataFrame:
    """id, label of every document with an edge (both ways): the least id that edges lead to. No lineage kept.

    Each turn takes the least of the neighbours' labels and the label's own label, so that chains
    shorten by doubling; it ends when no label changes, and raises after `most` turns.
    """
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    for _ in range(most):
        # a hub's messages are summed up where they arise
        sent = edges.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("was"))
        jumped = labels.withColumnRenamed("label", "was").join(labels.toDF("was", "label").hint("merge"), "was").select("id", "label", "was")
        after = sent.union(jumped).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        after = stored(after, "labels")
        labels = after.select("id", "label")
        if not after.filter("was <> label").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def components(links: DataFrame) -> DataFrame:
    """id, label of every linked document: the least id that links lead to."""
    return settled(both_ways(links))


def joined_up(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (id, label) after more edges (a, b) between components, each told by its label, or by its id where it is one document.

    Only the graph of components is gone through; labels are the least ids as before.
    """
    edges = both_ways(edges)
    if labels is None:
        return settled(edges)
    if not edges.limit(1).count():
        return labels
    new = settled(edges)
    again = labels.join(new.toDF("label", "least").hint("merge"), "label", "left").select("id", F.coalesce("least", "label").alias("label"))
    alone = new.join(labels.select("id"), "id", "left_anti")  # documents that had no link before
    return stored(again.unionByName(alone.select("id", "label")), "labels")


def staged(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Components after enough of the pairs (a, b) that link: the same as after all of them.

    First each document meets one of its partners; then only the pairs are verified whose ends are
    still in different components.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    one = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ngram-one")
    found = verified(one, sets) if labels is None else verified(with_labels(labels, one), sets).select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
    labels = joined_up(labels, found)
    rest = stored(with_labels(labels, pairs).filter("la <> lb").join(one, ["a", "b"], "left_anti"), "ngram-rest")
    few = sets.join(sized(ends(rest).withColumnRenamed("doc_id", "id")), "id", "left_semi")
    return joined_up(labels, verified(rest, few).select(F.col("la").alias("a"), F.col("lb").alias("b")))


def with_labels(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, la, lb: pairs with the labels of both ends."""
    first = label_of(labels, pairs.select("a", "b"), "a").withColumnRenamed("label", "la")
    return label_of(labels, first, "b").withColumnRenamed("label", "lb").select("a", "b", "la", "lb")


def label_of(labels: DataFrame | None, keys: DataFrame, column: str) -> DataFrame:
    """keys with the label of a column of ids (the id itself where it has no link)."""
    if labels is None:
        return keys.withColumn("label", F.col(column))
    # by shuffle at any size: labels grow with the input
    return keys.join(labels.withColumnRenamed("id", column).hint("merge"), column, "left").withColumn("label", F.coalesce("label", column))


def combinations_of(postings: DataFrame) -> DataFrame:
    """Keys of pairs of tokens of one bucket, from the frequent tokens (doc, n, label, token, pos); labels go along.

    room: what a set can share with another of which the first B + 1 shared tokens are frequent and
    two of them make the key: all from the later one on, and B or the frequent tokens before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for doc, k, label, tokens, pos in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "label", "tokens", "pos")), strict=True):
                tokens, pos = np.array(tokens, dtype=np.int64).astype(np.uint64), np.array(pos, dtype=np.int64)
                before = np.argsort(np.argsort(pos))
                power = k.bit_length() - 1
                for p in {power, power - 1} if KEEP * k < OF * (1 << power) and power else {power}:
                    # tokens of one bucket lie together; pair each with those up to d places on
                    b = spare(1 << p)
                    bucket = (mix(tokens) % np.uint64(b)).astype(np.int64)
                    order = np.lexsort((tokens, bucket))
                    t, at, own = tokens[order], pos[order], bucket[order]
                    room = np.minimum(b, before[order]) + k - at
                    d = 1
                    while d < len(t) and len(same := np.flatnonzero(own[d:] == own[:-d])):
                        later = np.where(at[same] > at[same + d], same, same + d)
                        fits = np.flatnonzero((KEEP + OF) * OF * room[later] >= KEEP * (OF + KEEP) * k)  # for the smallest partner
                        same, later = same[fits], later[fits]
                        with np.errstate(over="ignore"):
                            key = mix(mix(t[same] + np.uint64(p)) * np.uint64(3) + t[same + d])
                        out.append((key.astype(np.int64), np.full(len(same), doc), np.full(len(same), k, dtype=np.int32), np.full(len(same), label), room[later].astype(np.int32), (KEEP + OF) * room[later] >= 2 * KEEP * k))
                        d += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "doc", "n", "label", "room", "idx"])

    grouped = postings.groupBy("doc", "n", "label").agg(F.collect_list(F.struct("token", "pos")).alias("t"))  # a document's own prefix at most
    return grouped.select("doc", "n", "label", F.col("t.token").alias("tokens"), F.col("t.pos").alias("pos")).mapInArrow(run, "token long, doc long, n int, label long, room int, idx boolean")


def several(postings: DataFrame) -> DataFrame:
    """Rows (token, label, ...) whose token has more than one label; counted by partial sums, joined by token."""
    mixed = postings.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("idx").alias("any"), F.count("*").alias("many")).filter("lo <> hi and any").select("token", "many")
    return postings.join(stored(mixed, "ngram-several", compression="zstd").hint("merge"), "token")


def cross_pairs(postings: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of documents of different labels that share a key, as sizes, rooms and marks allow."""
    x = marked(postings.filter("idx").select("token", F.col("doc").alias("a"), F.col("room").alias("ra"), F.col("label").alias("la")), marks, "a", "x")
    y = marked(postings.select(F.col("token").alias("t"), F.col("doc").alias("b"), F.col("room").alias("rb"), F.col("label").alias("lb")), marks, "b", "y")
    later = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("a") < F.col("b")))
    fits = (OF * F.col("xn") >= KEEP * F.col("yn")) & ((KEEP + OF) * F.least("ra", "rb") >= KEEP * (F.col("xn") + F.col("yn"))) & close("xn", "yn", "x", "y")
    met = x.join(y.hint("merge"), (F.col("token") == F.col("t")) & (F.col("la") != F.col("lb")) & later & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links_and_classes(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sizes and classes of the documents (doc_id, n, stands), and the components of those that stand."""
    small_batches(docs.sparkSession)
    key = new_key()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = scan(docs, n, key)
    sets = scanned.filter(F.col("block").isNull()).select("doc_id", "n", "d1", "d2", *MARKS)
    classes = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("stands"), *(F.min(p).alias(p) for p in MARKS))
    classes = stored(classes, "ngram-classes")
    marks = classes.select(F.col("stands").alias("id"), "n", *MARKS)
    members = sets.drop(*MARKS).join(classes.drop(*MARKS), ["n", "d1", "d2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("stands", "doc_id")).alias("stands"))

    found = prefixes(docs, classes.filter(F.col("n") >= KEEP).select(F.col("stands").alias("doc_id")), levels(scanned), n, key)
    by_key = Window.partitionBy("token", "salt").orderBy("pos", "n", "doc")
    beside = found.select(
        "*",
        F.first("doc").over(by_key).alias("head"),
        F.first("n").over(by_key).alias("head_n"),
        F.first("pos").over(by_key).alias("head_pos"),
        F.lead("doc").over(by_key).alias("next"),
        F.max("idx").over(Window.partitionBy("token", "salt")).alias("indexed"),
    )
    # keys of one document, or without an index prefix, make no candidates; a salted key's parts may meet
    useful = (((F.col("head") != F.col("doc")) | F.col("next").isNotNull()) & F.col("indexed")) | (F.col("salt") >= 0)
    kept = stored(beside.filter(useful).drop("next", "indexed"), "ngram-keys", compression="zstd")
    star = kept.filter("head <> doc").filter(may_link("head_n", "head_pos", "n", "pos")).select(F.col("head").alias("p"), "doc")
    # the heads of a salted key's parts meet the least of them
    heads = kept.filter("salt >= 0").select("token", F.struct(F.col("head_pos").alias("pos"), F.col("head").alias("doc")).alias("h")).distinct()
    across = heads.join(heads.groupBy("token").agg(F.min("h").alias("t")), "token").select(F.col("t.doc").alias("p"), F.col("h.doc").alias("doc")).filter("p <> doc")
    tested = star.union(across).select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b")).distinct()
    tested = marked(marked(tested, marks, "a", "x"), marks, "b", "y").filter(close("xn", "yn", "x", "y")).select("a", "b").distinct()
    tested = stored(ruled(stored(tested, "ngram-close"), scanned), "ngram-tested")
    labels = staged(tested, sets_of(ends(tested), docs, n, key))

    left = stored(several(label_of(labels, kept.select("token", "doc", "n", "pos", "idx"), "doc")), "ngram-left", compression="zstd")
    spare_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(F.col("n").cast("long"))) - 6 + 1, F.lit(0))).cast("int")  # of the partner too, at most one power up
    alone = left.filter(F.col("many") <= FREQUENT).select("token", "doc", (F.col("n") - F.col("pos") + spare_).alias("room"), "idx", "label")
    paired = several(combinations_of(left.filter(F.col("many") > FREQUENT)))
    # keys of one token and of two are hashes alike: one join for both
    keys = stored(alone.unionByName(paired.select("token", "doc", "room", "idx", "label")), "ngram-pairs", compression="zstd")
    more = cross_pairs(keys, marks).join(tested, ["a", "b"], "left_anti")
    more = stored(ruled(stored(more, "ngram-close"), scanned), "ngram-more")
    return members, classes, staged(more, sets_of(ends(more), docs, n, key), labels)


def ngram_join(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id of all docs (doc_id, text)."""
    members, _, labels = links_and_classes(docs, n)
    placed = label_of(labels, members.select("doc_id", "n", F.col("stands")), "stands")
    return placed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("label").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs, with all their columns, of which the doc_id is the least of its component; one row for a doc_id."""
    stay = ngram_join(docs, n).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stays")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("stays"))
    # by shuffle at any size: what stays grows with the input
    met = keyed.join(stay.hint("merge"), "stays").withColumn("k", F.row_number().over(Window.partitionBy("stays").orderBy(F.xxhash64("row.text"))))
    return met.filter("k = 1").select("row.*").union(docs.filter(F.col("doc_id").isNull()))

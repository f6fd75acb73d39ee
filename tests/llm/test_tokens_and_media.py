"""Round trips and library results: token files, counts, packing, the piece lattice, GIF."""

import random
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cindertally.llm import encoding, media_gif, packing, piece_lattice, token_counts, token_files
from cindertally.session import shared_dir

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
STRANGE = ["a  b", "x \n y", " lead", "tail ", "", None, "it's we'll 'S", "a\x00b c", "İ ΣΣ é ́", "<|endoftext|> x <|endoftext|>", "x <|startoftext|> y<|endoftext|>z", "a b   c", "a\n", "\n a", "　a 　", " ", "“a “b", "a \x1cb"]


def library(path, text):
    return encoding.load(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "keeps"), [(BYTES, True), (WORDS, False)])
@pytest.mark.parametrize("most", [10, 100_000])
def test_cached_words_give_the_library_ids(docs, path, keeps, most):
    texts = [r["text"] for r in docs.limit(60).collect()] + STRANGE
    cache = encoding.WordCache(path, keeps, most)
    for k in range(0, len(texts), 5):
        part = texts[k : k + 5]
        ids, first = cache.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library(path, t) for t in part]


def two_that_collide_under_polynomials(order=11):
    """Two words of 2 ** order letters whose polynomial hashes agree modulo 2 ** 64 for any odd base."""
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_written_to_collide(make):
    from cindertally.llm import line_dedup, ngram_join

    a, b = two_that_collide_under_polynomials()
    for path, keeps in ((BYTES, True), (WORDS, False)):
        cache = encoding.WordCache(path, keeps)
        for texts in ([a, b], [f"x {a} y", f"x {b} y"]):
            ids, first = cache.encode(pa.array(texts, pa.string()))
            assert [ids[p:q].tolist() for p, q in zip(first[:-1], first[1:], strict=True)] == [library(path, t) for t in texts]
    sets = ngram_join.token_sets(pa.array([a, b], pa.string()))
    assert sets[0].tolist() != sets[1].tolist()
    words = " ".join(f"w{k}" for k in range(55))
    rows = line_dedup.line_dedup(make([(1, f"{words} {a}"), (2, f"{words} {b}")])).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


def test_a_hash_shared_by_two_words_does_no_harm(monkeypatch):
    """Every word gets one of four hashes; the cache still gives the library's ids."""
    from cindertally.llm.textbytes import Words

    true = Words.hashes
    monkeypatch.setattr(Words, "hashes", lambda self, lower=False, key=0: true(self, lower, key) & np.uint64(3))
    texts = ["the cat sat on the mat", "a cat on a mat sat", "the the the"]
    cache = encoding.WordCache(BYTES, True)
    for _ in range(2):
        ids, first = cache.encode(pa.array(texts, pa.string()))
        assert [ids[p:q].tolist() for p, q in zip(first[:-1], first[1:], strict=True)] == [library(BYTES, t) for t in texts]


def test_cache_is_bounded_in_bytes():
    rnd = random.Random(2)
    cache = encoding.WordCache(BYTES, True, most=2000, most_ids=8000)
    for _ in range(20):
        texts = [" ".join(f"w{rnd.randrange(10**9)}" + "  z" * (k % 3) for k in range(300)) for _ in range(10)]
        cache.encode(pa.array(texts, pa.string()))
        assert cache.count <= 2000 and cache.nbytes() < 2_000_000


@pytest.mark.parametrize("top", [1, 200, 70_000, 1 << 25])
def test_blocks_round_trip(top):
    ids = np.random.default_rng(1).integers(0, top, 5001).astype(np.uint32)
    assert (token_files.unpack(*token_files.pack(ids), len(ids)) == ids).all()


def digests(rows, path, end):
    at = 0
    out = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array([*library(path, t), end], dtype="<u4").tobytes()
        out.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_token_files(odd, docs, make):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, token_files.token_digests(df, BYTES).collect()), key=lambda r: r[1])
        assert [g[1:] for g in got if g[0] != 8] == [w[1:] for w in digests(rows, BYTES, 0) if w[0] != 8]
    assert token_files.token_digests(make([]), BYTES).count() == 0


def test_token_counts_and_cache(odd, docs, make, spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    model = piece_lattice.processor(PIECES)
    for df in (odd, docs, odd):
        rows = {r["doc_id"]: r for r in df.collect()}
        got = token_counts.token_counts(df, path, PIECES, limit=100).collect()
        assert len(got) == df.count()
        for r in got:
            text = rows[r["doc_id"]]["text"] or ""
            n = len(model.encode(text))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    cache = spark.read.parquet(path)
    assert cache.count() == cache.dropDuplicates(["content"]).count()  # nothing is encoded twice here
    encoded = token_counts.counter

    def refuse(path):
        raise AssertionError("every count is known")

    token_counts.counter = refuse
    try:
        n, again = cache.count(), token_counts.token_counts(docs, path, PIECES, limit=100).collect()
    finally:
        token_counts.counter = encoded
    assert len(again) == docs.count() and spark.read.parquet(path).count() == n
    assert token_counts.token_counts(make([]), path, PIECES).count() == 0


def check_pieces(df, weights=None, window=2048):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = packing.pack(df, WORDS, window=window, weights=weights).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*library(WORDS, t), 1], dtype="<u4")
        if sum(j == i for j, _ in rows) > 1:  # equal rows
            assert sum(r["length"] for r in of[i]) == 2 * len(ids)
            continue
        own = sorted(of[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert [s * window + o for s, o, _ in spans] == [0, *np.cumsum([n for _, _, n in spans])[:-1]] and all(o + n <= window for _, o, n in spans)
    return got


def test_packing(odd, docs, make):
    check_pieces(odd)
    got = check_pieces(docs)
    total = sum(r["length"] for r in got)
    share, held = {}, {}
    for r in got:
        share[r["queue"]] = share.get(r["queue"], 0) + r["length"] / total
        if r["sequence_id"] < total // 2048:
            held.setdefault(r["sequence_id"], {}).setdefault(r["queue"], []).append(r["length"])
    # every full window has each source's share, to within a token a source and one
    assert max(abs(sum(w.get(q, [0])) - 2048 * s) for w in held.values() for q, s in share.items()) <= len(share) + 2
    assert packing.pack(make([]), WORDS).count() == 0


def test_packing_with_target_shares(docs):
    got = check_pieces(docs.withColumn("source", docs["source"].substr(1, 4)), {"src1": 3.0}, window=256)
    first = [r for r in got if r["sequence_id"] < 20]
    names = {r["queue"] for r in got}
    held = sum(r["length"] for r in first if r["queue"] == "src1") / sum(r["length"] for r in first)
    assert abs(held - 3 / (len(names) + 2)) < 0.02


def test_lattice_gives_the_library_ids(odd, docs):
    model = piece_lattice.processor(PIECES)
    both = odd.union(docs.limit(40).withColumn("doc_id", docs["doc_id"] + 1000))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    encoded = piece_lattice.encode(both, PIECES, hot=200)
    got = encoded.collect()
    assert len(got) == both.count() and all(r["decodes"] for r in got)
    for r in got:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == model.encode(texts[r["doc_id"]] or "")
    for r in piece_lattice.decode(encoded, PIECES).collect():
        assert r["text"] == (texts[r["doc_id"]] or "")


def test_viterbi_gives_the_library_ids(docs, make, tmp_path):
    """The same file with its model type set to unigram, and the best of the library's lattice paths."""
    import sentencepiece

    data = open(PIECES, "rb").read()
    assert data.count(b"\x12\x06tok_v0\x18\x02") == 1
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(data.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    lines = [x[:400] for r in docs.limit(25).collect() for x in r["text"].split("\n")[:3] if x]
    texts = dict(enumerate(lines))
    score = lambda x: sum(model.get_score(k) for k in x)
    same = 0
    rows = piece_lattice.encode(make(list(texts.items())), path, kind="unigram", hot=50).collect()
    for r in rows:
        ids, want = np.frombuffer(r["ids"], dtype="<u4").tolist(), (model.nbest_encode_as_ids(texts[r["doc_id"]], 2) or [[]])[0]
        assert r["decodes"] and score(ids) >= score(want) - 0.01  # the library adds in single precision
        same += ids == want
    assert same > 0.8 * len(rows)


def test_lattice_of_a_very_long_word(make):
    """Twenty thousand letters of which every two stand together in a piece, by both folds."""
    rnd = random.Random(3)
    rows = [(1, "".join(rnd.choices("aeint", k=20_000))), (2, "a" * 20_000), (3, "\u2581 x\u2581")]
    model = piece_lattice.processor(PIECES)
    got = {r["doc_id"]: r for r in piece_lattice.encode(make(rows), PIECES, hot=1).collect()}
    assert all(np.frombuffer(got[i]["ids"], dtype="<u4").tolist() == model.encode(t) and got[i]["decodes"] == (i < 3) for i, t in rows)
    for r in piece_lattice.encode(make(rows[:1]), PIECES, kind="unigram", hot=1).collect():
        assert r["decodes"] and r["n_bytes"] == 20_000


@pytest.mark.parametrize("hot", [0, 300])
def test_rare_units_pass_the_lattice_where_their_texts_lie(odd, docs, hot):
    """Neither texts nor ids with holes are shuffled or stored, at any share of rare units; the ids stay the library's."""
    model = piece_lattice.processor(PIECES)
    both = odd.union(docs.filter("doc_id < 30").withColumn("doc_id", docs["doc_id"] + 1000))
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    encoded = piece_lattice.encode(both, PIECES, hot=hot)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") > 0 and "SortMergeJoin" not in plan and "word-" not in plan
    got = encoded.collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r["doc_id"]), np.array(model.encode(r["text"] or ""), dtype="<u4").tobytes()) for r in both.collect())
    assert all(r["decodes"] and r["n_bytes"] == len(texts[r["doc_id"]].encode()) for r in got)


@pytest.mark.parametrize("n", [1, 2, 192, 5000, 70_000])
def test_gif_code_streams(n):
    rnd = random.Random(n)
    for data in (bytes(rnd.choices(range(256), k=n)), bytes(rnd.choices(range(3), k=n)), b"a" * n, (b"the cat sat " * n)[:n]):
        assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n).tobytes() == data


def codes_in(bits, codes):
    """A code stream from codes, the plain way: widths grow as a decoder's table does."""
    out, at, width, size = 0, 0, bits + 1, (1 << bits) + 2
    first = True
    for c in codes:
        out |= c << at
        at += width
        if c == 1 << bits:
            width, size, first = bits + 1, (1 << bits) + 2, True
            continue
        if not first and size < 4096:
            size += 1
        first = False
        width = min(12, max(bits + 1, size.bit_length()))
    return out.to_bytes(-(-at // 8), "little")


def test_gif_small_codes_and_missing_clear():
    # 2-bit samples, an entry used while it is made (6), and a table that is full and stays
    assert media_gif.lzw_decode(codes_in(2, [4, 1, 6, 6, 2, 5]), 2, 99).tolist() == [1, 1, 1, 1, 1, 2]
    rnd = random.Random(5)
    samples = bytes(rnd.choices(range(256), k=6000))
    assert media_gif.lzw_decode(codes_in(8, [256, *samples, 257]), 8, 6000).tobytes() == samples
    with pytest.raises(ValueError, match="no entry"):
        media_gif.lzw_decode(codes_in(2, [4, 1, 7, 5]), 2, 9)


def drawn(frames):
    """A GIF of 4 x 2 with a palette of four colours: (disposal, transparent, interlace, box, samples) for each frame."""
    out = [b"GIF89a", struct.pack("<HHBBB", 4, 2, 0x81, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for disposal, clear, lace, (x, y, w, h), samples in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0), b"\0\x21\xfe\x02hi\0\x2c", struct.pack("<HHHHB", x, y, w, h, 0x40 * lace), b"\x02", media_gif.blocked(codes_in(2, [4, *[v for s in samples for v in (s, 4)], 5]))]
    return b"".join([*out, b"\x3b"])


def test_gif_disposal_transparency_and_interlace():
    data = drawn([(1, None, 0, (0, 0, 4, 2), [1] * 8), (3, 0, 0, (1, 0, 2, 1), [2, 0]), (2, None, 0, (0, 1, 1, 1), [3]), (0, None, 1, (0, 0, 2, 2), [2, 2, 3, 3])])
    width, height, frames = media_gif.decode_gif(data)
    shown = list(media_gif.compose(width, height, frames))
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    pixels = [[[tuple(int(v) for v in p) for p in row] for row in s] for s in shown]
    assert pixels[0] == [[red] * 4] * 2
    assert pixels[1] == [[red, green, red, red], [red] * 4]
    assert pixels[2] == [[red] * 4, [blue, red, red, red]]
    assert pixels[3] == [[green, green, red, red], [blue, blue, red, red]]
    data = drawn([(2, None, 0, (0, 0, 4, 2), [1] * 8), (0, 0, 0, (0, 0, 1, 1), [0])])
    assert [[tuple(int(v) for v in p) for p in row] for row in list(media_gif.compose(*media_gif.decode_gif(data)))[1]] == [[none] * 4] * 2
    rows = list(media_gif.frame_rows(data))
    assert [(k, a, d) for k, a, d, _ in rows] == [(0, 0, 70), (1, 70, 70)] and (rows[0][3][48], sum(rows[1][3])) == (8, 0)


def test_text_as_gif(odd, make, spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    got = media_gif.text_as_gif(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        payload, n = media_gif.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    media = media_gif.text_media(odd)
    files = media_gif.open_media(media.union(spark.createDataFrame([(77, 0, None)], media.schema)))
    frames = media_gif.gif_frames(files).collect()
    assert {r["doc_id"] for r in frames} == set(texts)
    assert all((r["start_ms"], r["duration_ms"], len(r["histogram"])) == (40 * r["frame"], 40, 64) for r in frames)
    assert media_gif.text_as_gif(make([])).count() == 0


def test_damaged_gifs_are_rows_with_an_error(make, spark):
    from pyspark.sql import functions as F

    whole = media_gif.encode_gif(b"the cat sat on the mat " * 8 + b" " * 8)
    huge = bytearray(whole)
    huge[6:10] = b"\xff\xff\xff\xff"
    bad = {k: whole[:k] for k in (0, 5, 9, 20, 790, len(whole) - 1)} | {1000: bytes(huge), 1001: b"\x00" * 50, 1002: whole[:800] + b"\xff" * 40 + whole[840:]}
    rows = [(k, 1, bytearray(v)) for k, v in bad.items()] + [(2000, 184, bytearray(whole)), (2001, 0, None)]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media_gif.media_features(media_gif.open_media(media)).collect()}
    assert len(got) == len(rows) and all(got[k]["error"] and got[k]["payload_bytes"] is None for k in [*bad, 2001])
    assert got[2000]["error"] is None and got[2000]["payload_bytes"] == 192
    assert [r["doc_id"] for r in media_gif.gif_frames(media_gif.open_media(media)).select("doc_id").distinct().collect()] == [2000]
    # the feature by brute force: grey levels of what is shown (a short last frame leaves the rest of the one
    # before), in 64 colours of two bits a channel
    text = "Grey: naïve ÿ " * 2000
    files = media_gif.open_media(media_gif.text_media(make([(1, text)])))
    (row,) = media_gif.media_features(files).select("feature", "n_frames", "duration_ms").collect()
    raw = media_gif.padded(text)[0]
    want, shown, by_frame = {}, bytearray(), []
    for k in range(0, len(raw), 192 * 64):
        part = raw[k : k + 192 * 64]
        shown[: len(part)] = part
        by_frame.append([0] * 64)
        for x in shown:
            want[(x >> 6) * 21] = want.get((x >> 6) * 21, 0) + 1
            by_frame[-1][(x >> 6) * 21] += 1
    frames = media_gif.gif_frames(files).orderBy("frame").collect()
    assert [(r["start_ms"], r["histogram"]) for r in frames] == [(40 * k, h) for k, h in enumerate(by_frame)] and row["duration_ms"] == 40 * len(frames)
    assert row["feature"] == " ".join(f"{k}:{v}" for k, v in sorted(want.items())) and row["n_frames"] == -(-len(raw) // (192 * 64))

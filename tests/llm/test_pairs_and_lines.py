"""The join and line dedup against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cindertally.llm import line_dedup, ngram_join
from cindertally.llm.textbytes import split_words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components_of(sets):
    up = {i: i for i in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies(seed, groups=8, copies=12, words=60, shared=True):
    """Groups of copies with a few words changed, and a passage that many documents hold."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(5000)]
    passage = rnd.choices(vocabulary, k=55)
    rows, i = [], 0
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(6, words * 4))
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if shared and rnd.random() < 0.3:
                w = w[:5] + passage + w[5:]
            rows.append((i, " ".join(w)))
            i += 1
    for _ in range(40):
        rows.append((i, " ".join(passage + rnd.choices(vocabulary, k=rnd.randint(1, 25)))))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("frequent", [1, 16])
def test_join_equals_all_pairs(make, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(make(rows)).collect()}
    assert got == components_of(sets_of(rows))


def test_second_round_alone_is_exact(make, monkeypatch):
    """Without the stars of round one, the index keys still lose no link."""
    rows = near_copies(3, groups=5, copies=8)
    first = ngram_join.verified
    turn = []

    def skip_first(pairs, sets):
        turn.append(1)
        return first(pairs.filter("a < 0") if len(turn) <= 2 else pairs, sets)

    monkeypatch.setattr(ngram_join, "verified", skip_first)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name, **k: stored(df.filter("a < 0") if name == "ngram-tested" else df, name, **k))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(make(rows)).collect()}
    assert got == components_of(sets_of(rows))


def test_join_on_odd_rows(odd, make):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (9, 2, 9), (10, 2, 9), (7, 1, 7), (8, 1, 8), (None, 1, None)} <= got
    assert ngram_join.ngram_join(make([])).collect() == []
    assert ngram_join.one_of_each(odd).filter("doc_id in (9, 10)").count() == 1
    assert ngram_join.one_of_each(odd).filter("doc_id = 8").count() == 1


def passages(n, own=13, shared=100):
    passage = [f"p{k}" for k in range(shared)]
    return [(i, " ".join(passage + [f"d{i}x{k}" for k in range(own)])) for i in range(n)]


@pytest.mark.parametrize("own", [13, 20])
def test_work_on_a_passage_without_links_grows_in_proportion(make, monkeypatch, own):
    """Documents that share a passage too short for a link: no pair of them is verified."""
    seen = []
    first = ngram_join.verified

    def counted(pairs, sets):
        seen.append(pairs.count())
        return first(pairs, sets)

    monkeypatch.setattr(ngram_join, "verified", counted)
    for n in (200, 800):
        got = ngram_join.ngram_join(make(passages(n, own))).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == n
    assert len(seen) == 8 and sum(seen[4:]) <= 8 * sum(seen[:4]) + 200 and sum(seen[6:]) <= 800


def test_components_of_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in ngram_join.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_words_of_bytes():
    texts = ["", None, "a b", "c", " d\te\n", "é ß", "", "f"]
    w = split_words(pa.array(texts, pa.string()))
    got = [[bytes(w.raw[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(np.unique(w.hashes())) == len({x for ws in got for x in ws})


def lines_gone(rows, least):
    """Line numbers to remove, from all runs of `least` words or more that are shortest forwards or backwards."""
    first, gone = {}, {}
    for key in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        lines = [(k, " ".join([line.strip(" \t\n\x0b\x0c\r")]), len(WORD.findall(line))) for k, line in enumerate(key[1].split("\n")) if WORD.search(line)]
        gone[key] = set()
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += lines[e][2]
                if words >= least:
                    run = tuple(x[1] for x in lines[s : e + 1])
                    if first.setdefault(run, (key, s)) != (key, s):
                        gone[key] |= {x[0] for x in lines[s : e + 1]}
                    if words - lines[s][2] >= least:
                        break
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(make, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choices("abcdefgh", k=rnd.choice([1, 3, 8, 20, 60]))) for _ in range(40)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(1, 6)):
            if rnd.random() < 0.5:
                k = rnd.randrange(len(pool))
                text += pool[k : k + rnd.randint(1, 6)]
            else:
                text.append(" ".join(rnd.choices([f"u{n}" for n in range(999)], k=rnd.randint(1, 30))))
            if rnd.random() < 0.2:
                text.append("")
        rows.append((i, "\n".join(text)))
    want = lines_gone(rows, 50)
    for r in line_dedup.line_dedup(make(rows)).collect():
        gone = want[r["doc_id"], r["text"]]
        assert r["kept_text"] == "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone)
        assert (r["n_removed"], r["n_lines"]) == (len(gone), len(r["text"].split("\n")))


def test_line_dedup_on_odd_rows(odd, make, spark):
    got = [(r["doc_id"], r["text"], r["kept_text"]) for r in line_dedup.line_dedup(odd).collect()]
    assert len(got) == odd.count() and all(a == b for _, a, b in got)
    long = " ".join(f"w{k}" for k in range(51))
    copies = line_dedup.without_repeats(make([(3, long), (1, long), (None, long), (2, f"own words\n{long}")]))
    assert sorted(((r["doc_id"], r["text"]) for r in copies.collect()), key=str) == [(1, long), (2, "own words"), (None, long)]
    assert line_dedup.line_dedup(make([])).count() == 0
    clash = make([(1, "a")]).selectExpr("*", "1 as key", "2 as doc", "3 as gone", "4 as row", "5 as n_lines")
    assert line_dedup.line_dedup(clash).select("key", "doc", "gone", "row", "n_lines").first() == (1, 2, 3, 4, 1)

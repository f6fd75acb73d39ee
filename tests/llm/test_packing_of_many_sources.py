"""Packing keeps one queue a source, however many there are."""

import random

import numpy as np
from test_tokens_and_media import WORDS, check_pieces

from cindertally.llm import packing


def dealt(totals, weights, window):
    """The deal round by round: (queue, token) in the order of the stream."""
    share = [max(1, round(w / max(weights) * packing.SCALE)) for w in weights]
    given, out = [0] * len(totals), []
    while any(g < t for g, t in zip(given, totals, strict=True)):
        alive = [j for j, t in enumerate(totals) if given[j] < t]
        whole, start, r = sum(share[j] for j in alive), list(given), 0
        while all(given[j] < totals[j] for j in alive):
            r += 1
            for j in alive:
                to = min(totals[j], start[j] + r * window * share[j] // whole)
                out += [(j, k) for k in range(given[j], to)]
                given[j] = to
    return out


def test_places_equal_the_deal():
    rng = random.Random(1)
    for q in (1, 2, 7, 60):
        totals, weights = [rng.randint(1, 90) for _ in range(q)], [rng.choice([0.2, 1.0, 3.0]) for _ in range(q)]
        schedule = packing.Schedule(totals, weights, 32)
        queue = np.repeat(np.arange(q), totals)
        first = np.concatenate([np.arange(t) for t in totals])
        for cells in (1, 1 << 20):
            which, start, n, place = packing.places(schedule, queue, first, first + 1, cells)
            assert (n == 1).all() and (start == first[which]).all()
            assert [(int(queue[w]), int(first[w])) for w in which[np.argsort(place)]] == dealt(totals, weights, 32)
            assert sorted(place) == list(range(sum(totals)))


def test_each_of_many_sources_keeps_its_queue_and_weight(spark):
    rows = [(k, " ".join(["word"] * 60), f"site{k}") for k in range(1100)] + [(5000 + k, "hot word " * 900, "hot") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = check_pieces(df, {"hot": 1100.0}, window=256)
    assert {r["queue"] for r in got} == {r[2] for r in rows}
    first = [r for r in got if r["sequence_id"] < 200]  # 51,200 tokens; each source is within a token of its share
    held = sum(r["length"] for r in first if r["queue"] == "hot") / sum(r["length"] for r in first)
    assert abs(held - 0.5) < 0.03
    assert packing.pack(df, WORDS).select("queue").distinct().count() == 1101


def test_null_and_empty_sources_are_two_queues(spark):
    df = spark.createDataFrame([(1, "a b c " * 50, None), (2, "d e f " * 50, ""), (3, None, None)], "doc_id long, text string, source string")
    got = check_pieces(df, {None: 3.0}, window=32)
    assert {r["queue"] for r in got} == {None, ""}


def test_places_of_very_many_tokens():
    schedule = packing.Schedule([3 * 10**11] * 1000, [1.0] * 1000, 2048)
    which, start, n, place = packing.places(schedule, np.array([7]), np.array([2 * 10**11]), np.array([2 * 10**11 + 10]))
    assert n.sum() == 10 and (place >= 2 * 10**14 - 4096).all() and (place < 3 * 10**14).all()

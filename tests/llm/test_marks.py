"""Marks of sets: never further apart than the sets themselves."""

import numpy as np

from cindertally.llm import ngram_join


def test_marks_rule_out_no_link():
    rnd = np.random.default_rng(5)
    draw = lambda n: np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for n in (0, 1, 4, 31, 32, 500, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            x = draw(n)
            y = np.union1d(x[: int(share * n)], draw(int((1 - share) * n) + n // 7))
            apart = len(np.setxor1d(x, y))
            narrow = ngram_join.marks_of([x, y])
            assert sum(int(v).bit_count() for v in (narrow[0] ^ narrow[1]).view(np.uint64)) <= apart
            assert ngram_join.bits_apart(ngram_join.wide_mark(x), ngram_join.wide_mark(y)) <= apart
    a, b = draw(3000), draw(3000)
    assert 9 * ngram_join.bits_apart(ngram_join.wide_mark(a), ngram_join.wide_mark(b)) > len(a) + len(b)

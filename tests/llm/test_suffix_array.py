import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_array as sa


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_order_of_suffixes(letters):
    r = random.Random(letters)
    for _ in range(150):
        n = r.randrange(1, 120)
        text = [r.randrange(letters) + 1 for _ in range(n - 1)] + [0]
        depth = r.choice([7, 8, 20, 200])
        order, _ = sa.suffix_array(np.array(text, dtype=np.int16), depth)
        assert sorted(order.tolist()) == list(range(n))
        suffixes = [text[i:][:depth] for i in order]
        assert suffixes == sorted(suffixes)
        wanted = np.array([r.random() < 0.3 for _ in text])
        some, _ = sa.suffix_array(np.array(text, dtype=np.int16), depth, wanted)
        assert len(set(some.tolist())) == len(some) and set(np.flatnonzero(wanted).tolist()) <= set(some.tolist())
        suffixes = [text[i:][:depth] for i in some]
        assert suffixes == sorted(suffixes)


def test_types():
    assert sa.is_smaller_than_next(np.array([2, 2, 3, 3, 1, 2, 0], dtype=np.int16)).tolist() == [True, True, False, False, True, False, False]


def test_repeated_windows():
    r = random.Random(4)
    for _ in range(300):
        window = r.choice([7, 9, 12])
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 8))]
        if r.random() < 0.5:
            pieces.append(pieces[0][3:] + b"z" + pieces[-1])
        counts = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
        expected = [[counts[p[i : i + window]] > 1 for i in range(len(p) - window + 1)] for p in pieces]
        assert [x.tolist() for x in sa.repeated_windows(pieces, window)] == expected


def test_long_runs():
    pieces = [b"a" * 3000, b"ab" * 1500, bytes(range(256)) * 3]
    got = sa.repeated_windows(pieces, 400)
    assert got[0].all() and got[1].all() and got[2].tolist() == [i < 113 or i >= 256 for i in range(369)]

"""What worker processes remember is bounded in bytes, and bounds never change a result."""

import random
import sys

import pandas as pd

from commune.llm.common import char_slices
from commune.llm.pieces import LONGEST_KEPT, Encoder, load_vocabulary


def test_encoder_memory_is_bounded_in_bytes():
    v = load_vocabulary()
    rng = random.Random(5)
    letters = "abcdefghij éß中"
    texts = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(400)]
    texts += ["x" * 30_000, "long" * 50, "", "long" * 50]
    small, free = Encoder(v, kept_bytes=20_000, kept_pair_bytes=20_000), Encoder(v)
    for k in range(0, len(texts), 7):
        part = texts[k:k + 7]
        assert small.encode(part) == free.encode(part)
    held = sum(sys.getsizeof(w) + sys.getsizeof(x) for m in (small.known, small.older) for w, x in m.items())
    assert held < 4 * 20_000
    assert all(len(w) <= LONGEST_KEPT for w in [*small.known, *small.older, *free.known, *free.older])
    assert len(small.pairs) <= 20_000 // 300 + 1 and len(small.ends) <= 20_000 // 300 + 1


def test_slices_cover_all_rows_in_order():
    texts = pd.Series(["", "a" * 10, "b" * 500, "", "c", "d" * 40] * 5)
    for chars in (1, 50, 10_000):
        got = list(char_slices(texts, chars))
        assert [t for s in got for t in s] == texts.tolist()
        assert all(len(s) for s in got)
        assert all(len(s) == 1 or s.str.len().sum() <= chars for s in got)
    assert list(char_slices(pd.Series([], dtype=object), 5)) == []

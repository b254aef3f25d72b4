"""Words and contexts of the language model are counted as columns, with no Python object for each word of a text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from edurank.llm import ppm

SIGNS = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xc2\xa0", b"\xff", b"a", b"B", b"\xd0\xa0", b"\x00", b"z"]


def some_texts(draw):
    return [b"".join(draw.choice(SIGNS) for _ in range(draw.randrange(12))) for _ in range(draw.randrange(1, 6))]


def test_words_are_those_of_the_bytes():
    draw = random.Random(1)
    for texts in ([], [b""], [b" "], *(some_texts(draw) for _ in range(200))):
        words, sizes = ppm.split_words(texts)
        assert isinstance(words, pa.Array)
        plain = [t.lower().split() for t in texts]
        assert words.to_pylist() == [w for own in plain for w in own]
        assert sizes.tolist() == [len(own) for own in plain]
        counts = ppm.word_counts(texts)
        assert dict(zip(*(c.to_pylist() for c in counts.columns), strict=True)) == Counter(w for own in plain for w in (*own, ppm.END_WORD))


def test_tally_adds_up():
    draw = random.Random(2)
    parts = [some_texts(draw) for _ in range(30)]
    tally = ppm._Tally()
    for texts in parts:
        tally.add(texts)
    whole = [t for texts in parts for t in texts]
    keys, counts = tally.total()
    plain_keys, plain_counts = np.unique(ppm.grams(whole)[0], return_counts=True)
    assert keys.tolist() == plain_keys.tolist() and counts.tolist() == plain_counts.tolist()
    found = Counter()
    for row in tally.rows(3):
        if row["kind"] == "word":
            found.update(dict(zip(row["keys"].split(b"\n"), np.frombuffer(row["counts"], "<u4").tolist(), strict=True)))
    assert found == Counter(w for t in whole for w in (*t.lower().split(), ppm.END_WORD))
    assert list(ppm._Tally().rows(3)) == []

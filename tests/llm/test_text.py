import random

import numpy as np
import pyarrow as pa

from vectables.llm.text import SET_BITS, Texts, Words, kmers, shingle_sets, slices
from tests.llm.reference import shingle_set, words_of

TEXTS = ["A b  c\td e", "", None, "x", "x y", " lead and trail ", "é È x", "\x0b\x0c", "a b c", "the the the the the"]


def test_words_and_hashes():
    w = Words(Texts(pa.array(TEXTS)))
    assert w.count.tolist() == [len(words_of(t)) for t in TEXTS]
    names = {}
    for t, a, b in zip(TEXTS, w.bounds, w.bounds[1:]):
        for word, h in zip(words_of(t), w.hash[a:b].tolist()):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_hash_is_the_same_across_windows_and_slices():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "Beta", "gamma" * 50]) for _ in range(60_000))
    w = Words(Texts(pa.array([text, text])))
    half = len(w.hash) // 2
    assert (w.hash[:half] == w.hash[half:]).all() and len(np.unique(w.hash)) == 3


def test_shingle_sets():
    for k in (1, 3, 5):
        sets, bounds = shingle_sets(Words(Texts(pa.array(TEXTS))), k)
        assert np.diff(bounds).tolist() == [len(shingle_set(t, k)) for t in TEXTS]
        assert (sets < 1 << SET_BITS).all()
    assert len(kmers(Words(Texts(pa.array(["a b c", "d e"]))), 3)[0]) == 1


def test_slices_keep_every_row():
    texts = ["x" * n for n in (0, 10, 5, 100, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(slices(batch, "text", most=12))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and len(parts) > 2
    assert list(slices(batch.slice(0, 0), "text")) == []
    whole = Texts(batch.slice(2, 2).column(0))
    assert whole.data.tobytes() == b"x" * 105

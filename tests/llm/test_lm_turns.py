"""Operator 8: contexts of several words grow in one bucket, whatever their frequency, and the texts travel once for all."""

import random
import zlib

import numpy as np
import pytest
from test_operators import brute_tree

from veriframe.llm import suffixtree


def rated(cut, spark_rows):
    p, states, _ = brute_tree([t for i, t in cut.items() if zlib.crc32(str(i).encode()) % 10], 2)
    seen = {w for i, t in cut.items() if zlib.crc32(str(i).encode()) % 10 for w in t}
    for r in spark_rows:
        t, want = cut[r.doc_id], 0.0
        assert set(t) <= seen
        for at, w in enumerate(t):
            want += np.log10(p(tuple(t[:at]), w))
        assert r.score == pytest.approx(want, abs=1e-8)
    return states


@pytest.mark.parametrize("depth, size", [(5, 1 << 20), (5, 60), (2, 60)])
def test_frequent_contexts_are_dealt_by_longer_ones(spark, docs, monkeypatch, depth, size):
    """Contexts of more places than a bucket holds, and longer ones than travel, rate as the definition does."""
    rng = random.Random(3)
    some = ["sun moon star".split(), "red moon sun sun".split(), "blue moon red star star".split(), "red moon blue".split()]
    texts = [" ".join(w for _ in range(rng.randint(2, 12)) for w in rng.choice(some)) for _ in range(120)]
    monkeypatch.setattr(suffixtree, "DEPTH", depth)
    monkeypatch.setattr(suffixtree, "BUCKET", size)
    monkeypatch.setattr(suffixtree, "P_OFTEN", 1e-9)
    cut = {i: [*x.encode().split(), suffixtree.END] for i, x in enumerate(texts)}
    states = rated(cut, suffixtree.score(docs(list(enumerate(texts)))).collect())
    assert max(map(len, states)) >= 3


def test_levels_share_a_shuffle(spark, docs, monkeypatch):
    """A tree of four levels or more: runs are counted by all tasks for its first level, and no text is dealt level by level."""
    rng, names = random.Random(8), []
    some = ["sun moon star".split(), "red moon sun sun".split(), "blue moon red star star".split(), "red moon blue".split()]
    texts = [" ".join(w for _ in range(rng.randint(2, 12)) for w in rng.choice(some)) for _ in range(120)]
    own = suffixtree.stash
    monkeypatch.setattr(suffixtree, "stash", lambda df, name, *a: names.append(name) or own(df, name, *a))
    assert suffixtree.score(docs(list(enumerate(texts)))).count() == 120
    assert names.count("counted") <= 2 and names.count("met") <= 2


def test_messages_hold_what_they_are_given():
    rng = np.random.default_rng(4)
    columns = [np.arange(300), rng.integers(-(1 << 63), (1 << 63) - 1, 50), np.zeros(0, np.int64), rng.integers(0, 1 << 31, 9), np.array([255, 256])]
    blob = suffixtree.squeeze(*columns)
    assert all(np.array_equal(a, b) for a, b in zip(suffixtree.expand(blob), columns, strict=True))
    words = np.array([0, 7, suffixtree.OTHER, -5, 1_000_000, -(1 << 63)])
    assert np.array_equal(suffixtree.joined(*suffixtree.split(words)), words)
    assert len(suffixtree.squeeze(rng.integers(0, 200, 4000))) < 4100


def test_rows_come_back_once():
    """What a row gains in several buckets is one row, not one for each."""
    import pyarrow as pa

    one = suffixtree.message(suffixtree.GAINED, 10, np.array([10, 1]), np.array([1 << 40, 1 << 41]), np.array([0, 1]))
    two = suffixtree.message(suffixtree.GAINED, 10, np.array([11, 1]), np.array([1 << 40, 0]), np.array([1, 0]))
    got = pa.Table.from_batches(suffixtree._collect([one, two])).to_pylist()
    assert got == [{"row": 10, "extra": 1.0, "deep": 0}, {"row": 11, "extra": 3.0, "deep": 2}, {"row": 12, "extra": 0.0, "deep": 0}]


def test_words_cut_at_once_are_those_of_each_text():
    import pyarrow as pa

    texts = ["", None, " A b\tA ", "x\x0by\x0cz\x1fw", "Ä  ä\n\n", "end"]
    words, at, size = suffixtree.words_of(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    assert size.tolist() == [len(x) for x in want] and [words[i].as_py() for i in at.tolist()] == [w for x in want for w in x]

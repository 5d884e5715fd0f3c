"""What operator 8 leaves in the shared folder, and the rows it deals."""

import pathlib

import numpy as np
import pyarrow as pa

from veriframe.llm import common, suffixtree


def test_tables_of_a_level_go(spark, docs):
    before = set(pathlib.Path(common.shared_dir(spark).removeprefix("file:")).iterdir())
    table = docs([(i, " ".join(["alpha beta gamma", "gamma beta delta"][(i + k) % 2] for k in range(i % 7))) for i in range(60)])
    assert suffixtree.score(table).count() == 60
    new = [p.name.split("-")[0] for p in set(pathlib.Path(common.shared_dir(spark).removeprefix("file:")).iterdir()) - before]
    assert "numbered" in new and not {"counted", "listed", "meetings"} & set(new) and new.count("runs") == 1


def test_runs_that_cannot_be_listed_are_one_row():
    """Of each context one row names its parent, and words whose shorter run isn't listed are counted together."""
    ids = np.array([1, 2, 1, 3, 1, 4, 1, 2], "<i8")
    listed = np.zeros(1 << 17, np.int64)
    code = suffixtree.mix(np.zeros(1, np.int64), np.array([2]))[0]
    listed[code >> 6 & len(listed) - 1] |= np.int64(1) << np.int64(code & 63)
    hold = type("Hold", (), {"value": (None, listed)})
    out = list(suffixtree._count_runs(1, hold)([pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])]))
    got = pa.Table.from_batches(out).to_pylist()
    one = suffixtree.mix(np.zeros(1, np.int64), np.array([1]))[0]
    assert sorted((r["word"] or 0, r["n"]) for r in got if r["ctx"] == one) == [(0, 2), (2, 2)]
    assert sum(r["n"] for r in got) == 7 and sum(r["parent"] is not None for r in got) == len({r["ctx"] for r in got})


def test_levels_travel_packed():
    """Counts of runs take less than 8 bytes a run on their way (rows of ctx, word, n and parent took 12)."""
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 200_000) % 50_000).astype("<i8")
    hold = type("Hold", (), {"value": (None, None)})
    (got,) = suffixtree._count_runs(1, hold)([pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])])
    sent = suffixtree.counts_of(8, got)
    assert sum(map(len, sent.column(2).to_pylist())) < 8 * got.num_rows
    out = pa.Table.from_batches(suffixtree._answer([sent])).to_pandas()
    pairs, n = np.unique(ids[:-1] << 32 | ids[1:], return_counts=True)
    assert sorted(out["n"]) == sorted(n[n > 1]) and len(set(out["run"])) == (n > 1).sum()
    total = np.bincount(ids[:-1])
    assert sorted(set(zip(out["ctx"], out["total"], strict=True))) == sorted(set(zip(*(x[np.isin(ids[:-1], pairs[n > 1] >> 32)].tolist() for x in (suffixtree.mix(np.zeros(len(ids) - 1, np.int64), ids[:-1]), total[ids[:-1]])), strict=True)))


def test_pooled_words_are_no_word_zero():
    """At the first level the row of words that can't be listed is apart from the most frequent word (number 0)."""
    ids = np.array([1, 0, 1, 0, 1, 5], "<i8")
    listed = np.zeros(1 << 17, np.int64)
    for code in suffixtree.mix(np.zeros(2, np.int64), np.array([0, 1])):
        listed[code >> 6 & len(listed) - 1] |= np.int64(1) << np.int64(code & 63)
    hold = type("Hold", (), {"value": (None, listed)})
    (got,) = suffixtree._count_runs(1, hold)([pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])])
    assert sorted((r["word"] is None, r["n"]) for r in got.to_pylist()) == [(False, 2), (False, 2), (True, 1)]


def test_buckets_rate_as_tasks_do(spark, docs, monkeypatch):
    """Contexts and runs rated in the task, in buckets of their contexts, or in buckets of their runs: the same scores."""
    rng = np.random.default_rng(2)
    table = docs([(i, " ".join(f"w{x % 40}" for x in np.cumsum(rng.choice([1, 1, 1, 7, 13], 30)))) for i in range(400)])
    got = []
    for often in (1e-9, 0.02, 2.0):
        monkeypatch.setattr(suffixtree, "P_OFTEN", often)
        monkeypatch.setattr(suffixtree, "BUCKET", 500)
        got.append({r.doc_id: r.score for r in suffixtree.score(table).collect()})
    assert all(abs(got[0][i] - g[i]) < 1e-9 for g in got for i in got[0]) and len(got[0]) == 400

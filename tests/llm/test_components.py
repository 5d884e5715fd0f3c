"""Connected components by stars."""

import random

from veriframe.llm import common


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already, or become so in the tasks that read them, are stashed once and joined with nothing."""
    names, stash = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, name: (names.append(name), stash(df, name))[1])
    pairs = [(10 * s, 10 * s + i) for s in range(20) for i in range(1, 8)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {(r.node, r.root) for r in common.components(spark.createDataFrame(pairs, "a long, b long").coalesce(1)).collect()}
    assert got == {(n, n // 10 * 10) for n in (10 * s + i for s in range(20) for i in range(8))} | {(n, 1000) for n in range(1000, 1101)}
    assert names == ["edges"]


def test_components_of_edges_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES", 7)  # several forests a task
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(draw.randrange(3000, 3300), draw.randrange(3000, 3300)) for _ in range(200)] + [(-5, 7000)] * 3 + [(9, 9)]
    draw.shuffle(pairs)
    up = {n: n for p in pairs for n in p}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {(n, root(n)) for n in {n for a, b in pairs if a != b for n in (a, b)}}
    got = common.components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()
    assert len(got) == len(want) and {(r.node, r.root) for r in got} == want

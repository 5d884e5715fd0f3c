"""The pipeline's stages over whole tables, each against brute force on its own input."""

import base64
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from veriframe.llm import common, langid, simhash


def shingles(text, size=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def one_of_each(rows, similarity=0.8):
    """Least doc_ids of the components of sets with that Jaccard similarity."""
    sets, up = [shingles(r.text) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9:
            up[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(root(i), []).append(r.doc_id)
    return sorted(min(ids) for ids in best.values())


def test_stages_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    (_, language), (_, near), (_, leaks), (_, private), (_, tokens) = corpus_pipeline.STAGES
    first = common.stash(language(spark, docs, folder), "first")
    model = langid.train(docs.filter(~langid.held_out(langid.HOLD)))
    judged = [(r.doc_id, *model.predict((r.text or "").encode()), any(c.isalpha() for c in r.text or "")) for r in docs.collect()]
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, _, _, unsure, letter in judged if letter and not unsure)
    second = common.stash(near(spark, first, folder), "second")
    assert sorted(r.doc_id for r in second.collect()) == one_of_each(first.collect()) != sorted(r.doc_id for r in first.collect())
    third = common.stash(leaks(spark, second, folder), "third")
    items = [(r.text, shingles(r.text, min(5, len(r.text.split())))) for r in common.table(spark, folder, "benchmark").collect() if r.text and r.text.split()]
    clean = [r.doc_id for r in second.collect() if not any(len(s & shingles(r.text, min(5, len(t.split())))) >= 0.8 * len(s) - 1e-9 for t, s in items)]
    assert sorted(r.doc_id for r in third.collect()) == sorted(clean)
    fourth = common.stash(private(spark, third, folder), "fourth")
    before, after = {r.doc_id: r.text for r in third.collect()}, {r.doc_id: r for r in fourth.collect()}
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values()) and any("[EMAIL]" in r.text for r in after.values())
    assert all(after[i].text == t for i, t in before.items() if not any(c in t for c in "@+0123456789"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in tokens(spark, fourth, folder).collect()}
    assert got.keys() == after.keys() and all(np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(after[i].text) for i, r in got.items())


@pytest.mark.parametrize("edits", [2, 9])
def test_one_template_in_many_documents(spark, docs, edits):
    """Copies of one page with words of their own: each is near some, and few near all."""
    rng = np.random.default_rng(edits)
    page = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(260):
        words = list(page)
        for at in rng.integers(0, len(words), edits if i % 2 else edits // 2):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 60))) for i in range(20)]
    table = docs(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(table, shingle=5, similarity=0.8).collect()) == one_of_each(table.collect())

"""Fill-in-middle, whitening and toxicity against brute force, exact arithmetic and planted documents."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from veriframe.llm import bpe, infill, queries, simhash, suffixtree, toxicity, whiten

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randint(2, 8))) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(30_000))


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " ", "\n\t a", "a", "a ", " a  b ", "日本 語　x 𝒳 y", "one <P> two three", "x <S", "> <M y <M", "a\x0bb\x0cc\x1cd e", LONG, "same text here", "same text here"]


def brute(text, doc_id):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, rows):
    table = docs([(1000 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "a null id"), (77, "twice"), (77, "twice")])
    want = sorted(((r.doc_id, *brute(r.text, r.doc_id)) for r in table.collect()), key=repr)
    assert rows(infill.fill_in_middle(table)) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = infill.restored(infill.fill_in_middle(table))
    assert sorted((repr((r.doc_id, r.restored)) for r in back.collect())) == sorted(repr((r.doc_id, r.text or "")) for r in table.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = rows(infill.report(table))
    assert [g[:6] for g in got] == sorted(((*w[:5], sha(w[5])) for w in want), key=repr) and len({g[6] for g in got if g[0] == 77}) == 1
    assert infill.report(table.limit(0)).count() == 0
    assert {r.form for r in infill.fill_in_middle(table, fim_percent=0).collect()} == {"plain"}


def exact(vectors, k):
    """Deviations and the whitened rows' magnitudes, from fractions and a decomposition of the exact covariance."""
    x = [[math.floor(Fraction(v) * 64) + 1_000_000 for v in row] for row in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = np.array([[float(Fraction(o, n)) for o in r] for r in off]) @ u
    return n, [sum(o * o for o in r) for r in off], z, e, e / np.trace(v)


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n", "2 as component", "'x' as whitened")


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e14])
def test_whitening(spark, scale):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 40)) * np.linspace(1, 3, 40) * scale).tolist()
    data = [(i, v, 0) for i, v in enumerate(good)] + [(0, good[0], 1), (None, good[1], 1)]
    bad = [(900, None, 0), (901, [float("nan")] * 40, 0), (902, [float("inf")] + [0.0] * 39, 0), (903, [None] + [0.0] * 39, 0), (904, [], 0)]
    got = whiten.whiten(frame(spark, [*bad, *data]).repartition(3)).toPandas()
    n, dev, z, e, share = exact([v for _, v, _ in data], 32)
    assert set(got["n"]) == {n} and len(got) == 32 * n and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert sorted(got["vec_id"].dropna().unique()) == list(range(300))
    first = got[got["component"] == 1].sort_values("vec_id")
    fits = [d if d < 2**63 else None for d in dev]
    exactly = [r.deviation for r in whiten.whiten(frame(spark, data)).filter("component = 1").select("deviation").collect()]
    assert sorted(exactly, key=repr) == sorted(fits, key=repr) and first["deviation"].isna().sum() == fits.count(None)
    one = got[(got["vec_id"] == 5)].sort_values("component")
    assert np.allclose(np.abs(one["whitened"]), np.abs(z[5]) / np.sqrt(e), rtol=1e-7, atol=1e-9)
    assert np.allclose(one["explained"], share, rtol=1e-9)


def test_whitening_of_little(spark):
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0], 0)]).limit(0)).count() == 0
    alone = whiten.whiten(frame(spark, [(1, [1.0, 2.0], 0)])).toPandas()
    assert alone["whitened"].isna().all() and set(alone["deviation"]) == {0} and set(alone["identity_error"]) == {0.0}
    # a copied dimension, and two lengths side by side
    rng = np.random.default_rng(4)
    flat = [[a, b, a] for a, b in rng.normal(size=(50, 2)).tolist()]
    got = whiten.whiten(frame(spark, [(i, v, 0) for i, v in enumerate([*flat, [1.0], [3.0]])])).toPandas()
    three, one = got[got["n"] == 50], got[got["n"] == 2]
    assert three[three["component"] == 3]["whitened"].isna().all() and three[three["component"] < 3]["whitened"].notna().all()
    assert sorted(one["whitened"].round(9)) == [-1.0, 1.0] and set(one["explained"]) == {1.0} and got["identity_error"].max() < 1e-9


def test_limbs():
    values = [0, 1, -1, 2**32, -(2**70) + 5, 3**90]
    back = [0] * len(values)
    for p, k, x in zip(*map(np.ndarray.tolist, whiten.limbs(values)), strict=True):
        back[p] += x << (32 * k)
    assert back == values


def test_folding():
    same = {"Stupid": "stupid", "ѕtupіd": "stupid", "5tup1d": "stupid", "$tup!d": "stupid", "ｓｔｕｐｉｄ": "stupid", "𝐬𝐭𝐮𝐩𝐢𝐝": "stupid", "st​uṕid": "stupid", "stupid!!!": "stupid", "(stupid)": "stupid", "st­upid": "stupid"}
    for text, want in same.items():
        folded, at = toxicity.fold(text)
        assert folded.split()[0] == want and folded[0] == folded[-1] == " " and len(at) == len(folded)
    assert toxicity.fold("+1 555-1234, 3.5!")[0] == " 1 555 1234 3 5 " and toxicity.fold("")[0].strip() == "" and toxicity.fold("réeu été")[0] == " réeu été "
    folded, at = toxicity.fold("a ​ 5tup1d!")
    start = folded.index("stupid")
    assert at[start] == 4 and at[start + 5] == 9


def test_matcher_and_exceptions():
    m = toxicity.Model({" stup": 2.0, " stupid ": 5.0, " trash ": 3.0}, ["trash can", "not stupid at"])
    found = lambda t: [(toxicity.fold(t)[0][a:b].strip(), w) for a, b, w in m.matches(toxicity.fold(t)[0])]
    assert found("stupid 5tupor, trash") == [("stupid", 5.0), ("stup", 2.0), ("trash", 3.0)]
    assert found("a trash can; trash-can trash cans trash") == [("trash", 3.0), ("trash", 3.0)]
    assert found("not stupid at all, stupid") == [("stupid", 5.0)] and found("") == [] and found("unstupid trashy") == []


def corpus():
    """(doc_id, text, toxic): words of two families are toxic; one word is harmless before another."""
    out = []
    for i in range(900):
        words, toxic = prose(RNG.randint(3, 120)).split(), int(i % 4 == 0)
        if toxic:
            words.insert(RNG.randrange(len(words)), RNG.choice(["scumbag", "vexqu" + RNG.choice(WORDS), "5cumb4g", "Ѕcumbag!"]))
        elif i % 4 == 1 and i % 8 == 1:
            words.insert(RNG.randrange(len(words)), "scumbag detector")
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity(spark, docs):
    made = corpus()
    table = docs([*((i, t) for i, t, _ in made), (None, "scumbag"), (5000, None), (5001, ""), (5002, "12 !! 3"), (5003, LONG), (5004, LONG + " scumbag vexquab vexquef"), (5005, "scumbag detector"), (1, made[1][1])])
    labels = spark.createDataFrame([*((i, y) for i, _, y in made), (3, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int").selectExpr("*", "0 as score", "'x' as text")
    got = toxicity.score(table, labels).collect()
    assert len(got) == table.count()
    by = {r.doc_id: r for r in got}
    wrong = [i for i, _, y in made if by[i].held_out and by[i].predicted != y]
    assert sum(by[i].held_out for i, _, _ in made) > 100 and len(wrong) <= 2, wrong
    assert [by[i].predicted for i in (None, 5000, 5001, 5002, 5003, 5005)] == [1, 0, 0, 0, 0, 0] and by[5005].n_matches == 0
    assert by[5004].predicted == 1 and all(0 <= r.score <= 1 for r in got)
    where = toxicity.predict(docs([(1, "a ѕcumb4g, b")]), toxicity.train(docs([(i, t) for i, t, _ in made]), labels)).first().matches
    assert where.endswith(":2:9")


def test_toxicity_without_labels(spark, docs):
    table = docs([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        assert {(r.score, r.predicted) for r in toxicity.score(table, some).collect()} == {(0.0, 0)}
    assert toxicity.score(table.limit(0), labels).count() == 0


def test_registered():
    assert {"op11_fill_in_middle", "op12_whitening", "op13_toxicity"} <= set(queries.QUERIES) and "op11_fill_in_middle" in queries.SQL


def test_stage_by_fingerprints(spark, docs):
    """The pipeline's near-duplicate stage links by fingerprints first: candidates connect exactly those within BITS."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(t) for t in base] + [" ".join([*t[:k], "new", *t[k + 1 :]]) for t in base for k in (3, 399)] + [None, "one two", "one  two"]
    sets = simhash.shingle_sets(docs(list(enumerate(texts))), 5, 0.8)
    rows = {r.fp: r.sim for r in sets.collect()}
    assert {r.doc_id: r.sim for r in sets.collect()} == {i: simhash.fingerprint((t or "").encode(), 5) for i, t in enumerate(texts)}

    def classes(links):
        up = {x: x for x in rows}

        def root(x):
            return x if up[x] == x else root(up[x])

        for a, b in links:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in rows}

    want = classes([(a, b) for a in rows for b in rows if bin((rows[a] ^ rows[b]) & (1 << 64) - 1).count("1") <= simhash.BITS])
    got = classes([(r.a, r.b) for r in simhash.fingerprint_pairs(sets).collect()])
    assert got == want and len(set(want.values())) < len(rows)


def test_lately(monkeypatch):
    monkeypatch.setattr(bpe, "LATELY", 4)
    some = bpe.Lately()
    for i in range(40):
        some[i] = i
        assert some[0] == 0 and len(some) <= 4 and len(some.older) <= 4  # what is still met stays
    assert some[20] is None and some[39] == 39


def test_support_does_not_grow(spark, docs):
    """A run that occurs twice is listed in a corpus of any size."""
    rng = random.Random(8)
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10][:40]
    texts = {i: " ".join(f"f{rng.randrange(50)}" for _ in range(8000)) for i in train}
    for i in train[:2]:
        texts[i] += " rareone raretwo"
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = {r.doc_id: r for r in suffixtree.score(docs([*texts.items(), (held, "rareone raretwo")])).collect()}[held]
    total, kinds = 40 * 8001 + 4, 53
    root = [np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in (2, 2, 40)]
    assert got.train_tokens == total and got.base_score == pytest.approx(sum(root))
    assert got.score == pytest.approx(root[0] + 2 * np.log10(2 / 3))

"""Toxicity by a weighted lexicon matched by Aho-Corasick in folded text (operator 13).

Folding maps each code point to one lower-case letter (compatibility forms, Cyrillic and Greek look-alikes), digits and signs
that stand for letters to those letters where they touch one, and all else to a blank; combining marks and invisible points go.
Letters with marks stay as they are, as marks part words in many languages. Entries of the lexicon are whole words and
beginnings of words (at least STEM letters), learned from labelled training documents: those that occur in many more toxic than clean documents,
weighted by the log of that ratio. A word counts by its longest entry. Exception phrases, an entry with the word before or
after it, are learned too: pairs that occur in clean documents at least as often as in toxic ones; entries within them don't
count, and the rest are weighted anew without them. Callers may add exceptions. A document's strength is the sum of the weights
of its distinct matched words; divided by a power of its number of words, it becomes a probability by a logistic curve. Curve
and power are fitted to the training documents.

The training documents are a bounded sample: those of up to SAMPLE labelled doc_ids, drawn by a hash of doc_id. The lexicon
has up to ENTRIES entries, the most telling ones; so the model that is broadcast is bounded. Every document is scored whole,
and the work is linear in its text; there is no shuffle of texts.

A doc_id with several labels is toxic if one of them says so; null labels and null doc_ids don't train. Null texts are empty;
texts without words score as those without a match. Without training documents of both kinds every score is 0. Repeated rows
give equal rows; ties in the choice of entries go by their text.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_batches, stash
from veriframe.llm.langid import HOLD, held_out

SAMPLE = 50_000  # labelled doc_ids that train, about
ENTRIES, PHRASES = 20_000, 20_000
SUPPORT = 5  # toxic documents that an entry occurs in, at least, and clean ones for an exception
STEM, LONGEST = 4, 12  # letters of a word's beginning as an entry
LEAST = math.log(4)  # an entry's weight
EVIDENCE = 25.0  # toxic documents times weight
NONE = -(1 << 30)
FLUSH = 500_000  # terms that a task counts before it hands them on
BLANK, GONE = 32, 0

# Letters of other scripts, and digits and signs, that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}


def _fold_point(c: str) -> int:
    if c in DIGITS:
        return ord(c)
    kind = unicodedata.category(c)
    if kind in ("Mn", "Me", "Cf"):
        return GONE
    base = unicodedata.normalize("NFKC", c)[:1].lower()[:1] or c
    base = LOOKALIKES.get(base, base)
    return ord(base) if base.isalnum() else BLANK


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Folded code points up to the end of the mathematical letters; points beyond fold to themselves."""
    if not _TABLE:
        spans = [*range(0xD800), *range(0xE000, 0x20000)]
        table = np.full(0x110000, BLANK, np.uint32)
        table[spans] = [_fold_point(chr(c)) for c in spans]
        table[0x20000:0x32000] = np.arange(0x20000, 0x32000)  # ideographs
        sub = np.zeros(max(map(ord, DIGITS)) + 1, np.uint32)
        for c, letter in DIGITS.items():
            sub[ord(c)] = ord(letter)
        _TABLE.extend([table, sub])
    return _TABLE[0]


def fold(text: str) -> tuple[str, np.ndarray]:
    """The folded text, words between single blanks, one at both ends, and the place in text of each of its code points."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    f = _table()[cp]
    sub = _TABLE[1]
    at = np.flatnonzero(f != GONE)
    f = f[at]
    pads = np.array([BLANK], np.uint32)
    f, at = np.concatenate([pads, f, pads]), np.concatenate([[0], at, [len(cp)]])
    swap = np.where(f < len(sub), sub[np.minimum(f, len(sub) - 1)], 0)
    digit = (f >= 48) & (f <= 57)
    sign = (swap > 0) & ~digit  # no part of a word by itself
    letter = (f != BLANK) & (swap == 0) & ~digit
    # a run of digits and signs is letters where it touches one; a sign at a word's end is no letter
    run = swap > 0
    if run.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        before, after = letter[first - 1], letter[end]
        for i in np.flatnonzero(before | after):
            a, b = first[i], end[i]
            while not after[i] and b > a and sign[b - 1] and f[b - 1] != 36:
                b -= 1
            f[a:b] = swap[a:b]
            sign[a:b] = False
        f = np.where(sign, BLANK, f)
    keep = (f != BLANK) | np.concatenate([[True], f[:-1] != BLANK])
    f, at = f[keep], at[keep]
    return f.tobytes().decode("utf-32-le", "surrogatepass"), at


def terms(word: str) -> list[str]:
    """The entries that a word could count by: its beginnings, then itself."""
    return [f" {word[:k]}" for k in range(STEM, min(len(word), LONGEST) + 1)] + [f" {word} "]


def _tally(rows, flush: int, schema=("term", "toxic", "clean")):
    """Batches (term, toxic documents, clean documents) from (terms of a document, whether it is toxic)."""
    held = Counter(), Counter()

    def out():
        keys = list(held[0].keys() | held[1].keys())
        cols = [pa.array(keys, pa.string()), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())]
        for h in held:
            h.clear()
        return pa.RecordBatch.from_arrays(cols, list(schema))

    for found, toxic in rows:
        held[toxic].update(found)
        if len(held[0]) + len(held[1]) > flush:
            yield out()
    yield out()


def _rows(batches):
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield fold(text or "")[0], int(toxic)


def count_terms(batches):
    return _tally((({t for w in set(f.split()) for t in terms(w)}, y) for f, y in _rows(batches)), FLUSH)


class Model:
    """Weights of entries, exception phrases and the curve: its value without a match, with one, and by log strength and log words."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.weights, self.exceptions = weights, [fold(e)[0] for e in exceptions]
        self.curve = (-math.inf, 0.0, 0.0, 0.0)
        self._matcher = None

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    @property
    def matcher(self):
        if self._matcher is None:
            m = ahocorasick.Automaton()
            for e, w in self.weights.items():
                m.add_word(e, (len(e), w, False))
            for e in self.exceptions:
                if e.strip():
                    m.add_word(e, (len(e), self.weights.get(e), True))
            m.make_automaton()
            self._matcher = m
        return self._matcher

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words that count: start is at the blank before, end after the last letter of the entry."""
        if not len(self.weights):
            return []
        best: dict[int, tuple[int, float]] = {}
        excused = []
        for last, (size, weight, exception) in self.matcher.iter(folded):
            start = last - size + 1
            if weight is not None and (start not in best or best[start][0] < size):
                best[start] = size, weight
            if exception:
                excused.append((start, last + 1))
        out, k, reach = [], 0, 0
        excused.sort()
        for start, (size, weight) in sorted(best.items()):
            while k < len(excused) and excused[k][0] <= start:
                reach = max(reach, excused[k][1])
                k += 1
            end = start + size
            if folded[end - 1] == " ":
                end -= 1
            if end > reach:  # else within an exception that starts at or before it
                out.append((start, end, weight))
        return out

    def strength(self, folded: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """The sum of weights of the distinct matched words, the number of all words, and the matches."""
        got = self.matches(folded)
        distinct = {folded[start : folded.index(" ", end)]: w for start, end, w in got}
        return sum(distinct.values()), max(folded.count(" ") - 1, 1), got

    def score(self, strength: float, words: int) -> float:
        none, some, power, length = self.curve
        z = none + (some + power * math.log(strength) + length * math.log(words) if strength > 0 else 0.0)
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))


def _chosen(got, n_toxic: int, n_clean: int, entries: int) -> dict[str, float]:
    """Weights by the counts: an entry is left out if a shorter one tells as much."""
    weight = np.log((got["toxic"] + 0.5) / (n_toxic + 1)) - np.log((got["clean"] + 0.5) / (n_clean + 1))
    got = got.assign(weight=weight, evidence=weight * got["toxic"])
    got = got[(got["weight"] >= LEAST) & (got["evidence"] >= EVIDENCE)].sort_values(["evidence", "term"], ascending=[False, True])
    got = got.head(entries)
    out: dict[str, float] = {}
    for term, w in sorted(zip(got["term"], got["weight"], strict=True), key=lambda x: (len(x[0]), x[0])):
        shorter = next((out[term[:k]] for k in range(len(term) - 1, STEM, -1) if term[:k] in out), None)
        if shorter is None or w > shorter:
            out[term] = float(w)
    return out


def _phrases(model):
    """Pairs of an entry with the word before and after it, each pair once a document."""

    def found(folded: str) -> set[str]:
        out = set()
        for start, end, _ in model.value.matches(folded):
            stop = folded.index(" ", end)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", stop + 1)
            if before >= 0:
                out.add(folded[before : stop + 1])
            if after >= 0:
                out.add(folded[start : after + 1])
        return out

    return lambda batches: _tally(((found(f), y) for f, y in _rows(batches)), FLUSH)


def _entries(model):
    """The entries that count in each document, exceptions left out."""

    def found(folded: str) -> set[str]:
        weights, out = model.value.weights, set()
        for start, end, _ in model.value.matches(folded):
            out.add(folded[start : end + 1] if folded[start : end + 1] in weights else folded[start:end])
        return out

    return lambda batches: _tally(((found(f), y) for f, y in _rows(batches)), FLUSH)


def _weighed(weights: dict[str, float], left, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights by the documents in which an entry counts, where there are SUPPORT of them; those that don't tell go."""
    out = dict(weights)
    for term, toxic, clean in zip(left["term"], left["toxic"].tolist(), left["clean"].tolist(), strict=True):
        if toxic + clean >= SUPPORT:
            out[term] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return {t: w for t, w in out.items() if w > 0}


STEPS = 20  # bins of a logarithm


def _bins(model):
    """Documents by their strength (bin NONE: no match) and number of words, both on a log scale, and label."""

    def place(f: str) -> tuple[int, int]:
        strength, words, _ = model.value.strength(f)
        return (round(math.log(strength) * STEPS), round(math.log(words) * STEPS)) if strength else (NONE, 0)

    def run(batches):
        held = Counter((*place(f), y) for f, y in _rows(batches))
        cols = [pa.array([k[i] for k in held], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(held.values()), pa.int64())], ["strength", "words", "toxic", "n"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve on the columns of x; both kinds of y weigh alike, with a slight ridge."""
    n = n / np.where(y > 0, n[y > 0].sum(), n[y == 0].sum())
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(b)), x.T @ (n * (y - p)) - 1e-4 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), sample: int = SAMPLE, entries: int = ENTRIES) -> Model | None:
    """docs: the training rows (doc_id, text); labels: (doc_id, toxic). None without documents of both kinds."""
    spark = docs.sparkSession
    byte_batches(spark, 1 << 22)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    few = F.broadcast(known.filter(drawn))  # about `sample` rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").filter(drawn).join(few, "doc_id").select("text", "toxic")
    rows = stash(rows, "toxic_sample")
    size = {r["y"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    rows = rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    schema = "term string, toxic long, clean long"
    terms_ = rows.mapInArrow(count_terms, schema).groupBy("term").agg(*sums)
    # by the evidence that a term without any clean document would have; the exact choice follows
    weight = F.log((F.col("toxic") + 0.5) / (size[True] + 1)) - F.log((F.col("clean") + 0.5) / (size[False] + 1))
    telling = terms_.filter(f"toxic >= {SUPPORT}").withColumn("weight", weight).filter((F.col("weight") >= LEAST) & (F.col("weight") * F.col("toxic") >= EVIDENCE))
    best = telling.orderBy(F.desc(F.col("weight") * F.col("toxic")), "term").limit(entries)
    model = Model(_chosen(best.select("term", "toxic", "clean").toPandas(), size[True], size[False], entries), exceptions)
    held = spark.sparkContext.broadcast(model)
    pairs = rows.mapInArrow(_phrases(held), schema).groupBy("term").agg(*sums)
    odds = (F.col("toxic") + 0.5) / (size[True] + 1) <= (F.col("clean") + 0.5) / (size[False] + 1)
    excused = pairs.filter((F.col("clean") >= SUPPORT) & odds).orderBy(F.desc("clean"), "term").limit(PHRASES).collect()
    held.unpersist()
    model.exceptions = sorted({*model.exceptions, *(r["term"] for r in excused)})
    held = spark.sparkContext.broadcast(model)
    left = rows.mapInArrow(_entries(held), schema).groupBy("term").agg(*sums).toPandas()
    held.unpersist()
    learned = Model({})
    learned.weights, learned.exceptions = _weighed(model.weights, left, size[True], size[False]), model.exceptions
    held = spark.sparkContext.broadcast(learned)
    bins = rows.mapInArrow(_bins(held), "strength long, words long, toxic long, n long").groupBy("strength", "words", "toxic").agg(F.sum("n").alias("n")).toPandas()
    held.unpersist()
    some = (bins["strength"] != NONE).to_numpy(float)
    x = np.column_stack([np.ones(len(bins)), some, *(bins[c].to_numpy(float) * some / STEPS for c in ("strength", "words"))])
    learned.curve = tuple(logistic(x, bins["toxic"].to_numpy(float), bins["n"].to_numpy(float)).tolist())
    return learned


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, then score, n_matches and matches (weight:start:end of a word, in code points of the text, comma-joined)."""
    spark = docs.sparkSession
    byte_batches(spark, 1 << 22)
    held = spark.sparkContext.broadcast(model)

    def judge(text: str) -> tuple[float, int, str]:
        m = held.value
        if m is None:
            return 0.0, 0, ""
        folded, at = fold(text)
        strength, words, got = m.strength(folded)
        return m.score(strength, words), len(got), ",".join(f"{w:.2f}:{at[s + 1]}:{at[folded.index(' ', e) - 1] + 1}" for s, e, w in got)

    def run(batches):
        for b in batches:
            out = [judge(t or "") for t in b.column(0).to_pylist()]
            score, n, where = zip(*out, strict=True) if out else ((),) * 3
            cols = [*b.columns[1:], pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(where, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[1:], "score", "n_matches", "matches"])

    rows = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{k}`") for k in keep))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}score double, n_matches long, matches string")


def score(docs: DataFrame, labels: DataFrame, folds: int = HOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches of each row of docs; trained on rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(folds).alias("held_out"))
    model = train(rows.filter("not held_out"), labels)
    out = predict(rows, model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")

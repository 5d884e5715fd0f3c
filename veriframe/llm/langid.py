"""Language identification by error-correcting output codes over n-gram classifiers (operator 4).

Each language has a codeword of +1/-1 bits. A bit's classifier is naive Bayes over hashed byte n-grams of the lower-cased
text: the weight of an n-gram is the log ratio of its smoothed frequency in the languages with +1 and with -1. Decoding is
loss-weighted: the codeword with the least sum, over the bits, of the bit's weight times exp(-codebit * margin) is chosen;
if the next one is almost as near, the prediction is flagged as ambiguous. Training counts come from all training rows,
as one sum for each language and hash bin (languages x 32,768 numbers at most reach the driver).

Null text, or text with no letter, gives `und` with score 0. Rows with null lang, text or doc_id do not train. Without any
training row every prediction is `und`. Repeated rows count as often as they occur; ties go to the first language by name.

Training hashes the texts of a batch and language as one. Prediction hashes and weighs texts side by side, those of about the
same length together; longer ones one by one.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import binary, small_batches

BINS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTH = 0.5
SLICE = 1 << 20  # bytes of n-grams handled at a time
JOINED = 1 << 15  # bytes of texts counted at a time
CELLS = 1 << 16  # bytes of texts side by side, weights gathered and losses at a time
AMBIGUOUS = 0.05  # least difference in score of the two best
HOLD = 5


def held_out(folds: int) -> Column:
    """Whether crc32(doc_id as text) is divisible by folds; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1/-1, a row a language: all splits up to 5 languages, else random codes with each language apart from the rest."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        gap = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


def _grams(b: np.ndarray):
    """For each order n: n and the hash bins of the n-grams, where they start along the first axis of b (bytes as uint32)."""
    h = np.zeros(b.shape, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193)
        h += b[n - 1 :]
        h += np.uint32(n)
        if n in ORDERS:
            x = h * np.uint32(0x9E3779B1)
            x >>= np.uint32(17)
            yield n, x.view(np.int32)


def bins(*slices: bytes) -> np.ndarray:
    """Hash bins of the n-grams that start within the first SLICE bytes, for each order, one after the other.

    Several short slices are hashed as one; n-grams that reach from one into the next get BINS.
    """
    b = np.frombuffer(b"".join(slices), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in slices])[:-1]
    out = [np.zeros(0, np.int32)]
    for n, x in _grams(b):
        if len(ends):
            over = (ends - np.arange(1, n)[:, None]).ravel()
            x[over[(over >= 0) & (over < len(x))]] = BINS
        out.append(x[:SLICE])
    return np.concatenate(out)


def _pieces(text: bytes):
    """Slices of a text with a blank on both sides, overlapping so that each n-gram starts in one and lies within it."""
    padded = b" " + text.lower() + b" "
    for i in range(0, len(padded), SLICE):
        yield padded[i : i + SLICE + max(ORDERS) - 1]


def _short(text: bytes) -> bool:
    """Whether a text has BINS n-grams at most, so that it may go side by side with others."""
    return len(ORDERS) * (len(text) + 2) <= BINS


def _groups(texts: list[bytes]):
    """Places of the short texts, in groups of about the same length that take CELLS bytes side by side."""
    order = sorted((i for i, t in enumerate(texts) if _short(t)), key=lambda i: -len(texts[i]))
    while order:
        n = CELLS // (len(texts[order[0]]) + 2)
        yield order[:n]
        order = order[n:]


def side_by_side(texts: list[bytes]):
    """For each order, the hash bins of the n-grams of texts: a row a place in a text, a column a text, BINS beyond its end."""
    padded = [b" " + t.lower() + b" " for t in texts]
    size = np.array([len(t) for t in padded])
    b = np.frombuffer(b"".join(t.ljust(size.max()) for t in padded), np.uint8).reshape(len(texts), -1)
    for n, x in _grams(b.T.astype(np.uint32, order="C")):
        full = max(size.min() - n + 1, 0)  # rows where no text has ended
        x[full:][np.arange(full, len(x))[:, None] > size - n] = BINS
        yield x


def counted(at: np.ndarray) -> np.ndarray:
    """How often each bin, and BINS, occurs in at; in blocks, as numpy turns them into 64-bit numbers first."""
    sums = np.zeros(BINS + 1, np.int64)
    for i in range(0, len(at), CELLS):
        sums += np.bincount(at[i : i + CELLS], minlength=BINS + 1)
    return sums


def tally(texts: list[bytes]) -> np.ndarray:
    """How often each hash bin occurs in the texts, JOINED bytes of them hashed at a time, or one slice."""
    sums, held, size = np.zeros(BINS + 1, np.int64), [], 0
    for piece in itertools.chain.from_iterable(map(_pieces, texts)):
        if held and size + len(piece) > JOINED:
            sums += counted(bins(*held))
            held, size = [], 0
        held.append(piece)
        size += len(piece)
    if held:
        sums += counted(bins(*held))
    return sums[:BINS]


def count_bins(batches):
    """Rows (lang, bin, n): the n-gram counts of a task, one row a language and bin."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(1).to_pylist(), binary(b.column(0)), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            sums = total.setdefault(lang, np.zeros(BINS, np.int64))
            sums += tally(some)
    for lang, sums in total.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bin", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BINS))
        bits = self.code.shape[1]
        weights = np.zeros((BINS, bits), np.float32)
        share = np.exp(p)
        for k in range(bits):
            plus, minus = self.code[:, k] > 0, self.code[:, k] < 0
            if plus.any() and minus.any():
                weights[:, k] = np.log(share[plus].mean(0)) - np.log(share[minus].mean(0))
        # a bit weighs as much as its classifier parts the training counts of the two sides
        margin = (counts / np.maximum(counts.sum(1, keepdims=True), 1)) @ weights * self.code
        self.scale = 1 / np.maximum(np.abs(margin).mean(0), 1e-6)
        self.loss = np.clip(margin.min(0) * self.scale, 0.05, 1)
        # rows of whole 32 bytes are gathered fastest; the last one weighs nothing
        self.weights = np.pad(weights, ((0, 1), (0, -bits % 8 if bits > 1 else 0)))

    @functools.cached_property
    def doubles(self) -> np.ndarray:
        """The weights as the sums of long texts take them, turned into doubles once a worker."""
        return self.weights[:BINS, : self.code.shape[1]].astype(float)

    def margins(self, text: bytes) -> np.ndarray:
        bits = self.code.shape[1]
        total, n = np.zeros(bits), 0
        for piece in _pieces(text):
            at = bins(piece)
            total += counted(at)[:BINS] @ self.doubles if len(at) > BINS else self.weights.take(at, axis=0)[:, :bits].sum(0)
            n += len(at)
        return total / max(n, 1) * self.scale

    def short_margins(self, texts: list[bytes]) -> np.ndarray:
        """The margins of short texts, a row a text. Each text's weights are added in the order in which margins() does."""
        total = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        step = max(CELLS // total.size, 1)
        for x in side_by_side(texts):
            for i in range(0, len(x), step):
                got = self.weights.take(x[i : i + step], axis=0)
                got[0] += total
                total = got.sum(0)
        size = np.array([len(t) + 2 for t in texts])
        n = sum(np.maximum(size - k + 1, 0) for k in ORDERS)
        return total[:, : self.code.shape[1]] / n[:, None].astype(float) * self.scale

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        margins = np.zeros((len(texts), self.code.shape[1]))
        several = self.code.shape[1] > 1  # numpy adds a single column in another order
        for at in _groups(texts) if several else ():
            margins[at] = self.short_margins([texts[i] for i in at])
        for i, text in enumerate(texts):
            if not (several and _short(text)):
                margins[i] = self.margins(text)
        first, score, near = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        step = max(CELLS // self.code.size, 1)
        for i in range(0, len(texts), step):
            now = slice(i, i + step)
            loss = (self.loss * np.exp(-np.clip(self.code * margins[now, None], -6, 6))).sum(2)
            order = np.argsort(loss, axis=1, kind="stable")[:, :2]
            z = np.exp(-(loss - np.take_along_axis(loss, order[:, :1], 1)) * 2)
            p = np.take_along_axis(z / z.sum(1, keepdims=True), order, 1)
            first[now], score[now] = order[:, 0], p[:, 0]
            near[now] = len(self.langs) > 1 and p[:, 0] - p[:, -1] < AMBIGUOUS
        return [self.langs[i] for i in first], score, near

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        lang, score, near = self.judge([text])
        return lang[0], float(score[0]), bool(near[0])


def train(docs: DataFrame) -> Model | None:
    """docs: the training rows (text, lang)."""
    small_batches(docs.sparkSession)
    rows = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    got = rows.mapInArrow(count_bins, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[got["lang"].map(langs.index), got["bin"]] = got["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns keep of docs, then lang_pred, score and ambiguous (their names after prefix)."""
    spark = docs.sparkSession
    small_batches(spark)
    hold = spark.sparkContext.broadcast(model)
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous")]
    n = len(keep)

    def run(batches):
        model = hold.value
        for b in batches:
            lang, score, near = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            judged = np.flatnonzero(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) if model else []
            if len(judged):
                lang[judged], score[judged], near[judged] = model.judge(binary(b.column(at).take(pa.array(judged))))
            cols = [*b.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:n], *names])

    text = F.col("text").cast("string")
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = ", ".join(f"`{c}` {t}" for c, t in [*kept.dtypes, *zip(names, ("string", "double", "boolean"), strict=True)])
    at = keep.index("text") if dict(kept.dtypes).get("text") == "string" else n
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *([text.alias("__text")] if at == n else []), letter)
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = HOLD) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row; trained on the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out(folds).alias("held_out"))
    model = train(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows, model, ["doc_id", "held_out"])

"""LM scoring with a probabilistic suffix tree over words (operator 8).

Words are runs without ASCII white space, A-Z lower-cased; an end symbol closes each document. The root of the tree is the
smoothed unigram distribution over all training tokens. Contexts are the last words, one level a length: level after level
counts the runs one word longer whose context has a retained suffix, so no depth is set. Runs that occur SUPPORT times are
listed, whatever the corpus's size. A context is retained if its suffix is (the empty one is the root) and its next-symbol
counts diverge from the suffix's distribution (twice the count times the Kullback-Leibler divergence, against a chi-square
bound). A retained context stores the listed next symbols; the rest of its mass goes to its suffix's distribution,
normalised, so that every state's probabilities sum to 1. A token is rated by the longest retained suffix of the words before
it: each level adds what a stored symbol's probability gains over the level before, or else what scales the suffix.

Each text is cut into words twice: to count them, and to write it as numbers, which all later steps read. Contexts of one
word are judged by tables of runs and a join with the words' probabilities. Then each place travels once, with the words
before it as far as their pairs occur SUPPORT times and DEPTH at most, to the bucket of its last word, or of the first of its
contexts that isn't too frequent for a bucket (Hot; runs of those are counted by all tasks and go to the buckets as tables). A
bucket so has all places of its contexts: it grows the tree, rates the places, and sends each flush of texts the sums. Last
words take turns, so that only some of the places are on disk at once. Longer contexts go on level by level (_read, _answer),
over the texts that meet a retained context of DEPTH words.

Places go by digests of 64 bits in a few compressed messages for each bucket from a million places: sorted digests as
differences, words as numbers, columns as planes of their bytes. Nothing of the tables reaches the driver but filters, of up to
2 ** FILTER bits, which spare rows that no retained context meets and decide no result, and contexts that are met most. Tables
are deleted when nothing reads them any more. P_WORD bounds what words have short numbers; others are counted and looked up by
shuffles, and go by digests.

Null text is the end symbol alone. Rows with null doc_id train. Repeated rows count as often as they occur. Without
training rows every token has probability 1 (a vocabulary of one unknown symbol).
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import binary, byte_batches, drop_shuffles, partitions, stash, unstash
from veriframe.llm.langid import held_out

HOLD = 10
P_WORD = 1e-6  # share of a word with a number of its own
P_OFTEN = 1e-4  # share of a context or run that tasks rate by themselves; all others meet the tables in buckets
SUPPORT, FILTER = 2, 26
BUCKET, BROADCAST_ROWS = 1 << 20, 500_000  # training tokens a bucket
ADD = 0.1
PRIOR = 1.0  # pseudo-count that a context gives to its suffix
END = b"\n"  # no word holds white space
FLUSH, DOCS = 1 << 20, 1 << 16
DEPTH = 5  # words of a context that travel with a place, so that one bucket grows the tree to that depth
TURNS = 2  # parts of all last words whose places travel at once
UNIT = 2.0**-40  # gains travel as multiples
OTHER = 1 << 40  # no word's number: any word after which no run can be listed
WHITE = b" \t\n\v\f\r"
BLACK = bytes(c not in WHITE for c in range(256))


def words_of(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, of each word in them its place among these, and how many words each text has (no end)."""
    texts = binary(column)
    data = b"\n".join([*texts, b""])
    black = np.frombuffer(data.translate(BLACK), np.int8)
    edge = np.flatnonzero(np.diff(black, prepend=np.int8(0)))  # where words begin and, as a space ends each text, end
    begin, size = edge[::2], edge[1::2] - edge[::2]
    offsets = np.append(0, np.cumsum(size))
    raw = data.lower().translate(None, WHITE)
    if len(raw) < 1 << 31:
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    else:
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    coded = flat.dictionary_encode()
    ends = np.cumsum([len(x) + 1 for x in texts])
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), np.diff(np.searchsorted(begin, ends), prepend=0)


def count_words(batches):
    for b in batches:
        words, at, size = words_of(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(np.append(np.bincount(at, minlength=len(words)), len(size)))], ["w", "n"])


class Words:
    """The frequent words, numbered from the most frequent on."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.logp = np.log10((counts + ADD) / (total + ADD * (distinct + 1)))
        self.counts, self.total = counts, total


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Digests of runs: a context and the word after it."""
    x = (context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (word.view(np.uint64) + np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def contexts(ids: np.ndarray, here: np.ndarray, depth: int) -> np.ndarray:
    """Digests of the depth words before places."""
    code = np.zeros(len(here), np.int64)
    for k in range(depth, 0, -1):
        code = mix(code, ids[here - k])
    return code


def lookup(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes in a sorted table, or -1."""
    if not len(table):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


def _passes(table: np.ndarray | None, code: np.ndarray) -> np.ndarray:
    if table is None:
        return np.ones(len(code), bool)
    return (table[code >> 6 & len(table) - 1] >> (code & 63) & 1).astype(bool)


def _filter(kept: DataFrame, name: str) -> np.ndarray:
    """Bits, set where a digest lies: eight a digest or more, but 2 ** FILTER at most."""
    size = 1 << max(6, min(FILTER, (8 * kept.count()).bit_length()) - 6)  # words of 64 bits
    slices = min(64, size)

    def fill(batches):
        got: dict = {}
        for b in batches:
            code, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(part).tolist():
                bits = got.setdefault(k, np.zeros(size // slices, np.int64))
                here = code[part == k]
                np.bitwise_or.at(bits, here >> 6 & size // slices - 1, np.int64(1) << (here & 63))
        for k, bits in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    part = F.shiftright(name, 6).bitwiseAND(size - 1)
    part = F.floor(part / (size // slices)).cast("long")
    rows = kept.select(name, part.alias("part")).repartition(min(slices, partitions(kept.sparkSession)), "part").mapInArrow(fill, "part long, bits binary")
    out = np.zeros((slices, size // slices), np.int64)
    for r in rows.collect():  # at most 2 ** FILTER bits
        out[r["part"]] |= np.frombuffer(r["bits"], np.int64)
    return out.ravel()


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as compressed planes of their bytes; those that fit go in 1, 2 or 4 bytes."""
    wide = [next((k for k in (1, 2, 4) if c.max() < 1 << 8 * k), 8) if len(c) and c.min() >= 0 else 8 for c in columns]
    parts = [np.array([len(columns), *map(len, columns), *wide], "<i8").tobytes()]
    parts += [np.ascontiguousarray(c.astype(f"<i{k}").view(np.uint8).reshape(-1, k).T).tobytes() for c, k in zip(columns, wide, strict=True)]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    k = int(raw[:8].view("<i8")[0])
    sizes, wide, at, out = raw[8 : 8 * (k + 1)].view("<i8").tolist(), raw[8 * (k + 1) : 8 * (2 * k + 1)].view("<i8").tolist(), 8 * (2 * k + 1), []
    for n, w in zip(sizes, wide, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(f"<{'i' if w == 8 else 'u'}{w}").ravel().astype(np.int64, copy=False))
        at += w * n
    return out


def split(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers from 2 on, 1 for OTHER and 0 for the digests, which are apart."""
    rare = word < 0
    return np.where(rare, 0, np.where(word == OTHER, 1, word + 2)), word[rare]


def joined(number: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = np.where(number == 1, OTHER, number - 2)
    out[number == 0] = rare
    return out


def bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the digest as an unsigned number."""
    return ((code.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


PLANES = ("low", "middle", "high")


def _blobs(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def planes(ids: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The numbers of each text's words by bytes: the lowest, the next, and the six others."""
    raw = ids.view(np.uint8).reshape(-1, 8)
    return [_blobs(raw[:, 0], size), _blobs(raw[:, 1], size), _blobs(raw[:, 2:], size * 6)]


def plain(batches):
    """Batches with the numbers of each text's words as 64 bits, in place of their planes, which come first."""
    for b in batches:
        low, middle, high = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8) for i in range(3))
        raw = np.empty((len(low), 8), np.uint8)
        raw[:, 0], raw[:, 1], raw[:, 2:] = low, middle, high.reshape(-1, 6)
        size = np.fromiter(map(len, b.column(0).to_pylist()), np.int64, b.num_rows) * 8
        for i, j in parts_of(size):
            begin, end = size[:i].sum(), size[:j].sum()
            yield pa.RecordBatch.from_arrays([_blobs(raw.ravel()[begin:end], size[i:j]), *(c[i:j] for c in b.columns[3:])], ["ids", *b.schema.names[3:]])


def parts_of(size: np.ndarray, most: int = 1 << 30) -> list[tuple[int, int]]:
    """Slices of rows of at most so many bytes, or of one row."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(size))] if len(size) > begin else out


CONTEXTS, RUNS, ASKED, ASKED_RUNS, KNOWN, COUNTED, PLACES, GAINED, LAST = range(9)  # what a message holds; a bucket's tables come first
MESSAGE = "bucket long, kind int, data binary"


def message(kind: int, to: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([squeeze(*columns)], pa.binary())], ["bucket", "kind", "data"])


def messages(kind: int, buckets: int, key: np.ndarray, *columns: np.ndarray, shared: tuple = ()) -> pa.RecordBatch:
    """Messages of rows for the buckets of their keys: the distinct keys, how many rows each has, and their columns."""
    o = np.argsort(key.view(np.uint64))
    key = key[o]
    cuts = np.searchsorted(bucket(key, buckets), np.arange(buckets + 1))
    to, data = np.flatnonzero(np.diff(cuts)), []
    for k in to.tolist():
        i, j = cuts[k], cuts[k + 1]
        first = np.flatnonzero(np.append(True, key[i + 1 : j] != key[i : j - 1]))
        data.append(squeeze(np.diff(key[i:j][first], prepend=0), np.diff(np.append(first, j - i)), *(c[o[i:j]] for c in columns), *shared))
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([kind] * len(to), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, of each its text and its place in it."""
    size = np.array([len(x) // 8 for x in texts])
    ids = np.frombuffer(b"".join(texts), "<i8")
    return ids, np.repeat(np.arange(len(texts)), size), np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)


def retained(ids: np.ndarray, at: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray]:
    """Places whose contexts of all lengths pass the filters, and the longest of these contexts."""
    here, ctx = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for d, table in enumerate(kept, 1):
        here = here[at[here] >= d]
        if table is None and d < len(kept):
            continue
        ctx = contexts(ids, here, d)
        ok = _passes(table, ctx)
        here, ctx = here[ok], ctx[ok]
    return here, ctx


def _distinct(held: list) -> pa.RecordBatch:
    """Counts of the words after contexts, and on one row of each context what it is without its first word.

    A word whose run without the first word isn't listed can't be listed either: these are one row without word.
    """
    parent, ctx, word, one = (np.concatenate(x) for x in zip(*held, strict=True))
    word = np.where(one, _sent(word), 0)
    # by contexts, then words, in one sort; where its bits don't tell, a run may be two rows, which their bucket adds up
    low = (1 << 24) - 1
    o = np.argsort(((ctx & ~low) | (mix(ctx, word) >> 40 & low)).view(np.uint64))
    c, w = ctx[o], word[o]
    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
    n, ctx, word = np.diff(np.append(first, len(o))), c[first], w[first]
    later = np.append(False, ctx[1:] == ctx[:-1])
    return pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(_word(word), mask=word == 0), pa.array(n), pa.array(parent[o[first]], mask=later)], ["ctx", "word", "n", "parent"])


def _count_runs(depth: int, hold):
    """Counts of the words after contexts of depth words (see _distinct)."""

    def run(batches):
        kept, listed, *alive = hold.value
        held, size = [], 0
        for b in batches:
            ids, _, at = cut(b.column(0).to_pylist())
            here, parent = retained(ids, at, kept or ())
            here, parent = here[at[here] >= depth], parent[at[here] >= depth]
            ctx = contexts(ids, here, depth)
            ok = _passes(*alive, ctx) if alive else np.ones(len(ctx), bool)
            here, parent, ctx = here[ok], parent[ok], ctx[ok]
            held.append((parent, ctx, ids[here], _passes(listed, mix(parent, ids[here]))))
            size += len(ctx)
            if size > FLUSH:
                yield _distinct(held)
                held, size = [], 0
        if size:
            yield _distinct(held)

    return run


def counts_of(buckets: int, got: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of _distinct as messages: the distinct contexts, how many runs each has, its parent's place among the distinct
    parents, these, and of each run the word and n."""
    ctx, n, parent = (got.column(i).fill_null(0).to_numpy() for i in (0, 2, 3))
    word = np.where(got.column(1).is_valid().to_numpy(zero_copy_only=False), _sent(got.column(1).fill_null(0).to_numpy()), 0)
    cuts = np.searchsorted(bucket(ctx, buckets), np.arange(buckets + 1))
    to, data = np.flatnonzero(np.diff(cuts)), []
    for k in to.tolist():
        part = slice(cuts[k], cuts[k + 1])
        keys = ctx[part]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        parents, up = np.unique(parent[part][first], return_inverse=True)
        data.append(squeeze(np.diff(keys[first], prepend=0), np.diff(np.append(first, len(keys))), up, np.diff(parents, prepend=0), word[part], n[part]))
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([COUNTED] * len(to), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _ungroup(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(keys), times)


def _send(kind: int, buckets: int, hold):
    """Rows of retained contexts (ctx, alpha), or of their runs (ctx, run, gain), as messages."""

    def run(batches):
        often, alpha = hold.value[3]
        for b in batches:
            key, *values = (b.column(i).to_numpy() for i in range(b.num_columns))
            if kind == RUNS:
                c = lookup(often, key)
                key = np.where(c >= 0, values[0], key)
                values.append(values[1] - np.append(alpha, 0.0)[c])
            yield messages(kind, buckets, key, *(v.view(np.int64) for v in values))

    return run


def _read(depth: int, buckets: int, hold):
    """Of texts, what meets contexts of depth words, and of those that train the counts of words after contexts one word longer.

    Frequent contexts and runs are rated here. Other runs of frequent contexts are dealt by their own digests and add what
    they gain over the context, all others are dealt by those of their contexts, so that no bucket gets a large share of
    all places.
    """

    def run(batches):
        kept, listed, alive, (often, alpha), (frequent, gain) = hold.value
        asked, held, rows = [], [], []
        n_asked = n_held = n_rows = 0

        def ask():
            doc, ctx, word = (np.concatenate(x) for x in zip(*asked, strict=True))
            own = (word != 0) & (lookup(often, ctx) >= 0)
            names = np.diff(np.concatenate(rows), prepend=0)
            yield messages(ASKED_RUNS, buckets, mix(ctx[own], _word(word[own])), doc[own], shared=(names,))
            yield messages(ASKED, buckets, ctx[~own], doc[~own], word[~own], shared=(names,))

        for b in plain(batches):
            ids, text, at = cut(b.column(0).to_pylist())
            here, ctx = retained(ids, at, kept)
            one = _passes(listed, code := mix(ctx, ids[here]))
            c, r = lookup(often, ctx), lookup(frequent, code)
            sums = np.bincount(text[here], np.where(r >= 0, np.append(gain, 0.0)[r], np.append(alpha, 0.0)[c]), b.num_rows)
            left = (r < 0) & ((c < 0) | one)
            yield message(KNOWN, n_rows % buckets, np.diff(b.column(1).to_numpy(), prepend=0), sums.view(np.int64), np.bincount(text[here[(r >= 0) | (c >= 0)]], minlength=b.num_rows))
            asked.append((text[here[left]] + n_rows, ctx[left], np.where(one, _sent(ids[here]), 0)[left]))
            rows.append(b.column(1).to_numpy())
            n_rows, n_asked = n_rows + b.num_rows, n_asked + len(asked[-1][0])
            if n_asked > FLUSH or n_rows > DOCS:
                yield from ask()
                asked, rows, n_asked, n_rows = [], [], 0, 0
            ok = (at[here] > depth) & ~b.column(2).to_numpy(zero_copy_only=False)[text[here]]
            here, parent, one = here[ok], ctx[ok], one[ok]
            ctx = contexts(ids, here, depth + 1)
            ok = _passes(alive, ctx)
            held.append((parent[ok], ctx[ok], ids[here[ok]], one[ok]))
            n_held += len(held[-1][0])
            if n_held > FLUSH:
                yield counts_of(buckets, _distinct(held))
                held, n_held = [], 0
        if n_asked:
            yield from ask()
        if n_held:
            yield counts_of(buckets, _distinct(held))

    return run


def _sent(word: np.ndarray) -> np.ndarray:
    """Numbers of words from 1 on, as 0 is any word whose run can't be listed; digests are below zero."""
    return np.where(word >= 0, word + 1, word)


def _word(sent: np.ndarray) -> np.ndarray:
    return np.where(sent > 0, sent - 1, sent)


def _merged(parts: list) -> tuple:
    """ctx, word, n and parent of distinct runs."""
    ctx, word, n, parent = (np.concatenate(x) for x in zip(*parts, strict=True))
    code = mix(ctx, word)
    o = np.argsort(code)
    first = np.flatnonzero(np.append(True, code[o[1:]] != code[o[:-1]]))
    at = o[first]
    return ctx[at], word[at], np.add.reduceat(n[o], first), parent[at]


def _listed(parts: list):
    """Runs that occur SUPPORT times, with the counts of their contexts."""
    ctx, word, n, parent = _merged(parts)
    o = np.argsort(ctx)
    ctx, word, n, parent = ctx[o], word[o], n[o], parent[o]
    first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(ctx))))
    ok = (word != 0) & (n >= SUPPORT)
    ctx, word, n, parent, total = ctx[ok], _word(word[ok]), n[ok], parent[ok], total[ok]
    return _batch([None, None, ctx, mix(ctx, word), mix(parent, word), n, total])


def _batch(columns: list) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    kinds = [pa.int64(), pa.float64(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "extra", "ctx", "run", "suffix", "n", "total"])


def _answer(batches):
    """Of the messages of each bucket: what texts gain (row, extra), and the listed runs of the next level."""
    at, tables, ready, parts, size = None, {}, None, [], 0
    for b in batches:
        for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if k != at:
                if parts:
                    yield _listed(parts)
                at, tables, ready, parts, size = k, {CONTEXTS: [], RUNS: []}, None, [], 0
            got = expand(data.as_py())
            if kind == CONTEXTS:
                tables[kind].append((_ungroup(*got[:2]), *got[2:]))
            elif kind == RUNS:
                tables[kind].append(got[2:])
            elif kind == COUNTED:
                keys, times, up, parents, word, n = got
                parts.append((_ungroup(keys, times), word, n, np.repeat(np.cumsum(parents)[up], times)))
                size += len(word)
                if size > 2 * FLUSH:
                    parts = [_merged(parts)]
                    size = min(FLUSH, len(parts[0][0]))
            elif kind == KNOWN:
                yield _gained(got[0], got[1].view(np.float64), got[2])
            else:
                if ready is None:
                    ready = _table(tables[CONTEXTS], 1), _table(tables[RUNS], 2)
                (ctxs, alpha), (runs, gain, over) = ready
                key, doc = _ungroup(*got[:2]), got[2]
                if kind == ASKED:
                    c, r = lookup(ctxs, key), np.where(got[3] == 0, -1, lookup(runs, mix(key, _word(got[3]))))
                    extra = np.where(r >= 0, np.append(gain, 0.0)[r], np.append(alpha, 0.0)[c])
                else:
                    c = r = lookup(runs, key)
                    extra = np.append(over, 0.0)[r]
                yield _gained(got[-1], np.bincount(doc, extra, len(got[-1])), np.bincount(doc[(r >= 0) | (c >= 0)], minlength=len(got[-1])))
    if parts:
        yield _listed(parts)


def _gained(names: np.ndarray, sums: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Rows that met retained contexts, whatever they gained."""
    some = np.flatnonzero(times)
    return _batch([np.cumsum(names)[some], sums[some], *[None] * 5])


class Hot:
    """Contexts too frequent for one bucket, whose runs all tasks count: the places after one go to buckets of its own."""

    def __init__(self, buckets: int, size: int):
        self.first = self.buckets = buckets  # the buckets of all other contexts come first
        self.size = size  # training places a bucket
        self.code = self.base = self.times = self.dropped = np.zeros(0, np.int64)
        self.up: dict = {}
        self.above: dict = {}  # the buckets of a context, and of the hot ones that end with it

    def add(self, found, retained: set) -> None:
        """found: code, total and suffix of a level's contexts; those that aren't retained have no buckets."""
        found = found[found["suffix"].isin([0, *self.code.tolist()])]
        kept = found["code"].isin(retained)
        self.dropped = np.sort(np.append(self.dropped, found["code"][~kept].to_numpy(np.int64)))
        code, total, suffix = (found[c][kept].to_numpy(np.int64) for c in ("code", "total", "suffix"))
        times = -(-total // self.size)
        base = self.buckets + np.cumsum(times) - times
        self.buckets += int(times.sum())
        self.up |= dict(zip(code.tolist(), suffix.tolist(), strict=True))
        for c, b, t in zip(code.tolist(), base.tolist(), times.tolist(), strict=True):
            while c in self.up:
                self.above.setdefault(c, []).extend(range(b, b + t))
                c = self.up[c]
        self.base, self.times = np.append(self.base, base), np.append(self.times, times)
        self.code = np.append(self.code, code)
        o = np.argsort(self.code)
        self.code, self.base, self.times = self.code[o], self.base[o], self.times[o]


def _bits(codes: np.ndarray) -> np.ndarray:
    """A filter of few digests."""
    size = 1 << max(6, min(FILTER, (64 * len(codes)).bit_length()) - 6)
    out = np.zeros(size, np.int64)
    np.bitwise_or.at(out, codes >> 6 & size - 1, np.int64(1) << (codes & 63))
    return out


def _spread(code: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * buckets.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _turn(code: np.ndarray, turns: int) -> np.ndarray:
    return ((code.view(np.uint64) >> np.uint64(32)) * np.uint64(turns) >> np.uint64(32)).astype(np.int64)


def _deal(most: int, turn: int, turns: int, hold):
    """The places of texts whose last word has this turn, with up to `most` words before them, for the bucket of their last word or of the first context
    that isn't hot. A word further back goes only with pairs of words that occur SUPPORT times, or no run is listed."""

    def run(batches):
        first, pairs, hot = hold.value
        held, rows, texts = [], [], []
        n_held = n_rows = 0

        def send():
            to, last, word, doc, many, given, *back = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort((to.view(np.uint64) << np.uint64(40)) | (mix(np.zeros(len(last), np.int64), last).view(np.uint64) >> np.uint64(24)))
            to = to[o]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            names, known = np.diff(np.concatenate(rows), prepend=0), np.concatenate(texts)
            data = []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(o)], strict=True):
                at = o[i:j]
                x, n = last[at], many[at]
                new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                data.append(squeeze(x[new], np.diff(np.append(new, j - i)), *split(word[at]), doc[at], n, given[at], *(c for k in range(1, most) for c in split(back[k - 1][at[n > k]])), names, known))
            yield pa.RecordBatch.from_arrays([pa.array(to[cuts]), pa.array([PLACES] * len(cuts), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

        for b in plain(batches):
            ids, text, at = cut(b.column(0).to_pylist())
            here = np.flatnonzero(at > 0)
            ctx = contexts(ids, here, 1)
            pair = np.zeros(len(ids), bool)
            pair[here] = _passes(pairs, mix(ctx, ids[here]))
            ok = _turn(ctx, turns) == turn
            here, ctx = here[ok], ctx[ok]
            ok = _passes(first, ctx) & (lookup(hot.dropped, ctx) < 0)
            here, ctx = here[ok], ctx[ok]
            many, more = np.ones(len(here), np.int64), np.ones(len(here), bool)
            for k in range(1, most + 1):
                more &= pair[np.maximum(here - k, 0)]
                many += more
            to, given = bucket(ctx, hot.first), np.full(len(here), 2)
            h = lookup(hot.code, ctx)
            on, depth = np.flatnonzero(h >= 0), 2
            h = h[on]
            while len(on):
                longer = many[on] >= depth
                code = mix(ids[here[on]], np.full(len(on), depth))
                code[longer] = contexts(ids, here[on[longer]], depth)
                nxt = np.where(longer, lookup(hot.code, code), -1)
                many[on[longer & (lookup(hot.dropped, code) >= 0)]] = depth - 1
                end = nxt < 0
                to[on[end]] = hot.base[h[end]] + _spread(code[end], hot.times[h[end]])
                given[on] = depth
                on, h, depth = on[~end], nxt[~end], depth + 1
            back = [ids[np.maximum(here - k - 1, 0)] for k in range(1, most)]
            held.append((to, ids[here - 1], np.where(pair[here], ids[here], OTHER), text[here] + n_rows, many, given, *back))
            rows.append(b.column(1).to_numpy())
            texts.append(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            n_rows, n_held = n_rows + b.num_rows, n_held + len(here)
            if n_held > FLUSH or n_rows > DOCS:
                if n_held:
                    yield from send()
                held, rows, texts, n_rows, n_held = [], [], [], 0, 0
        if n_held:
            yield from send()

    return run


def _tables(kind: int, turn: int, turns: int, hold):
    """Contexts (ctx, total, alpha) or their runs (ctx, run, n, gain) for the buckets of the places that meet them."""

    def run(batches):
        hot = hold.value[2]
        for b in batches:
            key, *values = (b.column(i).to_numpy() for i in range(b.num_columns))
            hot_at = lookup(hot.code, key)
            seldom = (hot_at < 0) & (_turn(key, turns) == turn)
            yield messages(kind, hot.first, key[seldom], *(v[seldom].view(np.int64) for v in values))
            o = np.flatnonzero(hot_at >= 0)
            o = o[np.argsort(key[o])]
            cuts = np.flatnonzero(np.append(True, key[o][1:] != key[o][:-1])) if len(o) else o
            for part in np.split(o, cuts[1:]) if len(o) else ():
                data = squeeze(key[part[:1]], np.array([len(part)]), *(v[part].view(np.int64) for v in values))
                to = hot.above[int(key[part[0]])]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([kind] * len(to), pa.int32()), pa.array([data] * len(to), pa.binary())], ["bucket", "kind", "data"])

    return run


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _count(ctx: np.ndarray, word: np.ndarray, known: np.ndarray, q: np.ndarray, stored: np.ndarray):
    """What places gain after contexts, all of whose places are here, and the runs of the retained ones.

    Of each place: whether its context is retained, the gain, and the probability of its word if that run is stored.
    """
    code = mix(ctx, word)
    o = np.argsort(code)
    run = code[o]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    times, at = np.diff(np.append(first, len(o))), o[first]
    n, c = _sums(known[o], first), ctx[at]
    by = np.argsort(c)
    c = c[by]
    head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(head, len(by)))
    n, at, run = n[by], at[by], run[first][by]
    total = _sums(n, head)
    listed = (n >= SUPPORT) & stored[at]
    m, p = np.where(listed, n, 0), np.where(listed, q[at], 0.0)
    kinds, inside, sum_q, each = _sums(listed.astype(np.int64), head), _sums(m, head), _sums(p, head), np.repeat(total, size)
    share = np.where(listed, n / np.maximum(each, 1), 1.0)
    kl = _sums(np.where(listed, share * np.log(share / np.where(listed, p, 1.0)), 0.0), head)
    rest, rest_q = (total - inside) / np.maximum(total, 1), np.maximum(1 - sum_q, 1e-12)
    kl += np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1.0) / rest_q), 0.0)
    kept = (kinds > 0) & (2 * total * kl > kinds + 3 * np.sqrt(2 * kinds))
    alpha = np.log10((total - inside + PRIOR) / (total + PRIOR) / rest_q)
    held = np.repeat(kept, size)
    listed &= held
    mine = n / (each + PRIOR)
    gain = np.where(listed, np.log10(np.where(listed, mine / np.where(listed, p, 1.0), 1.0)), np.where(held, np.repeat(alpha, size), 0.0))
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    place = np.empty(len(o), np.int64)
    place[o] = np.repeat(back, times)
    return held[place], gain[place], mine[place], listed[place], (c[listed], run[listed], n[listed], each[listed], gain[listed])


def _grow(most: int):
    """Of each bucket, the tables first: the tree of its contexts to `most` words, and what texts gain by it.

    Gains of a flush of texts go on as one message of each task. Contexts of `most` words are listed with their runs.
    """

    def levels(at, tables, places, texts, sums):
        ctxs, total, alpha = _numbers(tables[CONTEXTS], "if")
        runs, n, gain = _numbers(tables[RUNS], "if")
        tables.clear()
        last, word, many, given, known, *back = (np.concatenate(places.pop(0)) for _ in range(most + 4))
        extra = np.zeros(len(word))
        on, before, q, stored = np.arange(len(word)), [last], np.zeros(0), np.zeros(0, bool)
        for depth in range(1, most + 1):
            ctx = np.zeros(len(on), np.int64)
            for w in reversed(before):
                ctx = mix(ctx, w)
            told = given[on] > depth
            keep, own = np.zeros(len(on), bool), np.zeros(len(on), bool)
            mine, gained = np.zeros(len(on)), np.zeros(len(on))
            if told.any():
                c, r = lookup(ctxs, ctx[told]), lookup(runs, mix(ctx[told], word[on[told]]))
                r = np.where(c >= 0, r, -1)
                keep[told], own[told] = c >= 0, r >= 0
                gained[told] = np.where(r >= 0, np.append(gain, 0.0)[r], np.append(alpha, 0.0)[c])
                mine[told] = np.append(n, 0)[r] / (np.append(total, 0)[c] + PRIOR)
            local = np.flatnonzero(~told)
            if len(local):
                *got, deepest = _count(ctx[local], word[on[local]], known[on[local]], q[local], stored[local])
                keep[local], gained[local], mine[local], own[local] = got
                if depth == most and len(deepest[0]):
                    yield message(LAST, at, *(x.view(np.int64) for x in deepest))
            extra[on] += gained
            keep &= many[on] > depth
            if depth < most:
                # ragged columns hold a word of the places that have one
                index = np.cumsum(many > depth) - 1
                before = [x[keep] for x in before] + [back[depth - 1][index[on[keep]]]]
            on, q, stored = on[keep], mine[keep], own[keep]
        deep = np.zeros(len(word), np.int64)
        deep[on] = 1
        start = 0
        for doc, names in texts:
            end = start + len(doc)
            more, further = (np.bincount(doc, v, len(names)) for v in (np.rint(extra[start:end] / UNIT), deep[start:end]))
            times, key = np.bincount(doc, minlength=len(names)), int(names[0])
            old = sums.get(key, [names, 0, 0, 0])
            sums[key] = [names, old[1] + more, old[2] + further, old[3] + times]
            start = end

    def flush(sums):
        for key, (names, more, further, times) in sums.items():
            some = np.flatnonzero(times)
            yield message(GAINED, key, np.diff(names[some], prepend=0), more[some].astype(np.int64), further[some].astype(np.int64))
        sums.clear()

    def run(batches):
        at, tables, places, texts = None, {CONTEXTS: [], RUNS: []}, [[] for _ in range(most + 4)], []
        sums: dict = {}
        for b in batches:
            for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != at:
                    if texts:
                        yield from levels(at, tables, places, texts, sums)
                    at, tables, places, texts = k, {CONTEXTS: [], RUNS: []}, [[] for _ in range(most + 4)], []
                    if sum(len(x[0]) for x in sums.values()) > 2 * FLUSH:
                        yield from flush(sums)
                got = expand(data.as_py())
                if kind == PLACES:
                    last, times, number, rare, doc, many, given, *back, names, held = got
                    got = [np.repeat(last, times), joined(number, rare), many.astype(np.int8), given.astype(np.int8), (1 - held[doc]).astype(np.int32)]
                    for column, c in zip(places, [*got, *(joined(*back[i : i + 2]) for i in range(0, len(back), 2))], strict=True):
                        column.append(c)
                    texts.append((doc.astype(np.int32), np.cumsum(names)))
                elif kind == CONTEXTS:
                    tables[kind].append((_ungroup(*got[:2]), *got[2:]))
                else:
                    tables[kind].append(got[2:])
        if texts:
            yield from levels(at, tables, places, texts, sums)
        yield from flush(sums)

    return run


def _numbers(parts: list, kinds: str) -> tuple:
    """Sorted digests of tables, and their columns of whole numbers (i) or floats."""
    if not parts:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64 if k == "i" else float) for k in kinds)
    code, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.argsort(code)
    return code[o], *(v[o] if k == "i" else v[o].view(np.float64) for v, k in zip(values, kinds, strict=True))


def _collect(batches):
    """What rows gain, one row of each, of messages sorted by flushes of texts."""
    at, parts = None, []

    def done():
        names, more, further = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows, place = np.unique(names, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(place, more) * UNIT), pa.array(np.bincount(place, further).astype(np.int64))], ["row", "extra", "deep"])

    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if k != at and parts:
                yield done()
                parts = []
            at = k
            names, more, further = expand(data.as_py())
            parts.append((np.cumsum(names), more, further))
    if parts:
        yield done()


def _last(batches):
    for b in batches:
        for data in b.column(2):
            ctx, run, n, total, gain = expand(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(run), pa.array(n), pa.array(n / (total + PRIOR)), pa.array(gain.view(np.float64))], ["ctx", "run", "n", "p", "gain"])


def _table(parts: list, columns: int) -> tuple:
    if not parts:
        return np.zeros(0, np.int64), *[np.zeros(0)] * columns
    code, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.argsort(code)
    return code[o], *(v[o].view(np.float64) for v in values)


def _often(rows: DataFrame, code: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests, sorted, and values of what is met so often that each task holds it: at most 1 / P_OFTEN rows."""
    got = rows.select(F.col(code).alias("code"), F.col(value).alias("value")).toPandas().sort_values("code")
    return got["code"].to_numpy(np.int64), got["value"].to_numpy(float)


def _level(raw: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The retained contexts (ctx, total, alpha), and their listed runs (ctx, run, n, p, gain); before has p of shorter runs.

    Only runs of retained contexts are in before, so that what joins it has a retained suffix.
    """
    listed = stash(raw.join(before.select(F.col("run").alias("suffix"), F.col("p").alias("q")).hint("shuffle_hash"), "suffix").select("ctx", "run", "n", "total", "q"), "listed", "zstd")
    unstash(raw)
    share = F.col("n") / F.col("total")
    states = listed.groupBy("ctx").agg(F.first("total").alias("total"), F.count("*").alias("kinds"), F.sum("n").alias("inside"), F.sum("q").alias("q"), F.sum(share * F.log(share / F.col("q"))).alias("kl"))
    rest, rest_q = (F.col("total") - F.col("inside")) / F.col("total"), F.greatest(1 - F.col("q"), F.lit(1e-12))
    kl = F.col("kl") + F.when(rest > 0, rest * F.log(rest / rest_q)).otherwise(0.0)
    states = states.filter(2 * F.col("total") * kl > F.col("kinds") + 3 * F.sqrt(2 * F.col("kinds")))
    states = stash(states.select("ctx", "total", F.log10((F.col("total") - F.col("inside") + PRIOR) / (F.col("total") + PRIOR) / rest_q).alias("alpha")), "states")
    p = F.col("n") / (F.col("total") + PRIOR)
    runs = stash(listed.join(states.hint("shuffle_hash"), "ctx", "left_semi").select("ctx", "run", "n", "total", F.log10(p / F.col("q")).alias("gain")), "runs", "zstd")
    unstash(listed)
    return states, runs.select("ctx", "run", "n", p.alias("p"), "gain")


def score(docs: DataFrame, folds: int = HOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    byte_batches(spark, 1 << 22)
    drop_shuffles(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long"), held_out(folds).alias("held_out"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = training.mapInArrow(count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))
    counts = stash(counts, "words")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    least_top = max(2, P_WORD * total)
    top = counts.filter(F.col("c") >= least_top).toPandas()  # at most 1 / P_WORD rows
    top = top.sort_values(["c", "w"], ascending=[False, True])
    words = Words([bytes(w) for w in top["w"]], top["c"].to_numpy(np.int64), total, distinct)
    hold = sc.broadcast(words)
    unknown = float(total + ADD * (distinct + 1))

    def digest(w):  # below zero
        return xxhash.xxh64_intdigest(w) // 2 - (1 << 63)

    def number(batches):
        get = hold.value.index.get
        end = get(END, -1)
        for b in batches:
            words, at, size = words_of(b.column(0))
            listed = words.to_pylist()
            own = np.fromiter(map(get, listed, repeat(-1)), np.int64, len(listed))
            seldom = own < 0
            own[seldom] = [digest(listed[i]) for i in np.flatnonzero(seldom).tolist()]
            doc = np.repeat(np.arange(len(size)), size)
            ids = np.full(len(at) + len(size), end if end >= 0 else digest(END), np.int64)
            ids[np.arange(len(at)) + doc] = own[at]
            rare = seldom[at] if len(at) else np.zeros(0, bool)
            pairs, times = np.unique(doc[rare] << 32 | at[rare], return_counts=True)
            if end < 0:  # no training text, or one
                pairs, times = np.append(pairs, np.arange(len(size)) << 32 | len(listed)), np.append(times, np.ones(len(size), np.int64))
                o = np.argsort(pairs)
                pairs, times, words = pairs[o], times[o], pa.concat_arrays([words, pa.array([END], pa.binary())])
            lists = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) << 32), pa.int32())
            cols = [*planes(ids, size + 1), pa.ListArray.from_arrays(lists, words.take(pa.array(pairs & 0xFFFFFFFF))), pa.ListArray.from_arrays(lists, pa.array(times))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], ["doc_id", "held_out", *PLANES, "rare", "times"])

    numbered = stash(rows.mapInArrow(number, "doc_id long, held_out boolean, low binary, middle binary, high binary, rare array<binary>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "numbered", "zstd")

    def roots(batches):
        get = hold.value.index.get
        for b in batches:
            ids = np.array([digest(w) if (i := get(w)) is None else i for w in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(np.zeros(len(ids), np.int64), ids)), b.column(1)], ["run", "p"])

    runs = counts.filter(F.col("c") >= SUPPORT).select("w", ((F.col("c") + ADD) / F.lit(unknown)).alias("p")).mapInArrow(roots, "run long, p double")
    buckets = max(8, total // BUCKET)

    def answered(messages):
        dealt = messages.repartition(max(4, buckets // 2), "bucket").sortWithinPartitions("bucket", "kind")
        return stash(dealt.mapInArrow(_answer, "row long, extra double, ctx long, run long, suffix long, n long, total long"), "counted", "zstd")

    words_twice = _filter(runs, "run")
    training = numbered.filter(~F.col("held_out")).select(*PLANES)

    def counted(texts, depth, kept, listed, *alive):
        """Runs of one word more than depth that occur SUPPORT times."""
        core = sc.broadcast((kept, listed, *alive))

        def run(batches):
            for got in _count_runs(depth, core)(plain(batches)):
                yield counts_of(buckets, got)

        out = answered(texts.mapInArrow(run, MESSAGE)).filter("run is not null").select("ctx", "run", "suffix", "n", "total")
        core.unpersist()
        return out

    raw, before = counted(training, 1, None, words_twice, words_twice), runs
    pairs = _filter(raw, "run")
    hot, least = Hot(buckets, max(1, BUCKET // 2)), max(1, BUCKET // 2, P_OFTEN * total / 10)
    found = raw.filter(F.col("total") >= least).select(F.col("ctx").alias("code"), "total", F.lit(0).cast("long").alias("suffix")).distinct().toPandas()
    levels, frequent = [], []
    while True:
        longer = raw.filter(F.col("n") >= least).select(F.col("run").alias("code"), F.col("n").alias("total"), "suffix").distinct().toPandas()
        kept, runs = _level(raw, before)
        levels.append((kept, runs))
        hot.add(found, set(kept.filter(F.col("total") >= least).select("ctx").toPandas()["ctx"].tolist()) if len(found) else set())
        frequent.append(_bits(found["code"].to_numpy(np.int64)))
        if len(levels) == DEPTH or not longer["suffix"].isin(hot.code).any():
            break
        found, before = longer, runs
        own = spark.createDataFrame(found[["code"]].rename(columns={"code": "ctx"}), "ctx long")
        raw = counted(training, len(levels) + 1, frequent, None, _bits(found["code"].to_numpy(np.int64))).join(F.broadcast(own), "ctx", "left_semi")
    extra, depth, runs = None, DEPTH + 1, levels[0][1]
    if levels[0][0].limit(1).count():
        filters = [_filter(levels[0][0], "ctx")]
        core = sc.broadcast((filters[0], pairs, hot))
        grown = []
        for turn in range(TURNS):
            sent = numbered.select(*PLANES, "row", "held_out").mapInArrow(_deal(DEPTH, turn, TURNS, core), MESSAGE)
            for kept, runs in levels:
                sent = sent.unionByName(kept.select("ctx", "total", "alpha").mapInArrow(_tables(CONTEXTS, turn, TURNS, core), MESSAGE))
                sent = sent.unionByName(runs.select("ctx", "run", "n", "gain").mapInArrow(_tables(RUNS, turn, TURNS, core), MESSAGE))
            dealt = sent.repartition(max(12, hot.buckets // (4 * TURNS)), "bucket").sortWithinPartitions("bucket", "kind")
            grown.append(stash(dealt.mapInArrow(_grow(DEPTH), MESSAGE), "grown", "uncompressed"))
        core.unpersist()
        all_grown = reduce(DataFrame.unionByName, grown)
        gained = all_grown.filter(F.col("kind") == GAINED).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
        extra = stash(gained.mapInArrow(_collect, "row long, extra double, deep long"), "met")
        deep, texts = extra.agg(F.coalesce(F.sum("deep"), F.lit(0)), F.count(F.when(F.col("deep") > 0, 1))).first()
        more = extra.filter("deep > 0").select("row")
        runs = all_grown.filter(F.col("kind") == LAST).mapInArrow(_last, "ctx long, run long, n long, p double, gain double")
        if len(levels) == DEPTH:
            runs = runs.unionByName(levels[-1][1].select(runs.columns))
        runs = stash(runs, "runs", "zstd") if deep else runs
        extra = extra.select("row", "extra")
        for kept, shorter in levels if deep else levels[1:]:
            unstash(kept)
            unstash(shorter)
        unstash(all_grown)
        if deep:
            buckets = max(8, deep // BUCKET)
            filters += [*[pairs, *[None] * DEPTH][: DEPTH - 2], _filter(runs.select("ctx").distinct(), "ctx")]
            reading = stash(numbered.join(F.broadcast(more) if texts < BROADCAST_ROWS else more, "row", "left_semi").select(*PLANES, "row", "held_out"), "numbered", "zstd")
            raw = counted(reading.filter(~F.col("held_out")).select(*PLANES), depth, filters, _filter(runs, "run"))
    else:
        deep = 0
    while deep:
        shorter, (kept, runs) = runs, _level(raw, runs)
        unstash(shorter)
        if not kept.limit(1).count():
            break
        filters.append(_filter(kept, "ctx"))
        often = P_OFTEN * total
        core = sc.broadcast((filters, _filter(runs, "run"), None, _often(kept.filter(F.col("total") >= often), "ctx", "alpha"), _often(runs.filter(F.col("n") >= often), "run", "gain")))
        sent = [reading.select(*PLANES, "row", "held_out").mapInArrow(_read(depth, buckets, core), MESSAGE)]
        sent += [rows.mapInArrow(_send(kind, buckets, core), MESSAGE) for kind, rows in ((CONTEXTS, kept.select("ctx", "alpha")), (RUNS, runs.select("ctx", "run", "gain")))]
        got = answered(sent[0].unionByName(sent[1]).unionByName(sent[2]))
        core.unpersist()
        unstash(kept)
        sums = stash(got.filter("row is not null").groupBy("row").agg(F.sum("extra").alias("extra")), "met")
        extra = extra.unionByName(sums)
        raw = got.filter("run is not null").select("ctx", "run", "suffix", "n", "total")
        left = sums.count()
        if 4 * left < texts:  # a text that met no retained context meets no longer one
            shorter, reading, texts = reading, stash(reading.join(F.broadcast(sums), "row", "left_semi") if left < BROADCAST_ROWS else reading.join(sums, "row", "left_semi"), "numbered", "zstd"), left
            unstash(shorter)
        depth += 1
    if deep:
        unstash(reading)

    def rate(batches):
        logp = hold.value.logp
        for b in plain(batches):
            ids = [np.frombuffer(x, "<i8") for x in b.column(0).to_pylist()]
            hit = [x[x >= 0] for x in ids]
            cols = [np.array([len(x) for x in ids], np.int64), np.array([len(x) for x in hit], np.int64), np.array([logp[x].sum() if len(x) else 0.0 for x in hit], float)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:3], *map(pa.array, cols), *b.columns[3:]], ["doc_id", "held_out", "n", "known", "base", "rare", "times", "row"])

    got = numbered.select(*PLANES, "doc_id", "held_out", "rare", "times", "row").mapInArrow(rate, "doc_id long, held_out boolean, n long, known long, base double, rare array<binary>, times array<long>, row long")
    tail = got.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("m"))
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(counts.filter(F.col("c") < least_top).hint("shuffle_hash"), "w", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10((c + ADD) / F.lit(unknown))).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("seen"))
    out = got.drop("rare", "times").join(tail, "row", "left")
    out = out.withColumn("extra", F.lit(0.0)) if extra is None else out.join(extra.groupBy("row").agg(F.sum("extra").alias("extra")), "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.coalesce("extra", F.lit(0.0))).alias("score"))

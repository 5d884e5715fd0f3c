"""Removal of repeated 400-byte strings by blockwise ranks of difference-cover samples and suffix buckets (operator 7).

Positions of a document whose offset modulo V is in a difference cover D are its sample; any two suffixes reach sample
positions together within V bytes. The rank class of a sample position names the CORE bytes from it. A string of
LENGTH = CORE + V - 1 bytes at two places thus has, at the same distance within it, two sample positions of one class:
suffixes with no repeated class in their first V places are unique and are never looked at again.

A suffix bucket is made of all suffixes that reach a sample position of one class within V bytes. Two of them that do so at
the same distance compare as their bytes before the position, then its rank (a tie of CORE bytes that is never read again),
then the bytes after. So each position of a repeated class carries the V - 1 bytes on both sides into its bucket, and the
longest tie with another position, L bytes before and R after, is taken from the bytes themselves: if CORE + L + R reaches
LENGTH, all of it is repeated. BUCKETS rounds work on a part of the classes each, and bound the disk that a sort takes.
Positions that agree in all these bytes are settled when ranks are made, and one of them stands for all in the bucket.

Hot classes: a task keeps at most LOCAL rows of a class in its batch, and marks the class as large; a class of more than
LARGE rows is large too. Its suffixes are counted by digests in partial sums and joined back, so that no task holds it.

Rank classes are named by 62 bits of a polynomial hash modulo 2^64 over random byte codes (the bucket adds 64 of another
one), not by their place in the text order: only equality matters. Equal strings are always found. Settled positions rest
on 94 bits, windows of large classes on 128.

n_shared counts a document's sample positions whose CORE bytes occur at another one: shorter repeats, which stay.
Null text counts as empty. Rows that are equal in doc_id and text are each other's copies. Rows with null doc_id take part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import binary, byte_batches, drop_shuffles, partitions, starts, stash, whole_groups

LENGTH = 400
#: A perfect difference cover modulo 183; each residue but 0 is the difference of two of them exactly once.
V = 183
COVER = (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)
CORE = LENGTH - V + 1
BUCKETS = 2
SIDE = V - 1
FLUSH, LOCAL, LARGE = 1 << 20, 1 << 12, 1 << 15
PAIRS = 64
CHUNK = 1 << 18
NULL_ID = -(1 << 63)
LOW = np.int64(0xFFFFFFFF)
KIND = np.int64(3)  # the low bits of a rank: 0 plain, 1 of a large class, 2 and 3 dealt anywhere (2: asks, 3: settled)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, powers of the two multipliers and of their inverses modulo 2^64."""
    n = CHUNK + 4 * LENGTH
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), np.uint64) | np.uint64(1)
    powers, inverse = np.empty((2, n), np.uint64), np.empty((2, n), np.uint64)
    for k in range(2):
        b = int(ODD[k])
        for out, x in ((powers, b), (inverse, pow(b, -1, 1 << 64))):
            out[k, 0] = 1
            out[k, 1:] = np.multiply.accumulate(np.full(n - 1, x, np.uint64))
    return codes, powers, inverse


class Prefix:
    """Digests of any substring of a chunk, by one or both polynomials."""

    def __init__(self, b: np.ndarray, kinds: int = 1):
        self.codes, self.powers, self.inverse = _tables()
        self.b, self.sums = b, []
        for k in range(kinds):
            out = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.codes[k][b] * self.powers[k, : len(b)], out=out[1:])
            self.sums.append(out)

    def digest(self, at: np.ndarray, size: int, k: int = 0) -> np.ndarray:
        out = (self.sums[k][at + size] - self.sums[k][at]) * self.inverse[k][at]
        return (out ^ (out >> np.uint64(31))).view(np.int64)


def chunks(text: bytes):
    """(start, end, bytes from `before` on, before): the places start..end of a chunk and the bytes around them."""
    for start in range(0, len(text), CHUNK):
        before = max(0, start - LENGTH)
        end = min(len(text), start + CHUNK)
        yield start, end, np.frombuffer(text, np.uint8, min(len(text), end + LENGTH) - before, before), before


def sample(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample places, their rank digests, and the digests around them (0 near the text's ends)."""
    places, ranks, around = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    residues = np.array(COVER)
    for start, end, b, before in chunks(text):
        at = (np.arange(start // V, end // V + 1)[:, None] * V + residues[None]).ravel()
        at = at[(at >= start) & (at < end) & (at + CORE <= len(text))]
        if not len(at):
            continue
        p = Prefix(b)
        places.append(at)
        ranks.append(p.digest(at - before, CORE))
        wide = np.zeros(len(at), np.int64)
        inner = (at - (V - 1) >= 0) & (at + LENGTH <= len(text))
        wide[inner] = p.digest(at[inner] - (V - 1) - before, LENGTH + V - 1)
        around.append(wide)
    return np.concatenate(places), np.concatenate(ranks), np.concatenate(around)


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi), lo sorted; those that touch are one."""
    if not len(lo):
        return lo, hi
    hi = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _result(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 with the bytes [lo, hi) removed."""
    digest, at = hashlib.sha256(), 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return len(text), int((hi - lo).sum()), len(lo), digest.hexdigest()


def in_classes(batches, most: int):
    """(columns, large) of a stream sorted by r: whole classes, or parts of one that has more than `most` rows."""
    rest, open_ = None, None
    for batch in batches:
        got = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            got, rest = {n: np.concatenate([rest[n], v]) for n, v in got.items()}, None
        c = got["r"] & ~KIND
        if open_ is not None and len(c):
            lead = int(np.searchsorted(c, open_, "right"))
            if lead:
                yield {n: v[:lead] for n, v in got.items()}, True
            if lead == len(c):
                continue
            got, c, open_ = {n: v[lead:] for n, v in got.items()}, c[lead:], None
        if not len(c):
            continue
        cut = int(np.searchsorted(c, c[-1]))
        if cut:
            yield {n: v[:cut] for n, v in got.items()}, False
        rest = {n: v[cut:] for n, v in got.items()}
        if len(c) - cut > most:
            yield rest, True
            rest, open_ = None, c[-1]
    if rest is not None:
        yield rest, False


def rank_classes(most: int):
    """Of rows sorted by (r, wa): the members of classes with more than one, without the rest.

    flag: 1 settled (the bytes around the place occur again), 2 asks (it goes to its bucket: an unsettled place, and, where a
    class has one, the first place of each settled digest, as the others equal it), 4 of a large class.
    """

    def run(batches):
        for got, large in in_classes(batches, most):
            r, wa = got.pop("r"), got.pop("wa")
            kind, r, w, at = r & KIND, r & ~KIND, wa >> 32, wa & LOW
            spread = kind > 1
            new = np.concatenate([[True], r[1:] != r[:-1]]) | np.concatenate([[False], spread[1:] != spread[:-1]]) | spread
            group = np.cumsum(new) - 1
            new_w = new | np.concatenate([[True], w[1:] != w[:-1]])
            group_w = np.cumsum(new_w) - 1
            settled = (np.bincount(group_w)[group_w] > 1) & (w != 0)
            much = (np.bincount(group, kind == 1) > 0)[group] | large | spread
            ask = ~settled | (new_w & ((np.bincount(group, ~settled) > 0)[group] | much))
            settled, ask = np.where(spread, kind == 3, settled), np.where(spread, kind == 2, ask)
            kept = (np.bincount(group)[group] > 1) | much
            flag = (settled + 2 * ask + 4 * much)[kept].astype(np.int8)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[kept]) for c in got.values()), pa.array(at[kept].astype(np.int32)), pa.array(flag)], [*got, "at", "flag"])

    return run


def packed(digest: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The upper half of a digest and a place, as one number."""
    return (digest & ~LOW) | at


def _batches(columns: dict, keys: dict, who: np.ndarray):
    """Record batches of numpy columns with the key columns of their documents."""
    who = pa.array(who)
    for s in range(0, len(who), 1 << 17):
        m = slice(s, s + (1 << 17))
        own = [c.take(who[m]) for c in keys.values()]
        yield pa.RecordBatch.from_arrays([*(pa.array(v[m]) for v in columns.values()), *own], [*columns, *keys])


def dealt(r: np.ndarray, wa: np.ndarray, local: int) -> np.ndarray:
    """Ranks with their kinds: of a class with more than `local` rows here only the first are compared with other tasks' rows."""
    r = r & ~KIND
    s = np.sort(r)
    hot = s[local:][s[local:] == s[:-local]]
    if not len(hot):
        return r
    mine = np.flatnonzero(np.isin(r, hot))
    mine = mine[np.lexsort((wa[mine], r[mine]))]
    c, w = r[mine], wa[mine] >> 32
    new = np.concatenate([[True], c[1:] != c[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(mine)) - first[np.cumsum(new) - 1]
    new_w = new | np.concatenate([[True], w[1:] != w[:-1]])
    again = ~new_w & (w != 0)  # the first of each digest asks
    r[mine] |= np.where(place < local, 1, np.where(again, 3, 2))
    return r


def _samples(local: int):
    """A row for each sample position."""

    def run(batches):
        held, size = [], 0

        def flush():
            r, wa, who = (np.concatenate(z) for z in list(zip(*held, strict=True))[:3])
            own = {n: pa.concat_arrays([h[3][n] for h in held]) for n in held[0][3]}
            return _batches({"r": dealt(r, wa, local), "wa": wa}, own, who)

        docs = 0
        for b in batches:
            keys = dict(zip(b.schema.names[:-1], b.columns, strict=False))
            got = [sample(t) for t in binary(b.columns[-1])]
            if not got:
                continue
            at, r, w = (np.concatenate(z) for z in zip(*got, strict=True))
            held.append((r, packed(w, at), np.repeat(np.arange(docs, docs + len(got)), [len(g[0]) for g in got]), keys))
            docs, size = docs + len(got), size + len(r)
            if size > FLUSH:
                yield from flush()
                held, size, docs = [], 0, 0
        if held:
            yield from flush()

    return run


@functools.cache
def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def ties(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bytes two matrices agree from the left, row by row."""
    apart = left != right
    return np.where(apart.any(1), apart.argmax(1), left.shape[1])


def bucket_ends(sides: np.ndarray, room: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a bucket, the most bytes before and after it that a repeated string around it has, or -1.

    sides: the bytes before and after, SIDE each; room: how many of both there are; at: the first row of each class, and the
    number of rows. Classes of up to PAIRS rows are compared in pairs; in others the suffixes of each distance are sorted, by
    digests of the bytes on both sides.
    """
    before, after = np.full((2, len(sides)), -1)
    size = np.diff(at)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for m in np.unique(size[(size > 1) & (size <= PAIRS)]).tolist():
        base, (i, j) = at[:-1][size == m][:, None], _triangle(m)
        pairs.append(((base + i).ravel(), (base + j).ravel()))
    first, second = (np.concatenate(x) for x in zip(*pairs, strict=True))
    for s in range(0, len(first), 1 << 13):
        p, q = first[s : s + (1 << 13)], second[s : s + (1 << 13)]
        n = np.minimum(room[p], room[q])
        a, b = sides[p], sides[q]
        x = np.minimum(ties(a[:, SIDE - 1 :: -1], b[:, SIDE - 1 :: -1]), n[:, 0])
        y = np.minimum(ties(a[:, SIDE:], b[:, SIDE:]), n[:, 1])
        ok = x + y >= SIDE
        for z in (p[ok], q[ok]):
            np.maximum.at(before, z, x[ok])
            np.maximum.at(after, z, y[ok])
    codes, powers, _ = _tables()
    for s, m in zip(at[:-1][size > PAIRS].tolist(), size[size > PAIRS].tolist(), strict=True):
        left = codes[0][sides[s : s + m, SIDE - 1 :: -1]] * powers[0, :SIDE]
        right = codes[1][sides[s : s + m, SIDE:]] * powers[1, :SIDE]
        left, right = (np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(x, axis=1)], 1) for x in (left, right))
        for j in range(SIDE + 1):
            fits = np.flatnonzero((room[s : s + m, 0] >= j) & (room[s : s + m, 1] >= SIDE - j))
            key = left[fits, j] + (right[fits, SIDE - j] * ODD[0])
            o = np.argsort(key)
            same = key[o[1:]] == key[o[:-1]]
            hit = s + fits[np.unique(np.concatenate([o[1:][same], o[:-1][same]]))]
            before[hit] = j  # distances grow
            after[hit] = np.maximum(after[hit], SIDE - j)
    return before, after


def compare(batches):
    """Of rows of buckets sorted by (r, r2): the runs lo..hi that are repeated."""
    for got in whole_groups(batches, ["r", "r2"]):
        at, place = starts(got, ["r", "r2"]), got.pop("place")
        sides = np.frombuffer(b"".join(got.pop("sides")), np.uint8).reshape(len(place), 2 * SIDE)
        room = np.stack([place >> 32 & 0xFF, place >> 40], 1)
        before, after = bucket_ends(sides, room, at)
        kept = before >= 0
        place = (place & LOW)[kept]
        own = {n: v[kept] for n, v in got.items() if n not in ("r", "r2")}
        yield pa.RecordBatch.from_arrays([*map(pa.array, own.values()), pa.array(place - before[kept]), pa.array(place + CORE + after[kept])], [*own, "lo", "hi"])


def _spans(at, flag, lo=(), hi=()) -> tuple[np.ndarray, np.ndarray]:
    """The removed runs: around settled places, and those found in buckets."""
    at, flag, lo, hi = (np.array(x if x is not None else [], np.int64) for x in (at, flag, lo, hi))
    settled = at[flag & 1 > 0]
    lo, hi = np.concatenate([settled - SIDE, lo]), np.concatenate([settled + LENGTH, hi])
    o = np.argsort(lo, kind="stable")
    return merge(lo[o], hi[o])


RESULT = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, n_shared long"


def _results(texts, cuts) -> list[pa.Array]:
    out = [_result(t, lo, hi) for t, (lo, hi) in zip(texts, cuts, strict=True)]
    n, gone, m, digest = zip(*out, strict=True) if out else ((), (), (), ())
    spans = [np.stack(c, 1).astype("<i8").tobytes() for c in cuts]
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(m, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.binary())]


def _settle(batches):
    """Documents whose ranks settle everything get their result; the others keep their text."""
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ats, flags = col["ats"].to_pylist(), col["flags"].to_pylist()
        asked = [any(x & 2 for x in f or ()) for f in flags]
        large = [any(x & 6 == 6 for x in f or ()) for f in flags]
        texts = binary(col["text"])
        done = _results([b"" if a else t for t, a in zip(texts, asked, strict=True)], [_spans([] if a else at, [] if a else f) for at, f, a in zip(ats, flags, asked, strict=True)])
        left = [pa.array([x if a else None for x, a in zip(z, asked, strict=True)], kind) for z, kind in ((texts, pa.binary()), (ats, pa.list_(pa.int32())), (flags, pa.list_(pa.int8())))]
        th = [n for n in col if n == "th"]
        shared = pa.array([len(x or ()) for x in ats], pa.int64())
        yield pa.RecordBatch.from_arrays([col["k"], *done, shared, *(col[n] for n in th), pa.array(asked), pa.array(large), *left], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared", *th, "asked", "large", "text", "ats", "flags"])


def _asked(b, flag: int):
    """(row, text, sorted places) of the documents with places whose low bits are flag."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    for i, (t, at, f) in enumerate(zip(col["text"].to_pylist(), col["ats"].to_pylist(), col["flags"].to_pylist(), strict=True)):
        at = np.sort(np.array(at, np.int64)[np.array(f, np.int8) & 6 == flag])
        if len(at):
            yield i, t, at


def _contexts(bucket: int):
    """The places of one part of the classes, with the bytes around them."""

    def out(held, keys):
        r, r2, place, sides, who = (np.concatenate(z) for z in zip(*held, strict=True))
        flat = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.arange(len(r) + 1) * 2 * SIDE).astype(np.int32)), pa.py_buffer(sides)])
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(r2), pa.array(place), flat, *(c.take(pa.array(who)) for c in keys.values())], ["r", "r2", "place", "sides", *keys])

    def run(batches):
        for b in batches:
            held, size = [], 0
            keys = {n: b.column(i) for i, n in enumerate(b.schema.names) if n in ("k", "th")}
            for i, t, at in _asked(b, 2):
                for start, end, data, before in chunks(t):
                    where = at[(at >= start) & (at < end)]
                    if not len(where):
                        continue
                    p = Prefix(data, 2)
                    r = p.digest(where - before, CORE) & ~KIND
                    mine = r % (4 * BUCKETS) == 4 * bucket
                    where, r = where[mine], r[mine]
                    r2 = p.digest(where - before, CORE, 1)
                    room = np.minimum(where, SIDE) << 32 | np.minimum(len(t) - where - CORE, SIDE) << 40
                    around = np.lib.stride_tricks.sliding_window_view(np.pad(data, SIDE), CORE + 2 * SIDE)
                    for s in range(0, len(where), 1 << 14):
                        cut = slice(s, s + (1 << 14))
                        rows = around[where[cut] - before]
                        held.append((r[cut], r2[cut], (where | room)[cut], np.concatenate([rows[:, :SIDE], rows[:, SIDE + CORE :]], 1), np.full(len(rows), i)))
                        size += len(rows)
                        if size > 1 << 14:
                            yield out(held, keys)
                            held, size = [], 0
            if size:
                yield out(held, keys)

    return run


def _windows(batches):
    """A row for each window over a place of a large class."""
    for b in batches:
        got = []
        for i, t, at in _asked(b, 6):
            lo, hi = merge(np.maximum(at - SIDE, 0), np.minimum(at, len(t) - LENGTH) + 1)
            lo, hi = lo[hi > lo], hi[hi > lo]
            for start, end, data, before in chunks(t) if len(lo) else ():
                a, z = np.clip(lo, start, end), np.clip(hi, start, end)
                size = z - a
                if size.sum():
                    where = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                    p = Prefix(data, 2)
                    got.append((p.digest(where - before, LENGTH), p.digest(where - before, LENGTH, 1), where, np.full(len(where), i)))
        if got:
            h0, h1, at, who = (np.concatenate(z) for z in zip(*got, strict=True))
            yield from _batches({"h0": h0, "h1": h1, "at": at}, {n: b.column(i) for i, n in enumerate(b.schema.names) if n in ("k", "th")}, who)


def _cut(batches):
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        cuts = [_spans(*x) for x in zip(*(col[c].to_pylist() for c in ("ats", "flags", "lo", "hi")), strict=True)]
        yield pa.RecordBatch.from_arrays([col["k"], *_results(binary(col["text"]), cuts), col["n_shared"]], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and spans (pairs of longs: start, end of each removed run)."""
    spark = docs.sparkSession
    byte_batches(spark)
    drop_shuffles(spark)
    n = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k")
    alone = not docs.select(k).groupBy("k").count().filter("count > 1").limit(1).count()
    ids = ["k"] if alone else ["k", "th"]  # rows with one doc_id are told apart by their texts
    own = ", ".join(f"{i} long" for i in ids)
    keyed = docs.select(k, F.xxhash64(text).alias("th"), text.alias("text")).select(*ids, "text")

    rows = keyed.mapInArrow(_samples(LOCAL), f"r long, wa long, {own}")
    anywhere = F.col("r").bitwiseAND(F.lit(3)) > 1
    rows = rows.repartition(n, F.when(anywhere, F.xxhash64("k", "wa")).otherwise(F.col("r").bitwiseAND(F.lit(-4)))).sortWithinPartitions("r", "wa")
    ranks = stash(rows.mapInArrow(rank_classes(LARGE), f"{own}, at int, flag tinyint"), "ranks")
    gather = F.collect_list if alone else F.collect_set
    members = ranks.groupBy(*ids).agg(gather(F.col("at").cast("long") * 8 + F.col("flag")).alias("x"))
    ats, flags = F.transform("x", lambda v: F.shiftright(v, 3).cast("int")), F.transform("x", lambda v: v.bitwiseAND(7).cast("tinyint"))
    members = members.select(*ids, ats.alias("ats"), flags.alias("flags"))
    schema = f"{RESULT}, {'' if alone else 'th long, '}asked boolean, large boolean, text binary, ats array<int>, flags array<tinyint>"
    all_ = stash(keyed.join(members, ids, "left").mapInArrow(_settle, schema), "settled")

    asked, found = all_.filter("asked").select(*ids, "text", "ats", "flags", "n_shared"), []
    for bucket in range(BUCKETS):
        rows = asked.mapInArrow(_contexts(bucket), f"r long, r2 long, place long, sides binary, {own}")
        rows = rows.repartition(n, "r").sortWithinPartitions("r", "r2")
        found.append(stash(rows.mapInArrow(compare, f"{own}, lo long, hi long"), "repeats"))
    if all_.filter("large").limit(1).count():
        windows = all_.filter("large").select(*ids, "text", "ats", "flags").mapInArrow(_windows, f"h0 long, h1 long, at long, {own}")
        again = windows.groupBy("h0", "h1").count().filter("count > 1").select("h0", "h1")
        found.append(windows.join(again, ["h0", "h1"], "left_semi").select(*ids, F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi")))
    more = functools.reduce(DataFrame.unionByName, found).groupBy(*ids).agg(F.collect_set(F.struct("lo", "hi")).alias("more"))
    rest = asked.join(more, ids, "left").select("k", "text", "ats", "flags", "more.lo", "more.hi", "n_shared").mapInArrow(_cut, RESULT)
    out = all_.filter("not asked").select(*rest.columns).unionByName(rest)
    return out.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans")

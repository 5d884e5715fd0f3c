"""Byte-level BPE encoding and decoding with a two-tier lookup (operator 10).

First tier: a minimal perfect hash (hash and displace) over the vocabulary's byte strings; a pre-token that is itself in
the vocabulary is one id. Second tier: other pre-tokens are merged by rank with a heap over a linked list of their bytes,
each adjacent pair looked up in the same hash; n bytes take O(n log n).
A batch of texts is cut where a pre-token always ends: before a space or line feed that follows a character other than white
space, and between a letter and an ASCII character that is no letter. Each distinct piece of a batch is looked up once, and
the ids of short pieces are remembered by a task in tables of at most LATELY entries: a full one becomes the older one, from
which what is still met moves on, and the rest goes. They go with the task, as workers outlive it.

Null text counts as empty: no ids. Any columns may be kept beside; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_batches

MEMO, SHORT = 600_000, 48
LATELY = 1 << 17  # pieces, and hash results, in each of the two tables of a task
BATCH = 1 << 21  # bytes of text: arrays of about ten times as much go with a batch
MASK = (1 << 64) - 1
C1, C2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


LETTER, BLANK, SOLID = np.zeros((3, 256), bool)  # by byte: ASCII letters; space and line feed; ASCII that is no white space
LETTER[[*range(65, 91), *range(97, 123)]] = True
BLANK[[10, 32]] = True
SOLID[33:128] = True
BLOCK = 1 << 16  # bytes or runs worked on at a time


def cuts(data: np.ndarray) -> np.ndarray:
    """True at the bytes of UTF-8 text where a piece begins, a block at a time.

    Beyond ASCII only U+00C0 to U+00FF count as letters (less the two signs among them), and only U+00C0 to U+07FF and
    U+4000 upwards as surely no white space: fewer cuts elsewhere.
    """
    out = np.zeros(len(data), bool)
    for at in range(0, len(data), BLOCK):
        x = data[max(at - 3, 0) : at + BLOCK]
        letter, solid = LETTER[x], SOLID[x]
        plain = (x < 128) & ~letter
        letter[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)
        solid[1:] |= (x[:-1] >= 0xC3) & (x[:-1] <= 0xDF)
        solid[2:] |= x[:-2] >= 0xE4
        begin = np.zeros(len(x), bool)
        begin[1:] = (letter[:-1] & plain[1:]) | (solid[:-1] & BLANK[x[1:]])
        out[at : at + BLOCK] = begin[min(at, 3) :]
    return out


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the runs `index` of flat (run i has size[i] elements); also where each ends. A block of runs at a time."""
    begin = np.cumsum(size) - size
    ends = np.cumsum(size[index])
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for i in range(0, len(index), BLOCK):
        part = index[i : i + BLOCK]
        n, to = size[part], int(ends[i] - size[index[i]])
        shift = begin[part] - (ends[i : i + BLOCK] - n - to)
        out[to : to + int(n.sum())] = flat[np.repeat(shift, n) + np.arange(int(n.sum()))]
    return out, ends


def binaries(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:  # noqa: B008
    """data, cut at bounds (from 0, in elements), as Arrow binary values (or of another kind)."""
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def encode_column(column: pa.Array, lookup, atoms: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts without nulls, and the bounds of each text's ids. lookup gives the ids (bytes) of distinct
    pieces. A text that holds one of the strings atoms is one piece."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    if at[0] == at[-1]:
        return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    begin = cuts(data)
    for atom in map(str.encode, atoms):
        raw, found = data.tobytes(), 0
        while (found := raw.find(atom, found)) >= 0:
            i = int(np.searchsorted(at, found, "right"))
            begin[at[i - 1] : at[i]] = False
            found = int(at[i])
    begin[at[:-1][np.diff(at) > 0]] = True
    first = np.append(np.flatnonzero(begin), len(data))
    found = binaries(data, first, pa.string()).dictionary_encode()
    ids = lookup(found.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    out, ends = gather(np.frombuffer(b"".join(ids), "<u4"), size, found.indices.to_numpy())
    return out, np.append(0, ends)[np.searchsorted(first, at)]


class PerfectHash:
    """Minimal perfect hash of n byte strings to 0..n-1, by displacements of buckets; lookups compare the string."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(len(keys), 1)
        self.buckets = max(1, n // 4)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((h % np.uint64(self.buckets)).tolist()):
            members[b].append(i)
        taken, self.slots, self.shift = np.zeros(n, bool), [-1] * n, [0] * self.buckets
        tries = np.arange(1, 257, dtype=np.uint64)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            mine = members[b]
            if not mine:
                break
            if len(mine) == 1:  # the free places that are left, one by one
                free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
                at = next(free)
                self.shift[b], self.slots[at] = -at - 1, mine[0]
                continue
            base = np.uint64(0)
            while True:
                d = tries + base
                x = (h[mine][:, None] ^ (d * np.uint64(C1))[None]) * np.uint64(C2)
                at = ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(0)
                good &= (np.diff(np.sort(at, 0), axis=0) > 0).all(0)
                if good.any():
                    t = int(np.argmax(good))
                    break
                base += np.uint64(256)
            self.shift[b] = int(d[t])
            taken[at[:, t]] = True
            for i, s in zip(mine, at[:, t].tolist(), strict=True):
                self.slots[s] = i
        self.keys = [keys[i] if i >= 0 else None for i in self.slots]

    def find(self, key: bytes) -> int:
        """The key's number in the list it was built from, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        at = -d - 1 if d < 0 else ((((h ^ (d * C1 & MASK)) * C2 & MASK) >> 32) % self.n)
        return self.slots[at] if self.keys[at] == key else -1


class Lately(dict):
    """What was met lately: at most LATELY entries, and as many older ones."""

    def __init__(self):
        super().__init__()
        self.older = {}

    def __missing__(self, key):
        """None, or the older entry, which is now a late one."""
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value

    def __setitem__(self, key, value):
        if len(self) >= LATELY:
            self.older = dict(self)
            self.clear()
        super().__setitem__(key, value)


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        rows = [line.split() for line in Path(ranks_path).read_bytes().splitlines() if line]
        tokens = [(base64.b64decode(t), int(r)) for t, r in rows]
        self.hash, self.ranks = PerfectHash([t for t, _ in tokens]), [r for _, r in tokens]
        self.tokens = [b""] * (max(self.ranks, default=-1) + 1)
        for t, r in tokens:
            self.tokens[r] = t
        self.flat, self.size = np.frombuffer(b"".join(self.tokens), np.uint8), np.array([len(t) for t in self.tokens], np.int64)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.memo, self.seen = Lately(), Lately()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "seen")} | {"pattern": self.pattern.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state | {"pattern": regex.compile(state["pattern"])})
        self.forget()

    def rank(self, token: bytes) -> int:
        r = self.seen[token]
        if r is None:
            i = self.hash.find(token)
            r = self.ranks[i] if i >= 0 else -1
            if len(token) <= SHORT:
                self.seen[token] = r
        return r

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary."""
        n, rank = len(token), self.rank
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []
        for i in range(n - 1):
            r = rank(token[i : i + 2])
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank(token[i : end[k]])
                if r >= 0:
                    heapq.heappush(heap, (r, i, end[k]))
            p = left[i]
            if p >= 0:
                r = rank(token[p:stop])
                if r >= 0:
                    heapq.heappush(heap, (r, p, stop))
        return [rank(token[i : end[i]]) for i in range(n) if alive[i]]

    def piece(self, text: str) -> bytes:
        out = []
        for m in self.pattern.findall(text):
            token = m.encode()
            r = self.rank(token)
            out.extend([r] if r >= 0 else self.merge(token))
        return np.array(out, "<u4").tobytes()

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for p in pieces:
            ids = memo[p]
            if ids is None:
                ids = self.piece(p)
                if len(p) <= SHORT:
                    memo[p] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        return encode_column(pa.array([text]), self.lookup)[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_column(self, column: pa.Array) -> pa.Array:
        """The bytes of a column of ids without nulls."""
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int32)
        ids = np.frombuffer(column.buffers()[2] or b"", "<u4")[at[0] : at[-1]]
        out, ends = gather(self.flat, self.size, ids)
        return binaries(out, np.append(0, ends)[at - at[0]])


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_tokens and ids (binary, little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession
    byte_batches(spark, BATCH)
    codec = spark.sparkContext.broadcast(Codec(ranks_path, pattern))  # the vocabulary: of fixed size

    def run(batches):
        c = codec.value
        for b in batches:
            ids, bounds = encode_column(b.column(0), c.lookup)
            cols = [*b.columns[1:], pa.array(np.diff(bounds)), binaries(ids, bounds)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[1:], "n_tokens", "ids"])
        c.forget()

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *(F.col(f"`{k}`") for k in keep))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded and a column decoded (binary, UTF-8 bytes)."""
    spark = encoded.sparkSession
    byte_batches(spark, BATCH)
    codec, at = spark.sparkContext.broadcast(Codec(ranks_path, pattern)), encoded.columns.index("ids")

    def run(batches):
        c = codec.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, c.decode_column(b.column(at))], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, ("decoded", "binary")]))

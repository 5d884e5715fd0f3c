"""Token ids in grammar-compressed files (operator 3).

Documents are encoded with the tokenizers library, each closed with id 0, ordered by doc_id and written as shards of about
SHARD ids. A shard is compressed by Re-Pair: in rounds, all pairs that occur LEAST times or more within documents are
replaced by nonterminals, the most frequent first where two overlap, until no rule would be used USES times; the pairs of a
round may join nonterminals of earlier ones. Counts are exact. A shard row holds its terminals, the rules, the expansion
length of each rule, the symbols, and the documents' places, so that any range of ids is decoded without the rest
(`read_range`). The files are Parquet, written and read by Spark in the shared folder.

A batch's texts are cut where a pre-token always ends, and the library encodes each distinct piece once. A piece that is one
pre-token by the pattern (Latin letters, with a space before) skips the library's pattern matching, not its merges. A text
that holds the string of an added token is one piece, so that the library finds the token in it.

Null text counts as empty: only the end id. Rows with null doc_id come first; equal doc_ids follow by their ids. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.llm.bpe import MEMO, SHORT, binaries, encode_column
from veriframe.llm.common import byte_batches, drop_shuffles, partitions, shared_dir

SHARD = 1 << 21
BROADCAST = 1_000_000  # rows of three numbers, one for each shard
LEAST, USES = 16, 8  # a rule takes 12 bytes, and each use saves 2
BINS = 18
END = 1 << 19  # stands for the end id within a shard, so that no pair crosses documents
FORMAT = "part int, seq int, n_ids long, doc_ids binary, n_tokens binary, symbols_per_doc binary, terminals binary, rules binary, expansion binary, symbols binary"

WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+")  # one pre-token
PLAIN = re.compile(r"[ ]?\S+")


class Encoder:
    """The library's ids of a text, those of short pieces remembered in a table of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.memo = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\t", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.atoms = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tab = self.tokenizer.encode("\t", add_special_tokens=False).ids

    def many(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, units: list[str], tokenizer) -> None:
        """Encodes many as one text: they hold no tab, and a tab between two is a token of its own."""
        for i in range(0, len(units), 4096):
            part = units[i : i + 4096]
            ids = self.many(["\t".join(part)], tokenizer)[0]
            cut = np.flatnonzero(ids == self.tab[0])
            raw = ids.tobytes()
            begin, end = np.append(0, 4 * cut + 4).tolist(), np.append(4 * cut, len(raw)).tolist()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, begin, end)), strict=True))

    def new(self, units: list[str]) -> None:
        word, plain, rest = [], [], []
        for p in units:
            if WORD.fullmatch(p):
                word.append(p)
            elif PLAIN.fullmatch(p) and not any(a in p for a in self.atoms):
                plain.append(p)
            else:
                rest.append(p)
        if len(self.tab) != 1:
            word, plain, rest = [], [], units
        self.joined(word, self.words)
        self.joined(plain, self.tokenizer)
        self.memo.update(zip(rest, (x.tobytes() for x in self.many(rest)), strict=True))

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.memo) > MEMO:
            self.memo = {p: self.memo[p] for p in pieces if p in self.memo}
        new = [p for p in pieces if p not in self.memo]
        self.new(new)
        ids = list(map(self.memo.__getitem__, pieces))
        for p in new:
            if len(p) > SHORT:
                del self.memo[p]
        return ids


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for a worker, kept from task to task."""
    return Encoder(path)


def _find(pairs: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are among the sorted pairs, and as which: by a table of hashes, and by search where two pairs share one."""
    mix, shift = (np.uint32(0x9E3779B1), np.uint32(32 - BINS)) if code.dtype == np.uint32 else (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BINS))
    slot, shared = np.full(1 << BINS, -1, np.int32), np.zeros(1 << BINS, bool)
    h = (pairs * mix >> shift).astype(np.int32)
    slot[h] = np.arange(len(pairs), dtype=np.int32)
    shared[h[slot[h] != np.arange(len(pairs))]] = True
    h = (code * mix >> shift).astype(np.int32)
    which = slot[h]
    at = np.flatnonzero(which >= 0)
    which = which[at]
    hit = pairs[which] == code[at]
    if shared.any():
        more = np.flatnonzero(~hit & shared[h[at]])
        found = np.minimum(np.searchsorted(pairs, code[at[more]]), len(pairs) - 1)
        which[more], hit[more] = found, pairs[found] == code[at[more]]
    return at[hit], which[hit]


def repair(seq: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs; rule i is nonterminal end + 1 + i) and the symbols left; terminals are below end, which is in no pair.

    Only pairs that hold a nonterminal of the round before, or were frequent then, can be frequent: the rest is not counted
    again.
    """
    rules, size = [], 0
    seq = seq.astype(np.int32)
    at = np.arange(len(seq) - 1)
    while True:
        x, y = seq[at], seq[at + 1]
        kind, half = (np.uint32, np.uint32(16)) if end + size < 1 << 16 else (np.uint64, np.uint64(32))
        code = x.astype(kind) << half | y.astype(kind)
        if len(code):
            inner = (x != end) & (y != end)
            at, code = at[inner], code[inner]
        s = np.sort(code)
        first = np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)) if len(s) else np.zeros(1, np.int64)
        count = np.diff(first)
        pairs, count = s[first[:-1][count >= LEAST]], count[count >= LEAST]
        if not len(pairs):
            break
        found, which = _find(pairs, code)
        at = at[found]
        rank = np.empty(len(pairs), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pairs) + 1)
        mine = rank[which]
        pr = np.zeros(len(seq) + 1, np.int32)  # pr[i + 1] is that of the pair at i: the more frequent, the higher
        pr[at + 1] = mine
        top = (mine >= pr[at + 2]) & (mine >= pr[at])
        same = np.flatnonzero(top & (mine == pr[at]))  # of one pair at each place, x x x x: every other is taken
        if len(same):
            run = np.concatenate([[True], np.diff(same) > 1])
            top[same] = (np.arange(len(same)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
        uses = np.bincount(which[top], minlength=len(pairs))
        chosen = uses >= USES
        if not chosen.any():
            break
        taken = np.flatnonzero(top & chosen[which])
        number = np.cumsum(chosen) - 1
        new = end + 1 + size
        seq[at[taken]] = new + number[which[taken]]
        rules.append(np.stack([pairs[chosen] >> half, pairs[chosen] & kind((1 << int(half)) - 1)], 1).astype(np.int32))
        size += int(chosen.sum())
        stays = np.ones(len(seq), bool)
        stays[at[taken] + 1] = False
        again = pr[1:][stays] > 0
        seq = seq[stays]
        made = np.flatnonzero(seq >= new)
        again[made] = True
        again[made[made > 0] - 1] = True
        at = np.flatnonzero(again[:-1])
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int32), seq


def lengths(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Expansion length and depth of each rule; nonterminals are numbered from first on."""
    size, depth = [], []
    for x, y in rules.tolist():
        a, b = x - first, y - first
        size.append((size[a] if a >= 0 else 1) + (size[b] if b >= 0 else 1))
        depth.append(1 + max(depth[a] if a >= 0 else 0, depth[b] if b >= 0 else 0))
    return np.array(size, np.int32), np.array(depth, np.int32)


def _join(flat: np.ndarray, begin: np.ndarray, expansion: np.ndarray, symbols: np.ndarray, first: int) -> np.ndarray:
    """The terminals of symbols; those of rule i are at begin[i] of flat."""
    big = np.flatnonzero(symbols >= first)
    rule = symbols[big] - first
    size, source = np.ones(len(symbols), np.int64), np.arange(len(symbols)) + len(flat)
    size[big], source[big] = expansion[rule], begin[rule]
    source -= np.cumsum(size) - size
    place = np.repeat(source, size)
    place += np.arange(len(place))
    return np.concatenate([flat, symbols.astype(np.uint32)])[place]


def expand(symbols: np.ndarray, terminals: np.ndarray, rules: np.ndarray, expansion: np.ndarray) -> np.ndarray:
    """The ids of some symbols, as unsigned 32-bit integers."""
    first = len(terminals) + 1
    begin = np.concatenate([[0], np.cumsum(expansion)]).astype(np.int64)
    flat = np.empty(int(begin[-1]), np.uint32)
    depth = lengths(rules, first)[1]
    for d in range(1, int(depth.max(initial=0)) + 1):
        mine = np.flatnonzero(depth == d)
        size = expansion[mine].astype(np.int64)
        at = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        flat[at] = _join(flat, begin, expansion, rules[mine].ravel(), first)
    return np.append(terminals, 0).astype(np.uint32)[_join(flat, begin, expansion, symbols, first)]


def pack(symbols: np.ndarray) -> bytes:
    """The width in bytes and the symbols: two bytes are enough if all of them fit."""
    width = 2 if symbols.max(initial=0) <= 0xFFFF else 4
    return struct.pack("<B", width) + symbols.astype(f"<u{width}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def shard_row(part: int, seq: int, ids: list[int | None], docs: list[bytes], kind: str = "<u4") -> dict:
    end = np.array([END], np.int32)
    text = np.concatenate([x for d in docs for x in (np.frombuffer(d, kind).astype(np.int32), end)])
    width = np.dtype(kind).itemsize
    used = np.zeros(END + 1, bool)
    used[text] = True
    used[END] = True
    terminals = np.flatnonzero(used[:END])
    rules, symbols = repair((np.cumsum(used) - 1).astype(np.int32)[text], len(terminals))
    ends = np.flatnonzero(symbols == len(terminals))
    return {
        "part": part, "seq": seq, "n_ids": len(text), "doc_ids": pa.array(ids, pa.int64()).fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes(),
        "n_tokens": np.array([len(d) // width + 1 for d in docs], "<i4").tobytes(), "symbols_per_doc": np.diff(ends, prepend=-1).astype("<i4").tobytes(),
        "terminals": terminals.astype("<i4").tobytes(), "rules": rules.astype("<i4").tobytes(), "expansion": lengths(rules, len(terminals) + 1)[0].astype("<i4").tobytes(), "symbols": pack(symbols),
    }


def parts(row: dict) -> tuple[np.ndarray, ...]:
    """doc_ids, n_tokens, symbols_per_doc, terminals, rules, expansion, symbols of a shard row."""
    kinds = {"doc_ids": "<i8", "n_tokens": "<i4", "symbols_per_doc": "<i4", "terminals": "<i4", "rules": "<i4", "expansion": "<i4"}
    out = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
    return out["doc_ids"], out["n_tokens"], out["symbols_per_doc"], out["terminals"], out["rules"].reshape(-1, 2), out["expansion"], unpack(row["symbols"])


def read_range(row: dict, start: int, stop: int) -> np.ndarray:
    """The ids start to stop (exclusive) of a shard, expanding only the symbols that cover them."""
    _, _, _, terminals, rules, expansion, symbols = parts(row)
    first, size = len(terminals) + 1, np.ones(len(symbols), np.int64)
    size[symbols >= first] = expansion[symbols[symbols >= first] - first]
    to = np.cumsum(size)
    i, j = np.searchsorted(to, start, "right"), np.searchsorted(to, stop, "left") + 1
    begin = int(to[i] - size[i]) if i < len(to) else 0
    return expand(symbols[i:j], terminals, rules, expansion)[start - begin : stop - begin]


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encodes docs and writes the shards to path. Range bounds come from doc_id alone, so texts are encoded once."""
    spark = docs.sparkSession
    byte_batches(spark, 1 << 23)
    drop_shuffles(spark)
    kind = "<u2" if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"  # of ids in the shuffle
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000)).first()[0] if n > 1 else []
    bounds = np.array(bounds if bounds else [], np.int64)

    def encode(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            ids, cut = encode_column(b.column(1), enc.lookup, enc.atoms)
            at = np.searchsorted(bounds, b.column(0).fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), binaries(ids.astype(kind), cut)], ["part", "doc_id", "ids"])

    def shards(batches):
        part, seq, ids, docs, size, width = None, 0, [], [], 0, np.dtype(kind).itemsize

        def out():
            return pa.RecordBatch.from_pylist([shard_row(part, seq, ids, docs, kind)], schema=SCHEMA)

        for b in batches:
            for p, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if docs and (p != part or size >= SHARD):
                    yield out()
                    ids, docs, size, seq = [], [], 0, seq + 1 if p == part else 0
                part = p
                ids.append(i)
                docs.append(x)
                size += len(x) // width + 1
        if docs:
            yield out()

    encoded = rows.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    dealt.mapInArrow(shards, FORMAT).write.parquet(path)


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "n_tokens", "symbols_per_doc", "terminals", "rules", "expansion", "symbols"))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids (binary). Only shard totals pass one window."""
    files = spark.read.schema(FORMAT).parquet(path)

    def documents(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, n, _, terminals, rules, expansion, symbols = parts(row)
                flat = expand(symbols, terminals, rules, expansion).astype("<u4", copy=False)
                to = np.cumsum(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == -(1 << 63)), pa.array(row["base"] + to - n), pa.array(n.astype(np.int64)), binaries(flat, np.append(0, to))], ["doc_id", "start", "n_tokens", "ids"])

    byte_batches(spark, 1 << 22)  # a shard or two
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SHARD ids
    base = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if files.count() <= BROADCAST:  # from the footers; beyond that the join shuffles
        base = F.broadcast(base)
    return files.join(base, ["part", "seq"]).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs, reads the files back and gives doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


"""SimHash near-duplicates with pigeonring filtering (operator 5).

Fingerprints of 64 bits lie on a ring of four segments of 16 bits. If two differ in at most 2 bits, then from some segment
on, every chain of 1, 2, 3 segments has at most 0.5, 1, 1.5 differing bits (its share of the budget). The first is thus
equal, and of the next two at least one is; so equality of two segments (six tables of 32-bit keys) finds all candidates,
the chain conditions prune them, and the full Hamming distance decides. Equal fingerprints are one node throughout.

A key with more than CAP distinct fingerprints (one hot group) is dealt anew by two of the four bytes that are left: such a
group leaves 16 bits open, so it has at most 65,536 members, and is linked through common neighbours at one bit instead of
pairs. Nothing is dropped. A task emits a spanning forest of each group's links, never all its pairs.

With a similarity asked for (the pipeline's stage), links are pairs whose sets of shingles have at least that Jaccard
similarity. Candidates are first those within BITS, by fingerprints and chains as above, and their sets are compared. At 0.8
fingerprints differ in about 10 bits, with a wide spread, so that no budget of bits finds all such pairs; the check of what
these components leave apart goes by the sets, without misses. In any one order of the shingles, two such sets share one of their
first n - ceil(similarity * n) + 1; shingles common in a sample come last in the order, so that few documents share one.
Each key's documents are first compared with one of them (the same for keys with the same documents), then, as long as they
lie in different components, with one that each key draws by itself, which brings a large group many meeting points at the
cost of its keys; and after ROUNDS of that those still outside a group's largest component with all of it, by size class and
sketch, in blocks of BLOCK rows, so that no task holds a group. A sketch holds the parities of as many buckets as there are shingles (SKETCH at least); they differ in at most as many places as two sets do, which rules out most pairs. For
the rest the text of one comes to the other's, at most GROUP to a copy of it, and the sets are made again and compared.

Null or blank texts have fingerprint zero and link like any other; a row with null doc_id takes part, and component_id is
the smallest non-null doc_id reached. Repeated rows give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import Forest, binary, drop_shuffles, packed, partitions, small_batches, stars, starts, stash, whole_groups

BITS = 2
CAP = 256
PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]
SEED = 42
SAMPLE, COMMON = 5_000, 500_000  # documents sampled and shingles listed for the order; they decide no result
ROUNDS, SKETCH, GROUP = 3, 1024, 256
SMALL, BLOCK = 16, 1024
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n, digest = len(words) - size + 1, xxhash.xxh64_intdigest

    def blocks():
        for at in range(0, n, 1 << 14):
            m = min(1 << 14, n - at)
            yield np.fromiter((digest(g, SEED) for _, g in zip(range(m), grams, strict=False)), np.uint64, m)

    return majority(blocks())


def majority(blocks) -> int:
    """The bits set in over half of the hashes, which come in blocks, as a signed long; zero if there are none."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in binary(b.column(2))], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _chain(x: np.ndarray, first: int) -> np.ndarray:
    """Whether the chain from a segment on stays within its budget: x are the differing bits."""
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
    for step in range(1, 5):
        seg = np.uint64(16 * ((first + step - 1) % 4))
        total = total + _popcount((x >> seg) & np.uint64(0xFFFF))
        ok &= total * 4 <= BITS * step
    return ok


def _near(x: np.ndarray, tab: int) -> np.ndarray:
    i, j = PAIRS[tab]
    kept = _chain(x, i)
    if (j - i) % 4 == 2:
        kept |= _chain(x, j)
    kept[kept] = _popcount(x[kept]) <= BITS
    return kept


def link_groups(batches):
    """A spanning forest of the links in each group of equal (k, sub)."""
    keys = ["k", "sub"]
    for got in whole_groups(batches, keys):
        fp, at = got["fp"].view(np.uint64), starts(got, keys)
        a, b = [], []
        size = np.diff(at)
        two = at[:-1][size == 2]
        tabs = (got["k"] >> 32).astype(np.int64)
        for tab in range(6):
            i = two[tabs[two] == tab]
            i = i[_near(fp[i] ^ fp[i + 1], tab)]
            a.append(fp[i])
            b.append(fp[i + 1])
        for s, m in zip(at[:-1][size > 2], size[size > 2], strict=True):
            x, tab, forest = fp[s : s + m], int(tabs[s]), Forest(int(m))
            if m <= 2048:
                i, j = np.triu_indices(int(m), 1)
                ok = _near(x[i] ^ x[j], tab)
                for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                    forest.join(p, q)
            else:  # two within 2 bits have a common neighbour at 1 bit or less, and the converse
                spread = int(np.bitwise_or.reduce(x ^ x[0]))
                flips = np.array([0, *(1 << t for t in range(64) if spread >> t & 1)], np.uint64)
                hub, who = (x[:, None] ^ flips[None]).ravel(), np.repeat(np.arange(m), len(flips))
                o = np.argsort(hub, kind="stable")
                hub, who = hub[o], who[o]
                same = hub[1:] == hub[:-1]
                for p, q in zip(who[:-1][same].tolist(), who[1:][same].tolist(), strict=True):
                    forest.join(p, q)
            up = np.array([forest.root(t) for t in range(int(m))])
            moved = np.flatnonzero(up != np.arange(m))
            a.append(x[moved])
            b.append(x[up[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])


def _segment(i: int, width: int = 16):
    return F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)


def links(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all within 2 bits of each other."""
    spark = reps.sparkSession
    tables = [F.lit(t << 32).bitwiseOR(F.shiftleft(_segment(i), 16)).bitwiseOR(_segment(j)) for t, (i, j) in enumerate(PAIRS)]
    keyed = reps.select("fp", F.explode(F.array(*tables)).alias("k"))
    hot = keyed.groupBy("k").count().filter(F.col("count") > CAP).select("k", F.lit(True).alias("hot"))
    keyed = keyed.join(hot, "k", "left")
    bytes_left = []
    for i, j in PAIRS:
        rest = [s for s in range(4) if s not in (i, j)]
        four = [_segment(2 * s + h, 8) for s in rest for h in (0, 1)]
        bytes_left.append(F.array(*(F.lit(u << 16).bitwiseOR(F.shiftleft(four[p], 8)).bitwiseOR(four[q]) for u, (p, q) in enumerate(PAIRS))))
    subs = F.element_at(F.array(*bytes_left), (F.shiftright("k", 32) + 1).cast("int"))
    keyed = keyed.select("fp", "k", F.explode(F.when(F.col("hot"), subs).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))
    dealt = keyed.repartition(partitions(spark), "k", "sub").sortWithinPartitions("k", "sub", "fp")
    return dealt.mapInArrow(link_groups, "a long, b long")


def _roots(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints; of each distinct one its least doc_id (rep) and its component's least fingerprint (root)."""
    fps = stash(fingerprints(docs, shingle), "simhash")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = stars(links(reps.select("fp")))
    return fps, reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    fps, reps = _roots(docs, shingle)
    low = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = reps.join(low, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(words) - size + 1)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several sampled documents have, and in how many."""
    parts = max(1, docs.count() // SAMPLE)

    def run(batches):
        for b in batches:
            h, n = np.unique(np.concatenate([shingle_set(x, shingle) for x in binary(b.column(0))] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    text = F.col("text").cast("string")
    some = docs.filter(F.pmod(F.xxhash64("doc_id", text), F.lit(parts)) == 0).select(text.alias("text"))
    got = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n")).limit(COMMON).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    o = np.argsort(h)
    return h[o], n[o]


def _lists(some: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *some])))


def shingle_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, th, fp (digest of the set), sim (fingerprint), n (the set's size), keys (its first shingles in the common order)
    and sketch of each row."""
    small_batches(docs.sparkSession)
    hold = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches):
        known, often = hold.value
        for b in batches:
            sizes, keys, fp, sim, sketch = [], [], [], [], []
            for x in binary(b.column(2)):
                h = shingle_hashes(x, shingle)
                sim.append(majority(h[at : at + (1 << 14)] for at in range(0, len(h), 1 << 14)))
                h = np.unique(h)
                first = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                order = h
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    order = h[np.argsort(np.where(known[at] == h, often[at], 0), kind="stable")]
                sizes.append(len(h))
                keys.append(order[:first].view(np.int64))
                fp.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                width = max(SKETCH, 1 << max(len(h) - 1, 0).bit_length())  # at least as many as there are shingles
                odd = np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width) & 1
                sketch.append(np.packbits(odd.astype(bool)).view(np.int64))
            cols = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(sim, np.int64)), pa.array(np.array(sizes, np.int64)), _lists(keys), _lists(sketch)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "th", "fp", "sim", "n", "keys", "sketch"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long, sim long, n long, keys array<long>, sketch array<long>")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of sets (fp, n) that connect all whose fingerprints (sim) are within BITS; no other components."""
    sets = sets.groupBy("fp").agg(F.min("sim").alias("sim"), F.min("n").alias("n"))
    hubs = stash(sets.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("hub")), "hubs")
    equal = sets.join(hubs, "sim").filter("fp <> hub.fp").select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("hub.fp").alias("b"), F.col("hub.n").alias("nb"))
    near = links(hubs.select(F.col("sim").alias("fp")))
    near = near.join(hubs.toDF("a", "one"), "a").join(hubs.toDF("b", "two"), "b")
    return equal.unionByName(near.select(F.col("one.fp").alias("a"), F.col("one.n").alias("na"), F.col("two.fp").alias("b"), F.col("two.n").alias("nb")))


def _repeated(batches):
    """Rows of a sorted stream whose h also has other rows; of the batch before only the last row is held."""
    last, shared = None, False  # the row held, and whether the one before it has the same h
    for b in batches:
        if not b.num_rows:
            continue
        got = np.array([b.column(i).to_numpy() for i in range(3)])
        if last is not None:
            got = np.concatenate([last, got], axis=1)
        same = got[0, 1:] == got[0, :-1]
        kept = np.append(shared, same) | np.append(same, False)
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][kept[:-1]]) for x in got], ["h", "fp", "n"])
        last, shared = got[:, -1:], bool(kept[-1])
    if shared:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["h", "fp", "n"])


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of half as many buckets is the sum of both halves."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def apart(sketch: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the sketches of pairs differ, both with the lesser one's number of buckets."""
    size = np.array([len(x) for x in sketch])
    least, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for n in np.unique(least):
        at = np.flatnonzero(least == n)
        rows = np.unique(np.concatenate([i[at], j[at]]))
        x = np.stack([fold(sketch[r], n) for r in rows]).view(np.uint64)
        a, b = np.searchsorted(rows, i[at]), np.searchsorted(rows, j[at])
        step = max(1, (1 << 20) // int(n))
        for d in range(0, len(at), step):
            out[at[d : d + step]] = np.bitwise_count(x[a[d : d + step]] ^ x[b[d : d + step]]).sum(1)
    return out


def _blocks(open_: DataFrame) -> DataFrame:
    """Work items (h, size, p, q) of the groups (h, size), with about BLOCK rows of a role each.

    Rows outside a group's largest component (few) are compared with all of the group. Both are dealt to blocks, and item
    (p, q) holds block p of the few (first) and block q of all (second). A group of one component needs no comparison.
    """
    counts = open_.groupBy("h", "size", "root").agg(F.count("*").alias("m"))
    groups = counts.groupBy("h", "size").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("top")).filter(F.col("all") > F.col("top.m"))
    groups = groups.select("h", "size", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("np"), F.ceil(F.col("all") / BLOCK).alias("nq"))
    rows = open_.join(groups, ["h", "size"]).withColumn("few", F.col("root") != F.col("top"))
    rows = rows.withColumns({k: F.pmod(F.xxhash64("fp"), F.col(n)) for k, n in (("p", "np"), ("q", "nq"))})

    def item(p, q, first, second):
        return F.struct(p.alias("p"), q.alias("q"), first.alias("first"), second.alias("second"))

    def upto(n):
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    second = F.transform(upto("np"), lambda p: item(p, F.col("q"), F.col("few") & (p == F.col("p")), F.lit(True)))
    first = F.transform(F.filter(upto("nq"), lambda q: F.col("few") & (q != F.col("q"))), lambda q: item(F.col("p"), q, F.lit(True), F.lit(False)))
    return rows.select("h", "size", "fp", "n", "root", "own", "few", F.explode(F.concat(second, first)).alias("at")).select("h", "size", "fp", "n", "root", "own", "few", "at.*")


def _close(similarity: float):
    """The pairs of an item (h, size, p, q), of different components, that sizes and sketches leave; no other pair is emitted."""

    def some(at, got):
        """Places i, j of the pairs to look at, each in one item, in portions."""
        fp, root, first, second, few = (got[c] for c in ("fp", "root", "first", "second", "few"))

        def mine(i, j):
            return first[i] & second[j] & (root[i] != root[j]) & ~(few[j] & (fp[j] < fp[i]))

        size = np.diff(at)
        for m in range(2, SMALL + 1):
            base, (i, j) = at[:-1][size == m][:, None], np.triu_indices(m, 1)
            i, j = (base + i).ravel(), (base + j).ravel()
            ok = mine(i, j) | mine(j, i)
            yield i[ok], j[ok]
        for s, m in zip(at[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            left, right = (s + np.flatnonzero(x[s : s + m]) for x in (first, second))
            for c in range(0, len(left), step := max(1, (1 << 18) // m)):
                i, j = np.nonzero(mine(left[c : c + step, None], right[None]))
                yield left[c + i], right[j]

    def run(batches):
        keys = ["h", "size", "p", "q"]
        for got in whole_groups(batches, keys):
            fp, n, home = got["fp"], got["n"], got["own"] == got["size"]
            for i, j in some(starts(got, keys), got):
                most = (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
                ok = (home[i] | home[j]) & (np.abs(n[i] - n[j]) <= most)
                i, j, most = i[ok], j[ok], most[ok]
                near = apart(got["sketch"], i, j) <= most
                i, j = i[near], j[near]
                i, j = np.where(fp[i] < fp[j], i, j), np.where(fp[i] < fp[j], j, i)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (fp[i], n[i], fp[j], n[j])], ["a", "na", "b", "nb"])

    return run


def _similar(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and of each distinct one (fp) its component (root) under the similarity."""
    spark = docs.sparkSession
    drop_shuffles(spark)
    rows = stash(shingle_sets(docs, shingle, similarity), "sets")
    dealt = rows.select("fp", "n", "keys").dropDuplicates(["fp"]).select(F.explode("keys").alias("h"), "fp", "n")
    dealt = dealt.repartition(partitions(spark), "h").sortWithinPartitions("h")
    keyed = stash(dealt.mapInArrow(_repeated, "h long, fp long, n long"), "keyed")
    null = F.lit(-(1 << 63))
    alone = not rows.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count()
    owners = rows.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", null).alias("k"), "th")).alias("one"), F.first("sketch").alias("sketch"))
    owners = stash(owners.join(keyed.select("fp").distinct(), "fp", "left_semi"), "owners")
    sketches = owners.select("fp", "sketch")

    def check(batches):
        hub, whose = None, None
        for batch in batches:
            a, b = [], []
            for at, (own, other, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True)):
                here = shingle_set(t, shingle)
                if other is None:
                    hub, whose = here, own
                    continue
                if own != whose:
                    raise ValueError("a pair without its other text")
                both = len(np.intersect1d(hub, here, assume_unique=True))
                if both >= (len(hub) + len(here) - both) * similarity - 1e-9:
                    a.append(other)
                    b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def folded(x, other):  # sets that can be similar have at most twice as many buckets
        half = (F.size(x) / 2).cast("int")
        sums = F.transform(F.sequence(F.lit(1), half), lambda i: F.element_at(x, i).bitwiseXOR(F.element_at(x, i + half)))
        return F.when(F.size(x) > F.size(other), sums).otherwise(F.col(x))

    def near(pairs):
        most = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6  # places in which the sets differ
        pairs = pairs.filter(F.abs(F.col("na") - F.col("nb")) <= most).distinct()
        pairs = pairs.join(sketches.toDF("a", "xa"), "a").join(sketches.toDF("b", "xb"), "b")
        pairs = pairs.withColumns({"xa": folded("xa", "xb"), "xb": folded("xb", "xa")})
        differ = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        pairs = stash(pairs.filter(differ <= most).select("a", "b"), "pairs")
        # the texts of a come to that of b, which is sent once for each GROUP of them
        groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        pairs = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
        wanted = pairs.select(F.col("a").alias("fp"), "b", "part", "a").unionByName(pairs.select(F.col("b").alias("fp"), "b", "part", F.lit(None).cast("long").alias("a")).distinct())
        wanted = stash(owners.select("fp", "one.*").join(wanted, "fp").drop("fp"), "wanted")
        text = F.col("text").cast("string")
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), null).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
        few = wanted.count() <= BROADCAST_ROWS
        # rows equal in id and text are one
        texts = texts if alone else texts.dropDuplicates(["k", "th"])
        texts = texts.join(F.broadcast(wanted) if few else wanted, ["k", "th"]).select("b", "part", "a", "text")
        dealt = texts.repartition(partitions(spark), "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        return stash(dealt.select("b", "a", "text").mapInArrow(check, "a long, b long"), "similar")

    def rooted(edges):
        roots = stars(edges).withColumnRenamed("node", "fp")
        return roots, keyed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    roots, named = rooted(near(fingerprint_pairs(rows)))
    for turn in range(ROUNDS + 1):
        # first one document for all of a group's keys, then one for each key
        rank = F.xxhash64("fp", F.lit(turn), *(["h"] if turn else []))
        groups = named.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(rank, "fp", "n", "root")).alias("hub")).filter("low <> high")
        if turn < ROUNDS:
            pairs = named.join(groups.select("h", "hub"), "h").filter("root <> hub.root").select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("hub.fp").alias("b"), F.col("hub.n").alias("nb"))
        else:
            # similar sets differ in size by less than a class: each goes to its own class and, as a guest, to the next one
            own = F.floor(F.log(F.col("n")) / F.lit(-float(np.log(similarity - 1e-3)))).cast("int")
            left = named.join(groups.select("h"), "h").select("h", "fp", "n", "root", F.explode(F.array(own, own + 1)).alias("size"), own.alias("own"))
            left = _blocks(stash(left, "open")).join(sketches, "fp")
            dealt = left.repartition(partitions(spark), "h", "size", "p", "q").sortWithinPartitions("h", "size", "p", "q", "fp")
            pairs = dealt.mapInArrow(_close(similarity), "a long, na long, b long, nb long")
        roots, named = rooted(roots.toDF("a", "b").unionByName(near(pairs)))  # earlier links are their stars
    return rows, rows.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component of docs: that with the least doc_id (null only if there is no other).

    Links are fingerprints within BITS, or sets of shingles with at least the similarity asked for.
    """
    fps, reps = _roots(docs, shingle) if similarity is None else _similar(docs, shingle, similarity)
    null = -(1 << 63)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("one"))
    first = first.join(reps.select("fp", "root"), "fp").groupBy("root").agg(F.min("one").alias("one"))
    first = stash(first.select(F.coalesce("one.doc_id", F.lit(null)).alias("__k"), F.col("one.th").alias("__th")), "kept")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("__k"), F.xxhash64(F.col("text").cast("string")).alias("__th")]
    kept = docs.select(packed(docs), *keys).join(first, ["__k", "__th"], "left_semi")
    if fps.select(F.coalesce("doc_id", F.lit(null)).alias("__k"), F.col("th").alias("__th")).join(first, ["__k", "__th"], "left_semi").groupBy("__k", "__th").count().filter("count > 1").limit(1).count():
        # rows equal in id and text are one document: of those that differ elsewhere, the one with the least hash stays
        kept = kept.groupBy("__k", "__th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")

"""SimHash near-duplicates by a self-join of binary tries, and components over the links.

A document's words are what stands between ASCII white space after A-Z are lower-cased; its shingles are
runs of three words joined by a space, repeats included (a shorter document is one shingle, an empty or
null one has fingerprint zero).  A fingerprint bit is set where over half of the shingles' XXH64 hashes
(seed 42) have it set.  Fingerprints that differ in at most two bits are linked.

How it scales.  Equal fingerprints are folded first, so copies never meet each other.  Of four 16-bit
blocks two links share at least two, so each distinct fingerprint is dealt to six tries, one for each pair
of blocks, keyed by those 32 bits.  A key with over ``HOT`` fingerprints is split once more in the same way
by its other 32 bits; such a part agrees in 48 bits, so it holds at most 65,536.  A task walks the tries of
its keys, two nodes at a time, with an error budget for the other bits, and hands on only a spanning star of
what it has linked.  A fingerprint has at most 2,080 others within two bits, so links grow with distinct
fingerprints, never with their square.
Components come from alternating large-star and small-star rounds over tables in the shared folder; a round's
joins bring one number to each edge, and adaptive execution splits what a hub makes large.  A fingerprint
that very many documents share gets its component by a broadcast.

Defined results.  Null text counts as empty.  Rows with a null doc_id get a fingerprint and the smallest
id of their component (null if it has none).  Repeated rows stay as they are.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

SEED = 42
SHINGLE = 3
BUDGET = 2
PIECE = 1 << 16
HOT = 100_000
#: A fingerprint of more copies than this is told its component by a broadcast, not by a join on the fingerprint.
COPIES = 20_000
#: Pairs of the four blocks that two linked fingerprints must share one of.
BLOCK_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        till = min(n, at + PIECE)
        firsts, lasts = start[at:till].tolist(), (start[at + k - 1 : till + k - 1] + size[at + k - 1 : till + k - 1]).tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(firsts, lasts)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def one(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "fp": [fingerprint(t) for t in b.column(1).to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), "doc_id long, fp long", one)


def trie_pairs(keys: np.ndarray, groups: np.ndarray, depth: int, budget: int, frontier: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct ``keys`` of one group that differ in at most ``budget`` bits.

    keys: uint64, sorted; groups: bounds of runs that agree in the first ``depth`` bits.  A trie node is a
    range of ``keys``; pairs of nodes go down together and are dropped once their errors exceed the budget.
    ``frontier`` bounds the node pairs that are held at a time.
    """
    lo, hi = groups[:-1], groups[1:]
    big = hi - lo > 1
    z = np.zeros(int(big.sum()), dtype=np.int64)
    stack = [(depth, lo[big], hi[big], lo[big], hi[big], z)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if not len(al):
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            ok = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if ok.any():
                yield i[ok], j[ok]
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if d == 64 or not len(al):
            continue
        if len(al) > frontier:
            half = len(al) // 2
            stack += [(d, al[:half], ah[:half], bl[:half], bh[:half], err[:half]), (d, al[half:], ah[half:], bl[half:], bh[half:], err[half:])]
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        am, bm, same = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl]), al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        parts.append(tuple(x[~same] for x in (am, ah, bl, bm, err + 1)))
        nxt = []
        for p in parts:
            keep = (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget)
            keep &= ~((p[0] == p[2]) & (p[1] - p[0] == 1))
            nxt.append([x[keep] for x in p])
        stack.append((d + 1, *[np.concatenate(x) for x in zip(*nxt)]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _turnings(value: Column, size: int) -> Column:
    """Array of (way, turned): the lowest 4 * size bits with each pair of their four blocks moved to the front."""
    block = lambda i: F.shiftrightunsigned(value, size * (3 - i)).bitwiseAND(F.lit((1 << size) - 1)).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(value, 4 * size), 4 * size) if 4 * size < 64 else F.lit(0).cast("long")
    out = []
    for n, pair in enumerate(BLOCK_PAIRS):
        turned = high
        for at, i in enumerate([*pair, *[i for i in range(4) if i not in pair]]):
            turned = turned.bitwiseOR(F.shiftleft(block(i), size * (3 - at)))
        out.append(F.struct(F.lit(n).alias("way"), turned.alias("turned")))
    return F.array(*out)


def _walk_tries(dealt: DataFrame, depth: int) -> DataFrame:
    """a, b: spanning links within runs of (way, turned, fp) that agree in way and the first ``depth`` bits."""
    dealt = dealt.withColumn("key", F.shiftrightunsigned("turned", 64 - depth))
    dealt = dealt.repartition("way", "key").sortWithinPartitions("way", "key", F.col("turned") < 0, "turned").select("way", "turned", "key", "fp")

    def walk(way: np.ndarray, turned: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = turned.astype(np.int64).view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero((way[1:] != way[:-1]) | (key[1:] != key[:-1])) + 1, [len(keys)]])
        root = _roots(len(keys), trie_pairs(keys, bounds, depth, BUDGET))
        moved = root != np.arange(len(root))
        return fp[moved], fp[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            cols = [np.concatenate(x) for x in zip(*held)]
            till = len(cols[0])
            if not last:  # the last run may go on in the next batch
                before = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[2] != cols[2][-1]))
                till = int(before[-1] + 1) if len(before) else 0
            held[:] = [[c[till:] for c in cols]] if till < len(cols[0]) else []
            if till:
                a, b = walk(*[c[:till] for c in cols])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 1 << 18:
                yield from flush(False)
                size = sum(len(h[0]) for h in held)
        yield from flush(True)

    return dealt.mapInArrow(run, "a long, b long")


def trie_links(fps: DataFrame, hot: int | None = None) -> DataFrame:
    """a, b: spanning links between distinct fingerprints (column fp) within the budget."""
    dealt = fps.select("fp", F.explode(_turnings(F.col("fp"), 16)).alias("t")).select("t.way", "t.turned", "fp")
    key = F.shiftrightunsigned("turned", 32)
    full = dealt.groupBy("way", key.alias("hot_key")).agg(F.count("*").alias("n")).where(F.col("n") > (HOT if hot is None else hot))
    full = materialize(full.select(F.col("way").alias("hot_way"), "hot_key"), "hot")
    if full.isEmpty():
        return _walk_tries(dealt, 32)
    full = F.broadcast(full)  # at most six for every HOT fingerprints, 12 bytes each
    same = (F.col("way") == F.col("hot_way")) & (key == F.col("hot_key"))
    split = dealt.join(full, same, "left_semi").select("way", "fp", F.explode(_turnings(F.col("turned"), 8)).alias("t"))
    split = split.select((F.col("way") * 8 + F.col("t.way")).alias("way"), F.col("t.turned").alias("turned"), "fp")
    return _walk_tries(dealt.join(full, same, "left_anti"), 32).union(_walk_tries(split, 48))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for each node of an edge; ids are longs.

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes; each round is a table
    in the shared folder.  Every edge is kept once per round, so nothing grows with a component's square.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state, now = None, materialize(e, "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    out.stored_at = now.stored_at
    return out


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """fp, component_id, copies: a stored row for each distinct fingerprint of (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    comps = connected_components(trie_links(distinct.select("fp")))
    led = distinct.join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "copies")
    least = led.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = materialize(led.join(least, "root").select("fp", "component_id", "copies"), "components")
    discard(comps)
    discard(distinct)
    return out


def near_duplicates(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for each row of ``docs``."""
    prints = materialize(fingerprints(docs), "fingerprints")
    comps = fingerprint_components(prints)
    # at most a row for every ``copies`` documents, so that no task gets all copies of a text
    hot = F.broadcast(comps.where(F.col("copies") > copies).select("fp", "component_id"))
    rest = comps.where(F.col("copies") <= copies).select("fp", "component_id")
    out = prints.join(hot, "fp").union(prints.join(hot, "fp", "left_anti").join(rest, "fp").select("fp", "doc_id", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id.

    Rows without id have no component of their own to lead; they stay.  Of repeated rows of one id the
    first by a hash of its columns stays.
    """
    cols = docs.columns
    prints = materialize(fingerprints(docs), "fingerprints")
    found = fingerprint_components(prints).where("component_id IS NOT NULL").select(F.col("component_id").alias("kept_id")).distinct()
    discard(prints)
    rows = docs.join(found, docs["doc_id"] == found["kept_id"], "inner").select(*[docs[c] for c in cols])
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c) for c in cols]))
    place = "row_" + "_".join(cols)  # a name that no column has
    rows = rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*cols)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))

"""Exact nearest neighbours by cosine: a block matrix join of int8 tiles with error bounds.

Vectors are scaled to unit length and packed into blocks.  A tile is a block of queries against a block of
candidates: an int8 product gives each pair's cosine within a bound that follows from the rounding errors
(if u = s*a + e and v = t*b + f, then u.v - s*t*a.b = s*a.f + e.v, at most |u|'|f| + |e||v|).  A pair whose
upper bound is below the k-th best lower bound of its query, in the tile and then over all tiles, is dropped;
what is left is recomputed in double precision on the original vectors and merged by heaps.

How it scales.  Candidate blocks are dealt to tiles by an equi-join on the block number; a task holds two
blocks of codes, an eighth of the vectors' size, and original vectors are fetched for surviving pairs alone.
Equal candidate vectors in a block are folded to the k + 1 smallest ids, beyond which a copy can never be
among the k nearest (the query itself may be one).  A tile hands on little more than k rows per query, so
what is shuffled is four numbers for queries x blocks x k.

Defined results.  Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do null ids or vectors whose length differs from the query's.  Of repeated ids one vector counts (the
first by hash).  Ties go to the smaller id.  With fewer candidates all are returned.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 5
BLOCK = 4096
QUERY_BLOCK = 1024
FOUND = "query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    df = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine & some)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and length of the rounding error of each vector at unit length."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares can't overflow
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def pack_blocks(rows: DataFrame, n_blocks: int, prefix: str, copies: int | None = None) -> DataFrame:
    """One row per block and vector length, of about ``BLOCK`` vectors: block number, dim, ids, codes, scales and errors as bytes.

    With ``copies``, of equal vectors in a block that many are kept, those of the smallest ids.
    """
    names = [f"{prefix}{n}" for n in ("block", "dim", "ids", "codes", "scales", "errors")]

    def pack(blk: int, dim: int, ids: list[int], vecs: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(ids), kind="stable")
        i, v = np.array(ids, dtype="<i8")[order], np.stack(vecs)[order]
        if copies is not None:
            _, same = np.unique(v.view([("", v.dtype)] * dim).ravel(), return_inverse=True)
            by = np.argsort(same, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(same))])
            place = np.empty(len(v), dtype=np.int64)
            place[by] = np.arange(len(v)) - first[same[by]]
            i, v = i[place < copies], v[place < copies]
        codes, scale, error = quantise(v)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((blk, dim, i.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes()), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for b in batches:
            for blk, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids, vecs = held.setdefault((blk, len(v)), ([], []))
                ids.append(i)
                vecs.append(np.asarray(v.values, dtype="<f8"))
        for (blk, dim), (ids, vecs) in held.items():
            yield pack(blk, dim, ids, vecs)

    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).select("block", "vec_id", "embedding")
    return dealt.repartition(n_blocks, "block").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ["int", "int", *["binary"] * 4])))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, components summed in their order in double precision.

    Rows are first scaled by powers of two, which changes no digit of the result and keeps squares in range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (a, b))
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        ab += x * y
        aa += x * x
        bb += y * y
    return ab / np.sqrt(aa * bb)


Coded = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids, codes, scales, errors


def tile(q: Coded, c: Coded, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query id, candidate id, least and largest cosine of the pairs of a tile that may be among the k nearest."""
    q_ids, qa, qs, qe = q
    c_ids, ca, cs, ce = c
    # products of int8 codes are whole numbers below 2**24 up to 1,040 components
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    columns = ca.astype(kind).T
    out = []
    for at in range(0, len(q_ids), 256):
        s = slice(at, at + 256)
        near = (qa[s].astype(kind) @ columns).astype(np.float64) * qs[s, None] * cs[None, :]
        slack = (1.0 + qe[s, None]) * ce[None, :] + qe[s, None] + 1e-9
        near[q_ids[s, None] == c_ids[None, :]] = -np.inf
        low = near - slack
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + slack >= kth[:, None]) & np.isfinite(near))
        out.append((q_ids[at + i], c_ids[j], low[i, j], (near + slack)[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def merge_heaps(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from all tiles: query_id, rank, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, v, s in zip(*(c.to_pylist() for c in b.columns)):
                h = heaps.setdefault(q, [])
                if len(h) < k:
                    heapq.heappush(h, (s, -v))
                elif (s, -v) > h[0]:
                    heapq.heapreplace(h, (s, -v))
        rows = [(q, n, -v, s) for q, h in heaps.items() for n, (s, v) in enumerate(sorted(h, reverse=True), 1)]
        if rows:
            q, n, v, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine of each row of ``vectors`` where ``is_query``.

    vectors: vec_id, embedding as ``usable`` gives them.  Exact: what the int8 tiles drop can't be among the k.
    """
    first = F.min_by("embedding", F.xxhash64("embedding"))
    rows = materialize(vectors.groupBy("vec_id").agg(first.alias("embedding")), "vectors")
    queries = rows.where(is_query)
    n_c, n_q = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // QUERY_BLOCK))
    cands = pack_blocks(rows, n_c, "c_", k + 1)
    asks = pack_blocks(queries, n_q, "q_").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    tiles = asks.join(cands, (F.col("at") == F.col("c_block")) & (F.col("q_dim") == F.col("c_dim")))
    parts = [f"{side}{n}" for side in "qc" for n in ("_ids", "_codes", "_scales", "_errors")]

    def coded(dim: int, ids: bytes, codes: bytes, scales: bytes, errors: bytes) -> Coded:
        return np.frombuffer(ids, "<i8"), np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scales, "<f8"), np.frombuffer(errors, "<f8")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, *x in zip(*(b.column(n).to_pylist() for n in ("q_dim", *parts))):
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in tile(coded(dim, *x[:4]), coded(dim, *x[4:]), k)], names=["query_id", "vec_id", "low", "high"])

    pairs = tiles.select("q_dim", *parts).mapInArrow(meet, "query_id long, vec_id long, low double, high double")
    # over all tiles again: a pair below the k-th best least cosine of its query can't be among the k
    by_query = Window.partitionBy("query_id")
    pairs = pairs.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("low")))).withColumn("kth", F.max(F.when(F.col("r") == k, F.col("low"))).over(by_query))
    pairs = pairs.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query_id", "vec_id")
    pairs = pairs.join(rows.select("vec_id", F.col("embedding").alias("cv")), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [b.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("qv", "cv")]
            size = np.diff(b.column("qv").offsets.to_numpy())
            ends, score = np.concatenate([[0], np.cumsum(size)]), np.zeros(b.num_rows)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                at = ends[own][:, None] + np.arange(dim)
                score[own] = cosine(flat[0][at], flat[1][at])
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    return merge_heaps(pairs.select("query_id", "vec_id", "qv", "cv").mapInArrow(exact, FOUND), k)

"""Exact nearest neighbours through a metric index.

Rows of a group that is larger than a block are dealt to the nearest of a few pivots (rows drawn by a hash of the
id) and packed into blocks.  A first pass meets each query block with a block of its own cell, which bounds how far
the k-th neighbour of each query can be.  A cell is met again only by queries whose bound it can undercut: the
triangle inequality bounds the distance to any of its rows by the distances to its pivot, the plane halfway between
two pivots by those to both.  Only such queries travel, and only k rows a query and block come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import discard, materialize

BLOCK = 4096
#: Rows a pivot stands for in groups that are larger than a block, and the most pivots there are.
CELL = 1024
MAX_PIVOTS = 512
#: Reference rows and queries that meet in one task of the second pass.
PART = 65_536
SHARE = 32_768


def _matrix(column: pa.Array, row: int, n: int) -> np.ndarray:
    return np.asarray(column[row].values, dtype=float).reshape(n, -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T), 0.0)


def _nearest_in_tile(q: np.ndarray, r: np.ndarray, k: int, codes: np.ndarray | None, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and reference places and distances of the k nearest of each query, no farther than ``bound``; reference rows are in tie order.

    A matrix product finds candidates up to its rounding error; their distances are then summed in order.  Where few rows
    lie within the bounds, these are the candidates; else the k-th of each query is looked for.
    """
    out = []
    norm = (r * r).sum(axis=1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        own = (part * part).sum(axis=1)
        near = (-2.0 * part) @ r.T
        near += norm
        near += own[:, None]
        if codes is not None:  # ids as numbers, those of the queries first
            near[codes[at : at + len(part), None] == codes[None, len(q) :]] = np.inf
        room = 1e-9 * (own + norm.max(initial=0.0)) + 1e-300
        kth = np.full(len(part), np.inf) if bound is None else bound[at : at + len(part)] ** 2
        within = near <= (kth + room)[:, None]
        if near.shape[1] > k and np.count_nonzero(within) > 2 * k * len(part):
            kth = np.minimum(kth, np.partition(near, k - 1, axis=1)[:, k - 1])
            within = near <= (kth + room)[:, None]
        i, j = np.nonzero(within)
        if not np.isfinite(near[i, j]).all():
            i, j = i[fine := np.isfinite(near[i, j])], j[fine]
        d = np.zeros(len(i))
        for c in range(q.shape[1]):
            d += (part[i, c] - r[j, c]) ** 2
        d = np.sqrt(d)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        if bound is not None:
            best &= d <= bound[at + i]
        out.append((at + i[best], j[best], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))


def _small(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table of at most MAX_PIVOTS rows of numbers where there is but one group, hence the broadcast; else as it is."""
    return F.broadcast(df) if len(keys) == 1 else df


def _celled(df: DataFrame, id_col: str, vec: str, keys: Sequence[str], pivots: np.ndarray, sizes: DataFrame) -> DataFrame:
    """keys, id, v, cell and the distance to the cell's pivot; groups of at most a block are one cell, -1."""

    @F.arrow_udf("struct<cell:int,d:double>")
    def nearest(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, pivots.shape[1]))
        cells, dist = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
        for at in range(0, len(x), 4096):
            d = _squares(x[at : at + 4096], pivots)
            cells[at : at + 4096] = d.argmin(axis=1)
            dist[at : at + 4096] = np.sqrt(d.min(axis=1))
        return pa.StructArray.from_arrays([pa.array(cells), pa.array(dist)], names=["cell", "d"])

    rows = df.select(*keys, F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.join(_small(sizes, keys), list(keys))
    if len(pivots) < 2:
        return rows.select(*keys, "id", "v", F.lit(-1).alias("cell"), F.lit(0.0).alias("d"))
    at = rows.withColumn("at", nearest("v"))
    return at.select(*keys, "id", "v", F.when(F.col("big"), F.col("at.cell")).otherwise(-1).alias("cell"), F.when(F.col("big"), F.col("at.d")).otherwise(0.0).alias("d"))


def _need(square: np.ndarray, bound: np.ndarray, own: int, cell: int, low: float, high: float, pivots: np.ndarray) -> np.ndarray:
    """Which queries of cell ``own`` may have a row within their bound among rows of ``cell`` that lie ``low`` to ``high`` from its pivot; ``square``: squares to all pivots."""
    if cell < 0 or cell == own:
        return np.ones(len(bound), dtype=bool)
    away = np.sqrt(square[:, cell])
    room = 1e-6 * (1.0 + np.sqrt(square.max(initial=0.0)))  # products round; a cell too many does no harm
    least = np.maximum(away - high, low - away)
    apart = np.sqrt(((pivots[own] - pivots[cell]) ** 2).sum())
    if own >= 0 and apart > 0:
        least = np.maximum(least, (square[:, cell] - square[:, own]) / (2.0 * apart))
    return least <= bound + room


def _packed(rows: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """keys, cell, number, ids and vectors (row after row) of blocks of about BLOCK rows."""
    counts = rows.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    dealt = rows.join(_small(counts, keys), [*keys, "cell"]).withColumn("number", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    packed = dealt.groupBy(*keys, "cell", "number", "m").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("r"), F.min("d").alias("low"), F.max("d").alias("high"))
    return packed.select(*keys, "cell", F.col("number").alias(f"{prefix}number"), F.col("m").cast("int").alias(f"{prefix}m"), F.transform("r", lambda x: x["id"]).alias(f"{prefix}ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias(f"{prefix}vecs"), "low", "high")


class MetricIndex:
    """Reference rows in cells, and the steps of a search; ``visited`` tells what share of all pairs a search looks at."""

    def __init__(self, reference: DataFrame, id_col: str, vec: str, keys: Sequence[str], pivots: int | None = None):
        self.keys = ["__g", *keys]
        rows = reference.withColumn("__g", F.lit(0))
        least = 0 if pivots else BLOCK
        self.sizes = rows.groupBy(*self.keys).agg((F.count("*") > least).alias("big"))
        largest = rows.groupBy(*self.keys).count().agg(F.max("count")).first()[0] or 0
        self.one_block = largest <= BLOCK and not pivots  # each group is one block: nothing is left for a second pass
        if pivots is None:
            pivots = min(MAX_PIVOTS, math.ceil(largest / CELL)) if largest > BLOCK else 1
        drawn = reference.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(pivots).select("v")
        self.pivots = np.unique(np.array([r[0] for r in drawn.collect()], dtype=float).reshape(-1, len(first[0]) if (first := drawn.first()) else 1), axis=0)
        self.blocks = materialize(_packed(_celled(rows, id_col, vec, self.keys, self.pivots, self.sizes), self.keys, "r_"), "index")
        # parts of blocks and shares of queries: a few tasks for each core, but never more rows than a task holds with ease
        rows = self.blocks.select(*self.keys, "cell", "r_number", "r_m", "low", "high", F.size("r_ids").cast("long").alias("rows"))
        least = (rows.agg(F.sum("rows")).first()[0] or 0) / math.sqrt(2 * reference.sparkSession.sparkContext.defaultParallelism)
        before = F.sum("rows").over(Window.partitionBy(*self.keys).orderBy("cell", "r_number")) - F.col("rows")
        placed = rows.withColumn("part", F.floor(before / min(PART, max(BLOCK, math.ceil(least)))).cast("int"))
        self.parts = materialize(placed.select(*self.keys, "cell", "r_number", "part"), "parts")
        cells = placed.groupBy(*self.keys, "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("r_m").alias("m"), F.sum("rows").alias("rows"), F.collect_set("part").alias("parts"))
        shares = F.ceil(F.sum("rows") / min(SHARE, max(CELL, math.ceil(least)))).cast("int")
        self.cells = cells.groupBy(*self.keys).agg(F.collect_list(F.struct("cell", "low", "high", "m", "parts")).alias("cells"), shares.alias("shares"))

    def first_pass(self, queries: DataFrame, id_col: str, vec: str, k: int, same: bool) -> DataFrame:
        """Blocks of queries with the edges to one block of their cell and the bound that these give."""
        rows = _celled(queries.withColumn("__g", F.lit(0)), id_col, vec, self.keys, self.pivots, self.sizes)
        asked = _packed(rows, self.keys, "q_").drop("low", "high")
        counts = self.blocks.groupBy(*self.keys, "cell").agg(F.max("r_m").alias("m"))
        asked = asked.join(counts, [*self.keys, "cell"], "left").withColumn("r_number", F.pmod(F.col("q_number"), F.coalesce("m", F.lit(1))))
        met = asked.join(self.blocks.select(*self.keys, "cell", "r_number", "r_ids", "r_vecs"), [*self.keys, "cell", "r_number"], "left").drop("m", "q_number", "q_m")
        kinds = {f.name: f.dataType for f in met.schema}
        near = kinds["r_ids"]
        want = T.StructType([*[T.StructField(c, kinds[c]) for c in (*self.keys, "cell", "r_number", "q_ids", "q_vecs")], T.StructField("bound", T.ArrayType(T.DoubleType())), T.StructField("e_src", T.ArrayType(T.IntegerType())), T.StructField("e_dst", near), T.StructField("e_d", T.ArrayType(T.DoubleType()))])
        arrow = to_arrow_schema(want)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    one = b.slice(row, 1)
                    qi = one.column("q_ids")[0].values
                    bound = np.full(len(qi), np.inf)
                    if one.column("r_ids")[0].is_valid:
                        ri = one.column("r_ids")[0].values
                        i, j, d = _nearest_in_tile(_matrix(one.column("q_vecs"), 0, len(qi)), _matrix(one.column("r_vecs"), 0, len(ri)), k, _codes(qi, ri) if same else None)
                        full = np.bincount(i, minlength=len(qi)) >= k
                        far = np.zeros(len(qi))
                        np.maximum.at(far, i, d)
                        bound[full] = far[full]
                        edges = [pa.array([i.astype(np.int32)]), pa.ListArray.from_arrays(pa.array([0, len(j)], pa.int32()), ri.take(pa.array(j))), pa.array([d])]
                    else:
                        edges = [pa.array([[]], arrow.field(f).type) for f in ("e_src", "e_dst", "e_d")]
                    kept = [one.column(c) for c in (*self_keys, "cell", "r_number", "q_ids", "q_vecs")]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*kept, pa.array([bound]), *edges], arrow)], schema=arrow)

        self_keys = tuple(self.keys)
        return materialize(met.mapInArrow(run, want), "first_pass")

    def wanted(self, first: DataFrame) -> DataFrame:
        """keys, part, share and the queries (ids, vectors, bounds, own cell and block) that must meet a cell of that part."""
        both = first.join(_small(self.cells, self.keys), self.keys).withColumn("share", F.pmod(F.xxhash64("cell", "r_number", F.get("q_ids", F.lit(0))), "shares").cast("int"))
        kinds = {f.name: f.dataType for f in both.schema}
        keys, pivots = tuple(self.keys), self.pivots
        want = T.StructType([*[T.StructField(c, kinds[c]) for c in keys], *[T.StructField(c, T.IntegerType()) for c in ("part", "share", "own", "seen")], T.StructField("q_ids", kinds["q_ids"]), T.StructField("q_vecs", kinds["q_vecs"]), T.StructField("bound", T.ArrayType(T.DoubleType()))])
        arrow = to_arrow_schema(want)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    qi, own = b.column("q_ids")[row].values, b.column("cell")[row].as_py()
                    q, bound = _matrix(b.column("q_vecs"), row, len(qi)), np.asarray(b.column("bound")[row].values, dtype=float)
                    square, parts = _squares(q, pivots), {}
                    for c in b.column("cells")[row].as_py():
                        if c["cell"] != own or c["m"] > 1:
                            need = _need(square, bound, own, c["cell"], c["low"], c["high"], pivots)
                            for part in c["parts"]:
                                parts[part] = parts.get(part, False) | need
                    for part, need in parts.items():
                        if not need.any():
                            continue
                        lists = [qi.take(pa.array(np.flatnonzero(need))), pa.array(q[need].ravel()), pa.array(bound[need])]
                        head = [*[b.column(k).slice(row, 1) for k in keys], pa.array([part]), b.column("share").slice(row, 1), pa.array([own]), b.column("r_number").slice(row, 1)]
                        cols = [*head, *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]]
                        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow)], schema=arrow)

        return both.select(*keys, "cell", "r_number", "q_ids", "q_vecs", "bound", "cells", "share").mapInArrow(run, want)

    def second_pass(self, wanted: DataFrame, k: int, same: bool) -> DataFrame:
        """The k nearest, within their bounds, of the queries of a share among the rows of a part: a query travels once a part, a row once a share."""
        shares = self.cells.select(*self.keys, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        held = self.blocks.join(_small(self.parts, self.keys), [*self.keys, "cell", "r_number"]).join(_small(shares, self.keys), self.keys)
        kinds = {f.name: f.dataType for f in [*wanted.schema, *held.schema]}
        keys, pivots, by = tuple(self.keys), self.pivots, [*self.keys, "part", "share"]
        want = T.StructType([*[T.StructField(c, kinds[c]) for c in keys], T.StructField("src", kinds["q_ids"].elementType), T.StructField("dst", kinds["r_ids"].elementType), T.StructField("distance", T.DoubleType())])
        arrow = to_arrow_schema(want)

        def run(asked: pa.Table, part: pa.Table) -> pa.Table:
            out = []
            if asked.num_rows and part.num_rows:
                ids = pa.concat_arrays([part.column("r_ids")[r].values for r in range(part.num_rows)])
                place = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # tie order
                ends = np.cumsum([0, *[len(part.column("r_ids")[r].values) for r in range(part.num_rows)]])
            for row in range(asked.num_rows if part.num_rows else 0):
                qi, own, seen = asked.column("q_ids")[row].values, asked.column("own")[row].as_py(), asked.column("seen")[row].as_py()
                q, bound = _matrix(asked.column("q_vecs"), row, len(qi)), np.array(asked.column("bound")[row].values, dtype=float)
                square = _squares(q, pivots)
                i, j, d = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
                for r in range(part.num_rows):
                    cell, low, high = (part.column(c)[r].as_py() for c in ("cell", "low", "high"))
                    if cell == own and part.column("r_number")[r].as_py() == seen:
                        continue
                    need = np.flatnonzero(_need(square, bound, own, cell, low, high, pivots))
                    if not len(need):
                        continue
                    ri = part.column("r_ids")[r].values
                    ni, nj, nd = _nearest_in_tile(q[need], _matrix(part.column("r_vecs"), r, len(ri)), k, _codes(qi.take(pa.array(need)), ri) if same else None, bound[need])
                    i, j, d = np.concatenate([i, need[ni]]), np.concatenate([j, ends[r] + nj]), np.concatenate([d, nd])
                    order = np.lexsort((place[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    at = np.arange(len(i)) - np.searchsorted(i, i)
                    bound[i[at == k - 1]] = np.minimum(bound[i[at == k - 1]], d[at == k - 1])
                    i, j, d = i[at < k], j[at < k], d[at < k]
                if len(i):
                    head = [pa.array([asked.column(c)[row].as_py()] * len(i), type=arrow.field(c).type) for c in keys]
                    out.append(pa.Table.from_arrays([*head, *[x.cast(arrow.field(c).type) for c, x in (("src", qi.take(pa.array(i))), ("dst", ids.take(pa.array(j))))], pa.array(d)], schema=arrow))
            return pa.concat_tables(out) if out else arrow.empty_table()

        return wanted.groupBy(*by).cogroup(held.select(*by, "cell", "r_number", "low", "high", "r_ids", "r_vecs").groupBy(*by)).applyInArrow(run, want)

    def visited(self, first: DataFrame) -> float:
        """Share of all pairs of queries and reference rows of a group that the search compares."""
        size = lambda c: F.sum(F.size(c).cast("double"))
        asked, held = first.groupBy(*self.keys).agg(size("q_ids").alias("q")), self.blocks.groupBy(*self.keys).agg(size("r_ids").alias("r"))
        whole = asked.join(held, self.keys).agg(F.sum(F.col("q") * F.col("r"))).first()[0]
        blocks = self.blocks.join(self.parts, [*self.keys, "cell", "r_number"]).select(*self.keys, "part", "cell", "r_number", "low", "high", F.size("r_ids").alias("r"))
        pivots = self.pivots

        @F.udf("long")
        def needed(vecs, bound, own, cell, low, high):
            q = np.asarray(vecs, dtype=float).reshape(len(bound), -1)
            return int(_need(_squares(q, pivots), np.asarray(bound, dtype=float), own, cell, low, high, pivots).sum())

        one = first.join(blocks, [*self.keys, "cell", "r_number"]).agg(F.sum(F.size("q_ids").cast("double") * F.col("r"))).first()[0] or 0.0
        met = self.wanted(first).join(blocks, [*self.keys, "part"]).where("NOT (cell = own AND r_number = seen)")
        more = met.agg(F.sum(needed("q_vecs", "bound", "own", "cell", "low", "high").cast("double") * F.col("r"))).first()[0] or 0.0
        return (one + more) / whole if whole else 0.0


def _codes(a: pa.Array, b: pa.Array) -> np.ndarray | None:
    """Numbers of the ids, those of ``a`` first; None if the two share no id."""
    if a.type == b.type and not pc.any(pc.is_in(a, value_set=b)).as_py():
        return None
    return pd.factorize(np.array([*a.to_pylist(), *b.to_pylist()], dtype=object))[0]


def knn_edges(queries: DataFrame, reference: DataFrame, k: int, q_id: str = "id", r_id: str = "id", vec: str = "vec", keys: Sequence[str] = (), same: bool = False, blocks: int | None = None) -> DataFrame:
    """keys, src, dst, distance, rank: the k nearest reference rows of each query, ties to the smaller id.

    All vectors have one length.  ``blocks`` sets the number of pivots, in groups of any size.
    """
    index = MetricIndex(reference, r_id, vec, keys, blocks)
    first = index.first_pass(queries, q_id, vec, k, same)
    near = first.select(*index.keys, "q_ids", F.explode(F.arrays_zip("e_src", "e_dst", "e_d")).alias("e"))
    edges = near.select(*index.keys, F.get("q_ids", F.col("e.e_src")).alias("src"), F.col("e.e_dst").alias("dst"), F.col("e.e_d").alias("distance"))
    if not index.one_block:
        edges = edges.unionByName(index.second_pass(index.wanted(first), k, same))
    rank = F.row_number().over(Window.partitionBy(*index.keys, "src").orderBy("distance", "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k).drop("__g")


def visited_share(queries: DataFrame, reference: DataFrame, k: int, q_id: str = "id", r_id: str = "id", vec: str = "vec", keys: Sequence[str] = (), same: bool = False, blocks: int | None = None) -> float:
    """Share of all pairs that ``knn_edges`` compares."""
    index = MetricIndex(reference, r_id, vec, keys, blocks)
    first = index.first_pass(queries, q_id, vec, k, same)
    share = index.visited(first)
    discard(first)
    discard(index.blocks)
    return share

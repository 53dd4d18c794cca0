"""Embeddings, clusters and trajectories over object vectors.

PCA, k-means and neighbour graphs are distributed.  Diffusion maps, t-SNE and UMAP have no
Spark form: one task fits them on at most ``max_rows`` rows (a parameter; more are an error).  ``laid_out``
fits a larger table on a sample of that many rows and carries the layout over to every row through
``operators.joins.knn_edges``; ``sweep`` does so for several settings side by side.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize
from .joins import knn_edges
from .pca import PcaModel, fit_vectors, score_vectors
from .sampling import sample_n

MAX_ROWS = 20_000


def pca_fit(df: DataFrame, features: Sequence[str], k: int | None = None, variance: float | None = None, cap: int = 30) -> PcaModel:
    """Principal components of named columns: ``k`` of them, or as few as reach ``variance`` (at most ``cap``)."""
    return fit_vectors(df, F.array(*[F.col(f"`{f}`").cast("double") for f in features]), k, variance, cap, features)


def pca_scores(df: DataFrame, model: PcaModel, out: str = "x_pca") -> DataFrame:
    """Adds an array of scores from the model's named columns."""
    return score_vectors(df, model, F.array(*[F.col(f"`{f}`").cast("double") for f in model.names]), out)


def kmeans(df: DataFrame, k: int, vec: str = "vec", starts: int = 10, seed: int = 0, out: str = "cluster", max_iter: int = 300) -> DataFrame:
    """Adds cluster labels as strings: the best of several k-means++ starts by cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))
    x.persist()
    # a table that is itself persisted is decoded again in each round; of another one a fit keeps the vectors
    fits = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="__c", maxIter=max_iter).fit(x.select("__v")) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    x.unpersist()
    return best.transform(x).withColumn(out, F.col("__c").cast("string")).drop("__v", "__c")


def kmeans_sweep(df: DataFrame, ks: Sequence[int], vec: str = "vec", starts: int = 10, seed: int = 0, out: str = "cluster") -> DataFrame:
    """Adds ``out``_k{k} for each k, and the last one under ``out`` too."""
    for k in ks:
        df = kmeans(df, k, vec, starts, seed, f"{out}_k{k}")
    return df.withColumn(out, F.col(f"{out}_k{ks[-1]}"))


def jaccard_graph(edges: DataFrame) -> DataFrame:
    """src, dst, weight (src < dst): shared share of the neighbour lists of rows that are neighbours.

    Edges are read three times, so they are stored: their search would run for each list again.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    lists = edges.groupBy("src").agg(F.collect_set("dst").alias("near"))
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    a = lists.select("src", F.col("near").alias("na"))
    b = lists.select(F.col("src").alias("dst"), F.col("near").alias("nb"))
    w = F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", w.alias("weight")).where("weight > 0")


def _move_nodes(both: DataFrame, total: float, rounds: int) -> DataFrame:
    """id, label after local moves that raise modularity; ``both`` holds each edge in both directions, loops once.

    Half of the nodes (by a hash that changes with the round) may move at a time, each to the neighbouring
    label of largest gain; joins are on node ids and on labels, and each round is a stored table.
    """
    degree = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "degree")
    labels = degree.select("id", F.col("id").alias("label"))
    for r in range(rounds):
        sizes = labels.join(degree, "id").groupBy("label").agg(F.sum("k").alias("tot"))
        links = both.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = labels.select("id", "label", F.lit(0.0).alias("w"))
        options = links.unionByName(own).groupBy("id", "label").agg(F.sum("w").alias("w")).join(sizes, "label").join(degree, "id").join(labels.select("id", F.col("label").alias("own")), "id")
        rest = F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / total, 9)
        best = options.withColumn("gain", gain).groupBy("id").agg(F.max_by("label", F.struct("gain", F.col("label") == F.col("own"), F.xxhash64("label"))).alias("new"), F.max("own").alias("own"))
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        before, after = labels, materialize(best.select("id", F.when(turn, F.col("new")).otherwise(F.col("own")).alias("label"), (F.col("new") != F.col("own")).alias("wants")), "labels")
        labels = after.select("id", "label")
        labels.stored_at = after.stored_at
        discard(before)
        if after.where("wants").isEmpty():
            break
    else:
        warnings.warn(f"nodes still wanted to move after {rounds} rounds", stacklevel=2)
    discard(degree)
    return labels


def graph_clusters(graph: DataFrame, nodes: DataFrame, min_size: int = 10, rounds: int = 12, levels: int = 6) -> DataFrame:
    """id, cluster: Louvain's modularity clustering of (src, dst, weight) in parallel moves; clusters below ``min_size`` become -1.

    After the moves of a level the graph is contracted to its labels, until nothing merges.  Clusters are
    numbered by size.
    """
    both = materialize(graph.select("src", "dst", "weight").union(graph.select(F.col("dst"), F.col("src"), "weight")), "graph")
    total = both.agg(F.sum("weight")).first()[0]
    where = materialize(nodes.select("id").distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(levels if total else 0):
        moved = _move_nodes(both, total, rounds)
        n, k = moved.agg(F.count("*"), F.count_distinct("label")).first()
        if n == k:
            break
        before, where = where, materialize(where.join(moved.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        discard(before)
        a, b = moved.select(F.col("id").alias("src"), F.col("label").alias("la")), moved.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
        before, both = both, materialize(both.join(a, "src").join(b, "dst").groupBy(F.col("la").alias("src"), F.col("lb").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
        discard(before)
        discard(moved)
    sizes = where.groupBy("label").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy(F.col("n") >= min_size).orderBy(F.desc("n"), "label")) - 1)
    return where.join(sizes, "label").select("id", F.when(F.col("n") >= min_size, F.col("k")).otherwise(-1).cast("string").alias("cluster"))


def modularity(graph: DataFrame, clusters: DataFrame) -> float:
    """Newman modularity of a clustering of (src, dst, weight)."""
    c = clusters.select("id", "cluster")
    e = graph.join(c.withColumnsRenamed({"id": "src", "cluster": "ca"}), "src").join(c.withColumnsRenamed({"id": "dst", "cluster": "cb"}), "dst")
    total = e.agg(F.sum("weight")).first()[0] or 1.0
    inside = e.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))).first()[0] or 0.0
    deg = e.select(F.col("ca").alias("c"), "weight").union(e.select(F.col("cb"), "weight")).groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return inside / total - deg / (2 * total) ** 2


def phenograph(df: DataFrame, k: int = 30, id_col: str = "object_id", vec: str = "vec", min_size: int = 10) -> DataFrame:
    """id, cluster: nearest neighbours, Jaccard graph, Louvain clusters."""
    edges = materialize(knn_edges(df, df, k, id_col, id_col, vec, same=True), "edges")
    return graph_clusters(jaccard_graph(edges), df.select(F.col(id_col).alias("id")), min_size)


def _whole(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_rows: int) -> DataFrame:
    """One task over a table of at most ``max_rows`` rows."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows exceed max_rows={max_rows}: fit on a sample and carry it over by nearest neighbours")
    return df.groupBy(F.lit(0).alias("__one")).applyInPandas(fn, schema)


def _pairwise(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    return np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0.0)


def diffusion_map(df: DataFrame, n_comps: int = 10, k: int = 15, id_col: str = "object_id", vec: str = "vec", max_rows: int = 5_000) -> DataFrame:
    """id, x_diffmap: eigenvectors of a density-corrected diffusion operator, constant one left out (Coifman and Lafon 2006)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        d2 = _pairwise(x)
        near = np.sort(d2, axis=1)[:, : min(k + 1, len(x))]
        sig = np.sqrt(np.maximum(near[:, -1], 1e-12))
        w = np.exp(-d2 / (sig[:, None] * sig[None, :])) * ((d2 <= near[:, -1:]) | (d2 <= near[:, -1:].T))
        q = w.sum(axis=1)
        w = w / np.outer(q, q)
        z = np.sqrt(w.sum(axis=1))
        val, u = np.linalg.eigh(w / np.outer(z, z))
        order = np.argsort(-val)[1 : n_comps + 1]
        y = u[:, order] / z[:, None]
        y = y / np.linalg.norm(y, axis=0) * np.sign(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])])
        return pd.DataFrame({"id": pdf["id"], "x_diffmap": list((y * val[order]).astype(float))})

    kind = dict(df.dtypes)[id_col]
    return _whole(df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")), fit, f"id {kind}, x_diffmap array<double>", max_rows)


def _affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    d2 = _pairwise(x)
    np.fill_diagonal(d2, np.inf)
    beta, lo, hi = np.ones(len(x)), np.zeros(len(x)), np.full(len(x), np.inf)
    beta /= np.maximum(np.median(np.where(np.isfinite(d2), d2, np.nan_to_num(d2, posinf=0)), axis=1), 1e-12)
    for _ in range(60):
        p = np.exp(-d2 * beta[:, None])
        s = np.maximum(p.sum(axis=1), 1e-300)
        h = np.log(s) + beta * (np.where(np.isfinite(d2), d2, 0) * p).sum(axis=1) / s
        wide = h > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isfinite(hi), (lo + hi) / 2, beta * 2)
    p = p / s[:, None]
    return (p + p.T) / (2 * len(x))


def tsne(df: DataFrame, perplexity: float = 30.0, id_col: str = "object_id", vec: str = "vec", steps: int = 400, seed: int = 0, max_rows: int = 3_000) -> DataFrame:
    """id, x_tsne (two numbers): exact t-SNE (van der Maaten and Hinton 2008) of a bounded table."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        if perplexity >= len(x):
            raise ValueError("perplexity must be below the number of rows")
        p = _affinities(x, perplexity)
        y = np.random.default_rng(seed).normal(0, 1e-4, (len(x), 2))
        v, gain = np.zeros_like(y), np.ones_like(y)
        for t in range(steps):
            q = 1.0 / (1.0 + _pairwise(y))
            np.fill_diagonal(q, 0)
            pq = (p * (12.0 if t < 100 else 1.0) - q / q.sum()) * q
            g = 4 * (pq.sum(axis=1)[:, None] * y - pq @ y)
            gain = np.maximum(np.where(np.sign(g) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
            v = (0.5 if t < 100 else 0.8) * v - max(len(x) / 48, 50) * gain * g
            y = y + v
            y -= y.mean(axis=0)
        return pd.DataFrame({"id": pdf["id"], "x_tsne": list(y)})

    kind = dict(df.dtypes)[id_col]
    return _whole(df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")), fit, f"id {kind}, x_tsne array<double>", max_rows)


def umap(df: DataFrame, n_neighbors: int = 15, min_dist: float = 0.1, id_col: str = "object_id", vec: str = "vec", epochs: int = 200, seed: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    """id, x_umap (two numbers): fuzzy neighbour graph laid out by stochastic attraction and repulsion (McInnes 2018)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        n, k = len(x), min(n_neighbors, len(x) - 1)
        rng = np.random.default_rng(seed)
        if n < 4:
            return pd.DataFrame({"id": pdf["id"], "x_umap": list(rng.normal(size=(n, 2)))})
        idx, dist = np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        for at in range(0, n, 1024):
            d = np.sqrt(np.maximum((x[at : at + 1024] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[at : at + 1024] @ x.T, 0))
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            j = np.argsort(d, axis=1, kind="stable")[:, :k]
            idx[at : at + 1024], dist[at : at + 1024] = j, np.take_along_axis(d, j, 1)
        rho, lo, hi = dist[:, 0], np.zeros(n), np.full(n, np.inf)
        sig = np.ones(n)
        for _ in range(64):
            s = np.exp(-np.maximum(dist - rho[:, None], 0) / sig[:, None]).sum(axis=1)
            big = s > np.log2(k)
            hi, lo = np.where(big, sig, hi), np.where(big, lo, sig)
            sig = np.where(np.isfinite(hi), (lo + hi) / 2, sig * 2)
        w = np.exp(-np.maximum(dist - rho[:, None], 0) / np.maximum(sig, 1e-9)[:, None]).ravel()
        i, j = np.repeat(np.arange(n), k), idx.ravel()
        key, inv = np.unique(np.concatenate([i * n + j, j * n + i]), return_inverse=True)
        a, b = np.zeros(len(key)), np.zeros(len(key))
        np.maximum.at(a, inv[: len(w)], w)
        np.maximum.at(b, inv[len(w) :], w)
        w = a + b - a * b
        i, j = key // n, key % n
        ts = np.linspace(0, 3, 300)
        target = np.where(ts <= min_dist, 1.0, np.exp(-(ts - min_dist)))
        grid = [(((1 / (1 + ca * ts ** (2 * cb)) - target) ** 2).sum(), ca, cb) for ca in np.linspace(0.3, 3, 28) for cb in np.linspace(0.5, 1.6, 23)]
        _, ca, cb = min(grid)
        c = x - x.mean(0)
        y = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
        y = 10 * y / max(np.abs(y).max(), 1e-9) + rng.normal(0, 1e-4, (n, 2))
        for t in range(epochs):
            rate = 1 - t / epochs
            use = rng.random(len(w)) < w / w.max()
            p, q = i[use], j[use]
            d = y[p] - y[q]
            d2 = (d * d).sum(1)
            g = np.clip((-2 * ca * cb * np.maximum(d2, 1e-9) ** (cb - 1) / (1 + ca * d2**cb))[:, None] * d, -4, 4)
            np.add.at(y, p, rate * g)
            np.add.at(y, q, -rate * g)
            p = np.repeat(p, 5)
            q = rng.integers(0, n, len(p))
            d = y[p] - y[q]
            d2 = (d * d).sum(1)
            g = np.clip((2 * cb / ((0.001 + d2) * (1 + ca * d2**cb)))[:, None] * d, -4, 4)
            g[p == q] = 0
            np.add.at(y, p, rate * g)
        return pd.DataFrame({"id": pdf["id"], "x_umap": list(y)})

    kind = dict(df.dtypes)[id_col]
    return _whole(df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")), fit, f"id {kind}, x_umap array<double>", max_rows)


def carry_over(df: DataFrame, fitted: DataFrame, sample: DataFrame, column: str, k: int = 5, id_col: str = "object_id", vec: str = "vec") -> DataFrame:
    """id, ``column`` for all rows: mean of the k nearest sampled rows' coordinates, weighted by inverse distance."""
    edges = knn_edges(df, sample, k, id_col, id_col, vec)
    pts = edges.join(fitted.select(F.col("id").alias("dst"), F.posexplode(column).alias("i", "x")), "dst").withColumn("w", 1.0 / (F.col("distance") + 1e-9))
    each = pts.groupBy("src", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return each.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(column))


def laid_out(df: DataFrame, fit: Callable[..., DataFrame], column: str, max_rows: int, id_col: str = "object_id", vec: str = "vec", seed: int = 0, **settings) -> DataFrame:
    """id, ``column`` for all rows: the layout of ``fit`` on all of them, or on a sample of ``max_rows``, carried over."""
    rows = df.select(F.col(id_col), F.col(vec).cast("array<double>").alias(vec))
    if df.count() <= max_rows:
        return fit(rows, id_col=id_col, vec=vec, max_rows=max_rows, **settings)
    sample = materialize(sample_n(rows, max_rows, id_col, seed), "sample")
    fitted = materialize(fit(sample, id_col=id_col, vec=vec, max_rows=max_rows, **settings), "layout")
    return carry_over(rows, fitted, sample, column, id_col=id_col, vec=vec)


def sweep(df: DataFrame, fit: Callable[..., DataFrame], column: str, grid: Sequence[dict], max_rows: int, id_col: str = "object_id", vec: str = "vec", seed: int = 0) -> DataFrame:
    """id, ``column``, settings (as text), last (whether of the last of the grid): a layout for each setting of the grid."""
    out: DataFrame | None = None
    for n, settings in enumerate(grid):
        name = ", ".join(f"{k}={v}" for k, v in settings.items())
        part = laid_out(df, fit, column, max_rows, id_col, vec, seed, **settings).withColumns({"settings": F.lit(name), "last": F.lit(n == len(grid) - 1)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a sweep needs settings")
    return out


def cluster_tree(df: DataFrame, cluster: str = "cluster", vec: str = "vec") -> list[tuple[str, str, float]]:
    """Minimum spanning tree over cluster centroids (a few dozen points on the driver)."""
    rows = df.select(cluster, F.posexplode(vec).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x")).collect()
    cent: dict[str, dict[int, float]] = {}
    for r in rows:
        cent.setdefault(r[cluster], {})[r["i"]] = r["x"]
    names = sorted(cent)
    x = np.array([[cent[n][i] for i in sorted(cent[n])] for n in names])
    d = np.sqrt(_pairwise(x))
    done, out = [0], []
    while len(done) < len(names):
        v, a, b = min((d[a, b], a, b) for a in done for b in range(len(names)) if b not in done)
        out.append((names[a], names[b], float(v)))
        done.append(b)
    return out


def lineages(df: DataFrame, start: str, cluster: str = "cluster", id_col: str = "object_id", vec: str = "vec") -> DataFrame:
    """id, lineage, pseudotime (0 to 1), weight: arc length of the nearest point on each root-to-leaf path of the cluster tree.

    A polyline approximation: paths run straight through the centroids, no principal curves are fitted.
    Paths and centroids are tiny and go to the tasks; each object is placed by plain NumPy in one pass.
    """
    tree = cluster_tree(df, cluster, vec)
    near: dict[str, list[str]] = {}
    for a, b, _ in tree:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    paths, stack = [], [[start]]
    while stack:
        p = stack.pop()
        nxt = [n for n in near.get(p[-1], []) if n not in p]
        if nxt:
            stack += [[*p, n] for n in sorted(nxt, reverse=True)]
        else:
            paths.append(p)
    rows = df.select(cluster, F.posexplode(vec).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x")).collect()
    cent: dict[str, dict[int, float]] = {}
    for r in rows:
        cent.setdefault(r[cluster], {})[r["i"]] = r["x"]
    lines = [np.array([[cent[c][i] for i in sorted(cent[c])] for c in p]) for p in paths]

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            dist, time = [], []
            for line in lines:
                best, at, run = np.full(len(x), np.inf), np.zeros(len(x)), 0.0
                for a, b in zip(line, line[1:] if len(line) > 1 else line):
                    length = np.linalg.norm(b - a)
                    t = np.clip((x - a) @ (b - a) / max(length**2, 1e-12), 0, 1)
                    d = np.linalg.norm(x - a - t[:, None] * (b - a), axis=1)
                    at, best, run = np.where(d < best, run + t * length, at), np.minimum(best, d), run + length
                dist.append(best)
                time.append(at / max(run, 1e-12))
            w = 1 / (np.array(dist) + 1e-9)
            w = w / w.max(axis=0)
            for n in range(len(lines)):
                yield pd.DataFrame({"id": pdf["id"], "lineage": n + 1, "pseudotime": time[n], "weight": w[n]})

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInPandas(place, f"id {kind}, lineage int, pseudotime double, weight double")

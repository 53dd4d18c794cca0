"""Lineages through clusters as principal curves, with a pseudotime along each.

Lineages are the paths of the clusters' minimum spanning tree from a start cluster to its leaves.  Each begins as
the polyline through its centroids.  A pass projects every object on the curves of its lineages and adds up
weighted positions in bins of arc length; bins are smoothed into the next curves, which are drawn to their mean
where lineages share clusters.  A pass reads the rows once; what comes back is a few numbers for each lineage and
bin, added in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import cluster_tree
from .pca import _blocks, _summed

BINS = 60
PASSES = 12
#: Lineages that are farther than the nearest by more than this share of squared distances have no part in an object.
LEAST_WEIGHT = 0.1


def paths_from(tree: list[tuple[str, str, float]], start: str) -> list[list[str]]:
    """Paths of a tree's edges from ``start`` to each leaf, in order of names."""
    near: dict[str, list[str]] = {start: []}
    for a, b, _ in tree:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    paths, stack = [], [[start]]
    while stack:
        p = stack.pop()
        further = [n for n in near.get(p[-1], []) if n not in p]
        if further:
            stack += [[*p, n] for n in sorted(further, reverse=True)]
        else:
            paths.append(p)
    return paths


def centroids(df: DataFrame, cluster: str, vec: str) -> dict[str, np.ndarray]:
    rows = df.select(F.col(cluster).cast("string").alias("c"), F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("x")).collect()
    found: dict[str, dict[int, float]] = {}
    for r in rows:
        found.setdefault(r["c"], {})[r["i"]] = r["x"]
    return {c: np.array([v[i] for i in sorted(v)]) for c, v in found.items()}


#: Rows that are projected at a time: their differences to a point stay in a core's cache.
ROWS = 512


def project(x: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arc length of the nearest point of a polyline and the distance to it, for each row; ties go to the earlier segment."""
    at, best = np.zeros(len(x)), np.full(len(x), np.inf)
    for first in range(0, len(x), ROWS):
        part, run = slice(first, first + ROWS), 0.0
        for a, b in zip(line, line[1:] if len(line) > 1 else line):
            length, off = float(np.linalg.norm(b - a)), x[part] - a
            t = np.clip(off @ (b - a) / length**2, 0, 1) if length > 0 else np.zeros(len(off))
            off -= t[:, None] * (b - a)
            d = np.sqrt(np.einsum("ij,ij->i", off, off))
            nearer = d < best[part] - 1e-12
            at[part], best[part], run = np.where(nearer, run + t * length, at[part]), np.where(nearer, d, best[part]), run + length
    return at, best


def lengths(line: np.ndarray) -> np.ndarray:
    """Arc length at each point."""
    return np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(line, axis=0), axis=1))])


def resampled(line: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at even arc lengths."""
    s = lengths(line)
    if s[-1] <= 0:
        return np.repeat(line[:1], n, axis=0)
    return np.stack([np.interp(np.linspace(0, s[-1], n), s, line[:, c]) for c in range(line.shape[1])], axis=1)


def shares(distances: np.ndarray, member: np.ndarray, noise: float) -> np.ndarray:
    """Weight of each lineage (rows) for each object: 1 for the nearest of its lineages, less by squared distance for others.

    ``noise``, the mean square of nearest distances, keeps lineages alike that differ by less than objects scatter.
    """
    d = np.where(member, distances**2, np.inf)
    nearest = d.min(axis=0)
    w = np.where(member, 1.0 if np.isinf(noise) else (nearest + noise + 1e-12) / (d + noise + 1e-12), 0.0)
    return np.where(w >= LEAST_WEIGHT, w, 0.0)


def smoothed(points: np.ndarray, mass: np.ndarray, width: float) -> np.ndarray:
    """Local lines through the bins' means, weighted by mass and a Gaussian of ``width`` bins."""
    held = np.flatnonzero(mass > 0)
    mean, out, at = points[held] / mass[held, None], [], held.astype(float)
    for b in range(held[0], held[-1] + 1):
        k = mass[held] * np.exp(-0.5 * ((at - b) / width) ** 2)
        z = at - b
        s0, s1, s2 = k.sum(), (k * z).sum(), (k * z * z).sum()
        flat = (k[:, None] * mean).sum(axis=0)
        det = s0 * s2 - s1 * s1
        out.append((s2 * flat - s1 * (k * z)[:, None].T @ mean)[0] / det if det > 1e-9 * s0 * max(s2, 1e-12) else flat / s0)
    return np.array(out)


def drawn_together(lines: list[np.ndarray], paths: list[list[str]], centre: dict[str, np.ndarray], bins: int) -> list[np.ndarray]:
    """Curves moved to the mean of those that share their first clusters, wholly before the branch and less and less up to it."""
    out = []
    for n, line in enumerate(lines):
        pull = line.copy()
        for m, path in enumerate(paths):
            shared = next((i for i, (a, b) in enumerate(zip(paths[n], path)) if a != b), min(len(path), len(paths[n])))
            if m == n or not shared:
                continue
            end = float(project(centre[paths[n][shared - 1]][None], line)[0][0])
            other = lines[m]
            s, t = lengths(line), lengths(other)
            mate = np.stack([np.interp(s, t, other[:, c]) for c in range(line.shape[1])], axis=1)
            weight = np.clip(1.0 - np.maximum(s - end / 2, 0) / max(end / 2, 1e-12), 0, 1) if end > 0 else np.zeros(len(s))
            pull += weight[:, None] * ((line + mate) / 2 - line) / max(len(paths) - 1, 1)
        out.append(resampled(pull, bins))
    return out


def fit_curves(df: DataFrame, start: str, cluster: str = "cluster", vec: str = "vec", bins: int = BINS, passes: int = PASSES, width: float = 3.0) -> tuple[list[list[str]], list[np.ndarray], float]:
    """Paths of the lineages, their principal curves of ``bins`` points each, and the mean square of distances to them."""
    paths = paths_from(cluster_tree(df.withColumn(cluster, F.col(cluster).cast("string")), cluster, vec), start)
    centre = centroids(df, cluster, vec)
    lines = [resampled(np.array([centre[c] for c in p]), bins) for p in paths]
    dims = lines[0].shape[1]
    # each row's lineages stand before its vector, so that one array column holds all that a pass needs
    member = [F.col(cluster).cast("string").isin(*p).cast("double") for p in paths]
    rows = df.select(F.concat(F.array(*member), F.col(vec).cast("array<double>")).alias("x"))
    k, noise = len(paths), np.inf
    for _ in range(passes):
        ends = [lengths(line)[-1] for line in lines]
        here = list(lines)

        def binned(block: np.ndarray, here=here, ends=ends, noise=noise) -> np.ndarray:
            inside, x = block[:, :k].T > 0, block[:, k:]
            placed = [project(x, line) for line in here]
            away = np.stack([d for _, d in placed])
            w = shares(away, inside, noise)
            nearest = np.where(inside, away, np.inf).min(axis=0)
            some = np.isfinite(nearest)
            out = np.zeros((k, bins, dims + 1))
            for n, (t, _) in enumerate(placed):
                at = np.minimum((t / max(ends[n], 1e-12) * bins).astype(int), bins - 1)
                for first in range(0, len(x), ROWS):
                    rows = slice(first, first + ROWS)
                    in_bin = (np.arange(bins)[:, None] == at[rows]) * w[n][rows]
                    out[n] += np.column_stack([in_bin @ x[rows], in_bin.sum(axis=1)])
            return np.concatenate([out.ravel(), [(nearest[some] ** 2).sum(), some.sum()]])

        found = _summed(rows, k + dims, k * bins * (dims + 1) + 2, binned)
        sums, noise = found[:-2].reshape(k, bins, dims + 1), float(found[-2] / max(found[-1], 1.0))
        lines = [resampled(smoothed(s[:, :dims], s[:, dims], width), bins) if (s[:, dims] > 0).sum() > 2 else line for s, line in zip(sums, lines)]
        if k > 1:
            lines = drawn_together(lines, paths, centre, bins)
    return paths, lines, noise


def pseudotime(df: DataFrame, paths: list[list[str]], lines: list[np.ndarray], noise: float, cluster: str = "cluster", id_col: str = "object_id", vec: str = "vec") -> DataFrame:
    """id, pseudotime (0 to 1 along the longest curve, weighted over lineages), and of each lineage its time and weight (``lineage_1``, ``weight_1``...).

    Times are arc lengths; those of lineages without a part in the object are NULL.
    """
    k, longest = len(lines), max((lengths(line)[-1] for line in lines), default=0.0) or 1.0
    fields = ", ".join(f"lineage_{n + 1} double, weight_{n + 1} double" for n in range(k))
    member = F.array(*[F.col(cluster).cast("string").isin(*p).cast("double") for p in paths])
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for block in _blocks(b.column(1), k + lines[0].shape[1]):
                inside, x = block[:, :k].T > 0, block[:, k:]
                placed = [project(x, line) for line in lines]
                w, t = shares(np.stack([d for _, d in placed]), inside, noise), np.stack([p for p, _ in placed])
                total = w.sum(axis=0)
                mean = np.divide((w * t).sum(axis=0), total, out=np.zeros(len(x)), where=total > 0) / longest
                cols = [b.column(0).slice(at, len(x)), pa.array(mean, mask=total <= 0)]
                for n in range(k):
                    cols += [pa.array(t[n], mask=w[n] <= 0), pa.array(w[n])]
                at += len(x)
                yield pa.RecordBatch.from_arrays(cols, names=["id", "pseudotime", *[f"{c}_{n + 1}" for n in range(k) for c in ("lineage", "weight")]])

    rows = df.select(F.col(id_col).alias("id"), F.concat(member, F.col(vec).cast("array<double>")).alias("x"))
    return rows.mapInArrow(run, f"id {kind}, pseudotime double, {fields}")


def projected(df: DataFrame, line: np.ndarray, id_col: str = "object_id", vec: str = "vec") -> DataFrame:
    """id, along (arc length of the nearest point of a polyline) and distance."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in _blocks(b.column(1), line.shape[1]):
                along, away = project(x, line)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array(along), pa.array(away)], names=["id", "along", "distance"])
                at += len(x)

    return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, along double, distance double")


def principal_lineages(df: DataFrame, start: str, cluster: str = "cluster", id_col: str = "object_id", vec: str = "vec", bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """Pseudotime and lineages of all objects along principal curves from the cluster ``start``."""
    if df.isEmpty():
        raise ValueError("no rows")
    paths, lines, noise = fit_curves(df, start, cluster, vec, bins, passes)
    return pseudotime(df, paths, lines, noise, cluster, id_col, vec)

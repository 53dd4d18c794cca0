"""Image features: relational ones from pixel tables, geometric ones from masks.

A pixel table has a row per object, channel and pixel: (object_id, round, channel, y, x, value, in_mask).
Sums, moments, quantiles and edges are grouped aggregates in the JVM.  What needs a whole mask at hand
(hull, perimeter, components, skeleton) takes one object's mask at a time through ``masks``; a group is one
object's crop, which has a bound, however many objects a well holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# -- relational features ----------------------------------------------------------------------------------


def mask_geometry(pixels: DataFrame, spacing: float = 1.0, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """keys, area, centroid, box, extent, axes, eccentricity, equivalent diameter of each mask.

    Axes are those of the ellipse with the mask's second central moments (pixels count as unit squares).
    """
    m = pixels.where("in_mask")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    g = m.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(y * y).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
        F.min("y").alias("bbox_top"), F.min("x").alias("bbox_left"), (F.max("y") + 1).alias("bbox_bottom"), (F.max("x") + 1).alias("bbox_right"),
    )
    n, cy, cx = F.col("n"), F.col("sy") / F.col("n"), F.col("sx") / F.col("n")
    a, c, b = F.col("syy") / n - cy * cy + 1 / 12, F.col("sxx") / n - cx * cx + 1 / 12, F.col("sxy") / n - cx * cy
    root = F.sqrt(F.pow((a - c) / 2, 2) + b * b)
    big, small = (a + c) / 2 + root, F.greatest((a + c) / 2 - root, F.lit(0.0))
    s = float(spacing)
    box = (F.col("bbox_bottom") - F.col("bbox_top")) * (F.col("bbox_right") - F.col("bbox_left"))
    return g.select(
        *keys, (n * s * s).alias("area"), cy.alias("centroid_y"), cx.alias("centroid_x"), "bbox_top", "bbox_left", "bbox_bottom", "bbox_right", (box * s * s).alias("bbox_area"), (n / box).alias("extent"),
        (4 * F.sqrt(big) * s).alias("axis_major_length"), (4 * F.sqrt(small) * s).alias("axis_minor_length"), F.sqrt(1 - small / big).alias("eccentricity"), (F.sqrt(4 * n / math.pi) * s).alias("equivalent_diameter"),
        (F.sqrt(small) / F.sqrt(big)).alias("AxisRatio"), ((F.col("bbox_right") - F.col("bbox_left")) / (F.col("bbox_bottom") - F.col("bbox_top"))).alias("aspectRatio"),
    )


def _with_box(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask pixels with their object's y0, y1, x0, x1; an object's crop has a bound, so it is one group."""
    over = Window.partitionBy(*keys)
    return m.dropna(subset=list(keys)).withColumns({f"{c}{i}": f(c).over(over) for c in "yx" for i, f in enumerate((F.min, F.max))})


def raw_moments(pixels: DataFrame, order: int = 3, weighted: bool = False, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """keys and sum of y^p x^q (times value) for p + q up to ``order``, coordinates from the mask's box."""
    # pixels meet their object's corner in one window, not in a join whose side of pixels may be broadcast
    m = _with_box(pixels.where("in_mask"), keys)
    y, x = (F.col("y") - F.col("y0")).cast("double"), (F.col("x") - F.col("x0")).cast("double")
    w = F.col("value") if weighted else F.lit(1.0)
    power = lambda v, k: F.lit(1.0) if k == 0 else (v if k == 1 else F.pow(v, F.lit(float(k))))
    name = "moments_weighted" if weighted else "moments"
    return m.groupBy(*keys).agg(*[F.sum(power(y, p) * power(x, q) * w).alias(f"{name}-{p}-{q}") for p in range(order + 1) for q in range(order + 1 - p)])


def straight_edges(pixels: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """keys, share of each side of the box that the mask lies on, the longest share, all edge pixels over the mask's box."""
    j = _with_box(pixels.where("in_mask"), keys)
    sides = {"top": (F.col("y") == F.col("y0"), True), "bottom": (F.col("y") == F.col("y1"), True), "left": (F.col("x") == F.col("x0"), False), "right": (F.col("x") == F.col("x1"), False)}
    g = j.groupBy(*keys).agg(*[F.count_if(c).alias(f"n_{s}") for s, (c, _) in sides.items()], (F.max("y1") - F.max("y0") + 1).alias("h"), (F.max("x1") - F.max("x0") + 1).alias("w"))
    share = {s: F.col(f"n_{s}") / F.col("w" if wide else "h") for s, (_, wide) in sides.items()}
    return g.select(*keys, *[v.alias(f"StraightEdge_{s}") for s, v in share.items()], F.greatest(*share.values()).alias("StraightEdge_longest_fraction"), (sum(F.col(f"n_{s}") for s in sides) / (2 * (F.col("h") + F.col("w")))).alias("StraightEdge_total_fraction"))


def quantile_name(q: float) -> str:
    """Q and the rounded percentage."""
    return f"Q{round(q * 100)}"


def quantile_names(quantiles: Sequence[float]) -> list[str]:
    out = [quantile_name(q) for q in quantiles]
    if len(set(out)) < len(out):
        raise ValueError(f"quantiles share a name: {out}")
    return out


def intensity_stats(pixels: DataFrame, quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), spacing: float = 1.0, keys: Sequence[str] = ("object_id", "round", "channel")) -> DataFrame:
    """keys and min, mean, max, std, quantiles in the mask; the same where over_threshold (0 if empty), area_T, ratio, potency, asymmetry."""
    names = quantile_names(quantiles)
    m = pixels.where("in_mask")
    over = F.col("over_threshold") if "over_threshold" in pixels.columns else F.lit(False)
    v = F.col("value").cast("double")
    t = F.when(over, v)
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    g = m.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.percentile(v, qs).alias("q"),
        F.count(t).alias("nt"), F.min(t).alias("T_min"), F.avg(t).alias("T_mean"), F.max(t).alias("T_max"), F.stddev_pop(t).alias("T_std"), F.percentile(t, qs).alias("tq"),
        F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.avg(F.when(over, y)).alias("ty"), F.avg(F.when(over, x)).alias("tx"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    area = F.col("nt") * float(spacing) ** 2
    return g.select(
        *keys, "min", "mean", "max", "std", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)],
        *[zero(F.col(f"T_{s}")).alias(f"T_{s}") for s in ("min", "mean", "max", "std")], *[zero(F.get("tq", F.lit(i))).alias(f"T_{n}") for i, n in enumerate(names)],
        area.alias("area_T"), (F.col("nt") / F.col("n")).alias("area_T_ratio"), (F.col("mean") * area).alias("potency"),
        F.coalesce(F.hypot(F.col("cy") - F.col("ty"), F.col("cx") - F.col("tx")) / F.sqrt(F.col("n")), F.lit(1.0)).alias("asymmetry"),
    )


def wide_features(stats: DataFrame, stains: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """Long (keys, feature, value) with names ``R{round}__{stain}_{statistic}``; stains: (round, channel, stain), gaps dropped."""
    values = [c for c in stats.columns if c not in (*keys, "round", "channel")]
    named = stats.join(F.broadcast(stains.where("stain <> ''")), ["round", "channel"])
    pairs = F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).cast("double").alias("v")) for c in values])
    each = named.select(*keys, "round", "stain", F.explode(pairs).alias("p"))
    return each.select(*keys, F.concat(F.lit("R"), F.col("round").cast("string"), F.lit("__"), F.col("stain"), F.lit("_"), F.col("p.s")).alias("feature"), F.col("p.v").alias("value"))


# -- numerics on one crop ---------------------------------------------------------------------------------


def gaussian_blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, four sigmas wide, reflected at the edges."""
    if sigma <= 0:
        return img.astype(float)
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p, n = np.pad(out, pad, mode="symmetric"), out.shape[axis]
        # a shifted copy of the whole image for each tap
        out = sum(w * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, w in enumerate(k))
    return out


def triangle_threshold(values: np.ndarray, bins: int = 256) -> float:
    """Zack's triangle: the bin farthest from the line between the histogram's peak and its longer tail's end."""
    h, edges = np.histogram(values, bins=bins)
    mid = (edges[:-1] + edges[1:]) / 2
    used = np.flatnonzero(h)
    if len(used) < 2:
        return float(mid[used[0]]) if len(used) else 0.0
    peak, lo, hi = int(h.argmax()), int(used[0]), int(used[-1])
    flip = peak - lo >= hi - peak
    a, b = (lo, peak) if flip else (peak, hi)
    i = np.arange(a, b + 1)
    ya, yb = (h[a], h[b])
    d = np.abs((yb - ya) * i - (b - a) * h[a : b + 1] + b * ya - yb * a)
    return float(mid[i[int(d.argmax())]])


def label(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected components numbered from 1, by growing runs row by row with a union-find."""
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int64)
    root = [0]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = int(diagonal)
    before: list[tuple[int, int, int]] = []
    for y in range(h):
        d = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        now = []
        for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)):
            mine = 0
            for ps, pe, pl in before:
                if ps < e + reach and pe > s - reach:
                    r = find(pl)
                    if not mine:
                        mine = r
                    elif r != mine:
                        lo, hi = sorted((mine, r))
                        root[hi] = lo
                        mine = lo
            if not mine:
                mine = len(root)
                root.append(mine)
            out[y, s:e] = mine
            now.append((int(s), int(e), mine))
        before = now
    roots = np.array([find(i) for i in range(len(root))])
    kept = np.unique(roots[1:])
    number = np.zeros(len(root), dtype=np.int64)
    number[kept] = np.arange(1, len(kept) + 1)
    return number[roots][out], len(kept)


def hull_points(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise."""
    p = sorted(map(tuple, np.unique(points, axis=0)))
    if len(p) < 3:
        return np.array(p, dtype=float)

    def half(seq: Iterator) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(iter(p)) + half(iter(p[::-1])), dtype=float)


def _corners(mask: np.ndarray) -> np.ndarray:
    """Corners of the first and last pixel of each row: no other corner is on the hull."""
    y = np.flatnonzero(mask.any(axis=1))
    first, last = mask[y].argmax(axis=1), mask.shape[1] - mask[y][:, ::-1].argmax(axis=1)
    return np.concatenate([np.stack([y + a, x], axis=1) for a in (0, 1) for x in (first, last)])


def polygon_area(p: np.ndarray) -> float:
    return 0.5 * abs(float((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum())) if len(p) > 2 else 0.0


def hull_mask(mask: np.ndarray, hull: np.ndarray | None = None) -> np.ndarray:
    """Pixels whose centre lies in the hull of the mask's pixel squares."""
    p = hull_points(_corners(mask)) if hull is None else hull
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]] + 0.5
    inside = np.ones(mask.shape, dtype=bool)
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        inside &= (b[0] - a[0]) * (xx - a[1]) - (b[1] - a[1]) * (yy - a[0]) >= -1e-9
    return inside | mask


def perimeter(mask: np.ndarray) -> float:
    """Crofton's estimate from four directions: crossings along rows, columns and diagonals."""
    m = np.pad(mask.astype(np.int8), 1)
    n0, n90 = np.abs(np.diff(m, axis=1)).sum(), np.abs(np.diff(m, axis=0)).sum()
    n45, n135 = np.abs(m[1:, 1:] - m[:-1, :-1]).sum(), np.abs(m[1:, :-1] - m[:-1, 1:]).sum()
    return float(math.pi / 8 * (n0 + n90 + (n45 + n135) / math.sqrt(2)))


def feret(mask: np.ndarray, hull: np.ndarray | None = None) -> float:
    """Largest distance between corners of the hull."""
    p = hull_points(_corners(mask)) if hull is None else hull
    return float(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)).max()) if len(p) else 0.0


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest pixel outside.

    Distances along columns come from one pass down and one up; each is then seen from as many columns to the
    left and right as the largest distance found so far reaches.
    """
    m = np.pad(mask, 1)
    far = m.shape[0] + m.shape[1]
    down, up = np.where(m, far, 0), np.where(m, far, 0)
    for y in range(1, len(m)):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
        up[-1 - y] = np.minimum(up[-1 - y], up[-y] + 1)
    column = np.minimum(down, up).astype(float) ** 2
    out, d = column.copy(), 1
    while d * d < out.max():
        out[:, d:] = np.minimum(out[:, d:], column[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], column[:, d:] + d * d)
        d += 1
    return np.sqrt(out)[1:-1, 1:-1]


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton (Zhang and Suen 1984)."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        gone = False
        for odd in (0, 1):
            p = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            n = sum(x.astype(int) for x in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if not odd else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            cut = (m[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & (a == 0) & (b == 0)
            if cut.any():
                m[1:-1, 1:-1][cut] = 0
                gone = True
        if not gone:
            return m[1:-1, 1:-1].astype(bool)


def branches(skeleton: np.ndarray) -> list[np.ndarray]:
    """Pixel chains between ends and junctions of a skeleton, each as ordered (y, x)."""
    s = np.pad(skeleton, 1)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    near.sort(key=lambda d: abs(d[0]) + abs(d[1]))
    degree = sum(np.roll(s, d, (0, 1)) for d in near) * s
    body = s & (degree <= 2)
    comp, n = label(body, diagonal=True)
    out = []
    for i in range(1, n + 1):
        pts = set(map(tuple, np.argwhere(comp == i)))
        ends = [p for p in pts if sum((p[0] + a, p[1] + b) in pts for a, b in near) <= 1] or [min(pts)]
        chain, left = [min(ends)], pts - {min(ends)}
        while nxt := next(((chain[-1][0] + a, chain[-1][1] + b) for a, b in near if (chain[-1][0] + a, chain[-1][1] + b) in left), None):
            chain.append(nxt)
            left.discard(nxt)
        out.append(np.array(chain) - 1)
    return out


def crypt_features(mask: np.ndarray, spacing: float = 1.0, sigma: float = 3.0, radius_multiplier: float = 0.5, window: int = 50) -> dict[str, float]:
    """Branches of the skeleton outside the central disc: number, mean and largest length, total length.

    The smoothed mask is thinned; a disc around the deepest point (radius a share of the inscribed circle's)
    is taken out; what is left in one piece is a branch, which is prolonged at its outer end, in the direction
    of its last ``window`` pixels, to the border of the mask.
    """
    zero = {"crypt_count": 0.0, "crypt_length_mean": 0.0, "crypt_length_max": 0.0, "crypt_length_sum": 0.0}
    if not mask.any():
        return zero
    smooth = gaussian_blur(mask.astype(float), sigma) > 0.5
    if not smooth.any():
        return zero
    depth = distance_transform(smooth)
    cy, cx = np.unravel_index(int(depth.argmax()), depth.shape)
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    disc = np.hypot(yy - cy, xx - cx) <= depth.max() * radius_multiplier
    lengths = []
    for chain in branches(thin(smooth) & ~disc):
        if len(chain) < 3:
            continue
        out = np.hypot(*(chain - (cy, cx)).T)
        if out[0] > out[-1]:
            chain, out = chain[::-1], out[::-1]
        if out[-1] - out[0] < 2:
            continue
        step = np.hypot(*np.diff(chain, axis=0).T).sum()
        d = (chain[-1] - chain[max(0, len(chain) - window)]).astype(float)
        d /= np.linalg.norm(d) or 1.0
        p, more = chain[-1].astype(float), 0.0
        while True:
            q = p + d
            i, j = int(round(q[0])), int(round(q[1]))
            if not (0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j]):
                break
            p, more = q, more + 1.0
        lengths.append((step + more) * spacing)
    if not lengths:
        return zero
    return {"crypt_count": float(len(lengths)), "crypt_length_mean": float(np.mean(lengths)), "crypt_length_max": float(max(lengths)), "crypt_length_sum": float(sum(lengths))}


def shape_features(mask: np.ndarray, spacing: float = 1.0, min_share: float = 0.005) -> dict[str, float]:
    """Hull area, solidity, perimeter, Feret diameter, circularity, concavity, count of concavities, asymmetry."""
    area = float(mask.sum())
    if not area:
        return dict.fromkeys(("area_convex", "solidity", "perimeter", "feret_diameter_max", "circularity", "concavity", "concavity_count", "asymmetry"), 0.0)
    corners = hull_points(_corners(mask))
    hull = polygon_area(corners)
    per = perimeter(mask)
    filled = hull_mask(mask, corners)
    gap = filled & ~mask
    parts, n = label(gap)
    sizes = np.bincount(parts.ravel())[1:] if n else np.zeros(0)
    cy, cx = np.argwhere(mask).mean(0)
    hy, hx = np.argwhere(filled).mean(0)
    s = spacing
    return {
        "area_convex": hull * s * s, "solidity": area / hull, "perimeter": per * s, "feret_diameter_max": feret(mask, corners) * s, "circularity": 4 * math.pi * area / per**2,
        "concavity": float(gap.sum() / filled.sum()), "concavity_count": float((sizes > min_share * area).sum()), "asymmetry": float(math.hypot(cy - hy, cx - hx) / math.sqrt(area)),
    }


def substructures(over: np.ndarray, spacing: float = 1.0) -> dict[str, float]:
    """Components of a thresholded mask: number and mean size."""
    parts, n = label(over)
    return {"substructures_count": float(n), "substructures_size": float(over.sum()) * spacing**2 / n if n else 0.0}


# -- one object at a time ---------------------------------------------------------------------------------


def _grid(pdf: Mapping, column: str, fill: float = 0.0) -> np.ndarray:
    y, x = np.asarray(pdf["y"]), np.asarray(pdf["x"])
    out = np.full((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), fill, dtype=float)
    out[y - y.min(), x - x.min()] = pdf[column]
    return out


def per_object(pixels: DataFrame, fn: Callable[[np.ndarray], dict[str, float]], names: Sequence[str], pad: int = 20, key: str = "object_id") -> DataFrame:
    """key and the named features of each object's padded mask.  Masks of several pieces are skipped."""
    m = pixels.where("in_mask").select(key, "y", "x").distinct().withColumn("v", F.lit(1.0))
    kind = dict(pixels.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.pad(_grid(pdf, "v") > 0, pad)
        if label(mask, diagonal=True)[1] != 1:
            return pd.DataFrame(columns=[key, *names])
        got = fn(mask)
        return pd.DataFrame([{key: pdf[key].iloc[0]} | {n: got[n] for n in names}])

    return m.groupBy(key).applyInPandas(one, f"{key} {kind}, " + ", ".join(f"`{n}` double" for n in names))


SHAPE = ("area_convex", "solidity", "perimeter", "feret_diameter_max", "circularity", "concavity", "concavity_count", "asymmetry")
CRYPTS = ("crypt_count", "crypt_length_mean", "crypt_length_max", "crypt_length_sum")


def morphology(pixels: DataFrame, spacing: float = 1.0, sigma: float = 3.0, skeleton: bool = True) -> DataFrame:
    """object_id with all relational and geometric mask features."""
    rel = mask_geometry(pixels.select("object_id", "y", "x", "in_mask").distinct(), spacing)

    def both(mask: np.ndarray) -> dict[str, float]:
        return shape_features(mask, spacing) | (crypt_features(mask, spacing, sigma) if skeleton else {})

    return rel.join(per_object(pixels, both, [*SHAPE, *(CRYPTS if skeleton else ())]), "object_id", "left")


def over_threshold(pixels: DataFrame, thresholds: DataFrame, sigma: float = 3.0) -> DataFrame:
    """``pixels`` with over_threshold: blurred value inside the mask above the channel's threshold; stains come from (round, channel, final)."""
    t = thresholds.select("round", "channel", F.col("final").cast("double").alias("__final"))
    joined = pixels.join(F.broadcast(t), ["round", "channel"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        img = gaussian_blur(_grid(pdf, "value"), sigma)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        top = pdf["__final"].iloc[0]
        over = (img[y - y.min(), x - x.min()] > top) & pdf["in_mask"].to_numpy() if pd.notna(top) else np.zeros(len(pdf), dtype=bool)
        return pdf.assign(over_threshold=over)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", over_threshold boolean"
    return joined.groupBy("object_id", "round", "channel").applyInPandas(one, schema).drop("__final")


def estimate_thresholds(pixels: DataFrame, stains: DataFrame, q: float = 0.5, sigma: float = 3.0) -> DataFrame:
    """round, stain, channel, raw (each object's triangle threshold), final (their quantile).

    ``pixels`` holds a sample of objects (``sampling.sample_per_group``), which bounds ``raw``.  An object's crop is
    one row of arrays; a panel has one row a round and channel.
    """
    named = pixels.join(F.broadcast(stains.where("stain <> ''")), ["round", "channel"])
    spot = F.struct("y", "x", F.col("value").cast("double").alias("value"))
    crops = named.groupBy("object_id", "round", "channel").agg(F.min("stain").alias("stain"), F.collect_list(spot).alias("at"))
    kind = dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.column("at"):
                y, x, value = (row.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "value"))
                found.append(triangle_threshold(gaussian_blur(_grid({"y": y, "x": x, "value": value}, "value"), sigma).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("round", "stain", "channel")), pa.array(found, pa.float64())], names=["round", "stain", "channel", "t"])

    each = crops.select("round", "stain", "channel", "at").mapInArrow(run, f"round {kind['round']}, stain string, channel {kind['channel']}, t double")
    return each.groupBy("round", "stain", "channel").agg(F.array_sort(F.collect_list("t")).alias("raw"), F.percentile("t", q).alias("final"))

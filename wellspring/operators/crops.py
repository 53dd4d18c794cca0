"""Image features of crops held as array columns.

A crop is a row: (object_id, round, top, left, height, width, mask, channels, values); ``mask`` has a boolean a
pixel, row after row, ``values`` an array of pixels for each of ``channels``.  Crops travel as they are: all rounds
of an object meet in one row, and one pass of Arrow batches gives every feature of it; pixels are never rows.  A
row is bounded by an object's crop, its rounds and channels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .image import CRYPTS, SHAPE, crypt_features, gaussian_blur, label, quantile_names, shape_features, substructures

CROP = "round int, top int, left int, height int, width int, mask array<boolean>, channels array<int>, values array<array<double>>"
COLUMNS = tuple(c.split()[0] for c in CROP.split(", ")[:6]) + ("channels", "values")


def assemble(pixels: DataFrame) -> DataFrame:
    """Crops of a pixel table (object_id, round, channel, y, x, value, in_mask): its one regrouping; pixels that are missing are outside and 0."""
    kind = dict(pixels.dtypes)["object_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        top, left = int(y.min()), int(x.min())
        h, w = int(y.max()) - top + 1, int(x.max()) - left + 1
        at = (y - top) * w + x - left
        mask = np.zeros(h * w, dtype=bool)
        mask[at[pdf["in_mask"].to_numpy(dtype=bool)]] = True
        channels = sorted(set(pdf["channel"].tolist()))
        planes = np.zeros((len(channels), h * w))
        planes[np.searchsorted(channels, pdf["channel"]), at] = pdf["value"]
        return pd.DataFrame([{"object_id": pdf["object_id"].iloc[0], "round": int(pdf["round"].iloc[0]), "top": top, "left": left, "height": h, "width": w, "mask": mask, "channels": channels, "values": list(planes)}])

    cols = pixels.select("object_id", "round", "channel", "y", "x", F.col("value").cast("double").alias("value"), "in_mask")
    return cols.groupBy("object_id", "round").applyInPandas(one, f"object_id {kind}, {CROP}")


@dataclass
class Crop:
    """A round of an object."""

    round: int
    top: int
    left: int
    mask: np.ndarray
    planes: dict[str, np.ndarray]  # by stain
    limits: dict[str, float | None]


def geometry(mask: np.ndarray, top: int, left: int, spacing: float) -> dict[str, float]:
    """Area, box, centroid and the axes of the ellipse with the mask's second moments (pixels count as unit squares)."""
    y, x = np.nonzero(mask)
    n, s = float(len(y)), float(spacing)
    if not n:
        return {}
    y, x = y + float(top), x + float(left)
    a, c, b = y.var() + 1 / 12, x.var() + 1 / 12, ((y - y.mean()) * (x - x.mean())).mean()
    root = math.hypot((a - c) / 2, b)
    big, small = (a + c) / 2 + root, max((a + c) / 2 - root, 0.0)
    h, w = y.max() - y.min() + 1, x.max() - x.min() + 1
    return {
        "area": n * s * s, "centroid_y": y.mean(), "centroid_x": x.mean(), "bbox_top": y.min(), "bbox_left": x.min(), "bbox_bottom": y.max() + 1, "bbox_right": x.max() + 1, "bbox_area": h * w * s * s, "extent": n / (h * w),
        "axis_major_length": 4 * math.sqrt(big) * s, "axis_minor_length": 4 * math.sqrt(small) * s, "eccentricity": math.sqrt(max(0.0, 1 - small / big)), "equivalent_diameter": math.sqrt(4 * n / math.pi) * s,
        "AxisRatio": math.sqrt(small) / math.sqrt(big), "aspectRatio": w / h,
    }


def tight(mask: np.ndarray) -> np.ndarray:
    """The mask's box."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return mask[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else mask[:0, :0]


def shapes(mask: np.ndarray, spacing: float, sigma: float, skeleton: bool) -> dict[str, float | None]:
    """Hull, outline and crypts of a mask of one piece; None for others."""
    padded = np.pad(tight(mask), 20)
    if label(padded, diagonal=True)[1] != 1:
        return dict.fromkeys((*SHAPE, *(CRYPTS if skeleton else ())))
    return shape_features(padded, spacing) | (crypt_features(padded, spacing, sigma) if skeleton else {})


def _spread(v: np.ndarray, quantiles: Sequence[float], names: Sequence[str], prefix: str) -> dict[str, float]:
    if not len(v):
        return dict.fromkeys((f"{prefix}{n}" for n in ("min", "mean", "max", "std", *names)), 0.0)
    q = np.quantile(v, quantiles) if len(names) else []
    return {f"{prefix}min": v.min(), f"{prefix}mean": v.mean(), f"{prefix}max": v.max(), f"{prefix}std": v.std(), **{f"{prefix}{n}": x for n, x in zip(names, q)}}


def intensities(img: np.ndarray, mask: np.ndarray, over: np.ndarray, quantiles: Sequence[float], spacing: float) -> dict[str, float]:
    """Statistics in the mask and where the blurred value is over the threshold, and components of the latter."""
    names = quantile_names(quantiles)
    n, nt = int(mask.sum()), int(over.sum())
    if not n:
        return {}
    out = _spread(img[mask], quantiles, names, "") | _spread(img[over], quantiles, names, "T_")
    area, off = nt * spacing**2, 1.0
    if nt:
        (cy, cx), (ty, tx) = np.argwhere(mask).mean(axis=0), np.argwhere(over).mean(axis=0)
        off = math.hypot(cy - ty, cx - tx) / math.sqrt(n)
    return out | {"area_T": area, "area_T_ratio": nt / n, "potency": out["mean"] * area, "asymmetry": off} | substructures(tight(over), spacing)


def correlations(rounds: Sequence[Crop]) -> dict[str, float | None]:
    """Pearson correlation of each pair of stains of all rounds over the pixels that both rounds' masks hold: a Gram matrix a pair of rounds.

    None where a stain is constant there.
    """
    out: dict[str, float | None] = {}
    for i, a in enumerate(rounds):
        for b in rounds[i:]:
            y0, x0 = max(a.top, b.top), max(a.left, b.left)
            y1 = min(a.top + a.mask.shape[0], b.top + b.mask.shape[0])
            x1 = min(a.left + a.mask.shape[1], b.left + b.mask.shape[1])
            if y1 <= y0 or x1 <= x0:
                continue
            cut = lambda c, img: img[y0 - c.top : y1 - c.top, x0 - c.left : x1 - c.left]  # noqa: B023, E731
            both = cut(a, a.mask) & cut(b, b.mask)
            if not both.any():
                continue
            left = {f"R{a.round}__{s}": cut(a, p)[both] for s, p in a.planes.items()}
            all_planes = left | ({f"R{b.round}__{s}": cut(b, p)[both] for s, p in b.planes.items()} if b is not a else {})
            names = sorted(all_planes)
            x = np.stack([all_planes[n] for n in names])
            flat = x.max(axis=1) == x.min(axis=1)
            x = x - x.mean(axis=1, keepdims=True)
            gram = x @ x.T
            norm = np.sqrt(np.diag(gram))
            for p in range(len(names)):
                for q in range(p + 1, len(names)):
                    if b is a or (names[p] in left) != (names[q] in left):
                        out[f"{names[p]}--{names[q]}_PearsonR"] = None if flat[p] or flat[q] else float(gram[p, q] / (norm[p] * norm[q]))
    return out


def pieces(crops: DataFrame, diagonal: bool = True) -> DataFrame:
    """object_id, round and the number of connected pieces of each crop's mask."""
    kind = dict(crops.dtypes)["object_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = zip(b.column("height").to_pylist(), b.column("width").to_pylist())
            n = [label(b.column("mask")[i].values.to_numpy(zero_copy_only=False).astype(bool).reshape(hw), diagonal)[1] for i, hw in enumerate(size)]
            yield pa.RecordBatch.from_arrays([b.column("object_id"), b.column("round"), pa.array(n, pa.int32())], names=["object_id", "round", "pieces"])

    return crops.select("object_id", "round", "height", "width", "mask").mapInArrow(run, f"object_id {kind}, round int, pieces int")


def rounds_of_objects(crops: DataFrame, panel: DataFrame) -> DataFrame:
    """object_id and its rounds in order, each with its stains; panel: (round, channel, stain, final)."""
    named = panel.where("stain <> ''").groupBy("round").agg(F.array_sort(F.collect_list(F.struct("channel", "stain", F.col("final").cast("double").alias("final")))).alias("panel"))
    met = crops.select("object_id", *COLUMNS).join(F.broadcast(named), "round", "left")  # a row a round
    return met.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct(*COLUMNS, "panel"))).alias("rounds"))


def _crops(rounds: pa.StructArray) -> list[Crop]:
    """The crops of an object; pixels come as views of the Arrow buffers."""
    out = []
    plain = [rounds.field(c).to_pylist() for c in ("round", "top", "left", "height", "width", "channels", "panel")]
    for n, (number, top, left, h, w, channels, panel) in enumerate(zip(*plain)):
        mask = rounds.field("mask")[n].values.to_numpy(zero_copy_only=False).astype(bool).reshape(h, w)
        planes = rounds.field("values")[n].values
        of = {c: planes[i].values.to_numpy(zero_copy_only=False).reshape(h, w) for i, c in enumerate(channels)}
        used = [p for p in panel or [] if p["channel"] in of]
        out.append(Crop(number, top, left, mask, {p["stain"]: of[p["channel"]] for p in used}, {p["stain"]: p["final"] for p in used}))
    return out


def features(crops: DataFrame, panel: DataFrame, quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), sigma: float = 3.0, spacing: float = 1.0, skeleton: bool = True, shape: bool = True, correlate: bool = True, intensity: bool = True) -> DataFrame:
    """Long features (object_id, feature, value) of all crops: shapes of the lowest round's mask, statistics of each stain, correlations of stains.

    panel: (round, channel, stain, final); channels without a stain are left out, a stain without a threshold has
    nothing over it.  An empty mask has no features.
    """
    quantile_names(quantiles)
    kind = dict(crops.dtypes)["object_id"]

    def of_object(rounds: list[Crop]) -> dict[str, float | None]:
        out: dict[str, float | None] = {}
        first = rounds[0]
        if shape and (found := geometry(first.mask, first.top, first.left, spacing)):
            out |= found | shapes(first.mask, spacing, sigma, skeleton)
        for c in rounds if intensity else ():
            for stain, img in c.planes.items():
                top = c.limits[stain]
                over = (gaussian_blur(img, sigma) > top) & c.mask if top is not None else np.zeros_like(c.mask)
                out |= {f"R{c.round}__{stain}_{k}": v for k, v in intensities(img, c.mask, over, quantiles, spacing).items()}
        return out | (correlations(rounds) if correlate else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                found = of_object(_crops(b.column("rounds")[row].values))
                ids = pa.array([b.column("object_id")[row].as_py()] * len(found), b.schema.field("object_id").type)
                values = [None if v is None else float(v) for v in found.values()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.string()), pa.array(values, pa.float64())], names=["object_id", "feature", "value"])

    return rounds_of_objects(crops, panel).mapInArrow(run, f"object_id {kind}, feature string, value double")

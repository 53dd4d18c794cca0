"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(w.x - t_k)): one weight vector over hashed text, shared by all grades, and
ordered thresholds t_1 < t_2 < ...  (kept ordered by fitting the first and the logarithms of the gaps).  The
expected grade ranks documents; the tail probability P(grade >= wanted) selects them.

Features are hashes of byte runs of 2 and 4, each text's counts damped by a square root and scaled to unit
length, so a long text weighs as much as a short one.  Hashing runs over whole texts with NumPy.

How it scales.  The fit uses at most ``sample`` labelled documents, drawn by a hash of the id, of at most
``most_bytes`` of features (documented bounds).  It runs on the driver by limited-memory BFGS until it has
converged, some fifty passes over those features; the weights (``2**bits`` floats) go to the tasks, and scoring is one pass over
whole texts with no shuffle.  Any number of grades from two on is fitted; a single grade gives that grade.

Defined results.  Null text counts as empty, whose score is that of no features.  Null ids, repeated rows
and ties pass through; labels without id or grade are left out; other columns are ignored.  Without any
label everything is kept with a null grade.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, labelled_sample, map_batches, materialize

BITS = 16
SAMPLE = 6_000
SAMPLE_BYTES = 128 << 20
RUNS = (2, 4)
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and weights (unit length) of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint64(64 - bits)
    for at in range(0, len(raw), CHUNK):
        b = raw[at : at + CHUNK + max(RUNS) - 1].astype(np.uint64)
        codes = []
        for n in RUNS:
            m = min(CHUNK, len(b) - n + 1)
            if m > 0:
                code = b[:m]
                for k in range(1, n):
                    code = (code << np.uint64(8)) | b[k : k + m]
                codes.append(((code + np.uint64(n)) * _MIX >> shift).astype(np.int64))
        if codes:
            found = np.bincount(np.concatenate(codes), minlength=1 << bits)
            total = found if at == 0 else total + found
    idx = np.flatnonzero(total)
    val = np.sqrt(total[idx].astype(np.float64))
    return idx, val / (np.sqrt((val * val).sum()) or 1.0)


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for each grade g but the lowest."""
        idx, val = hashed(text, self.bits)
        z = float(self.weights[idx] @ val) - self.thresholds
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, flat: float = 1e-5, steps: int = 1000, memory: int = 8) -> np.ndarray:
    """Minimum of a smooth function by limited-memory BFGS: until no slope exceeds ``flat`` or the value stands still."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() <= flat:
            break
        d, scale = -g, []
        for s, y, r in reversed(past):
            scale.append(r * (s @ d))
            d = d - scale[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), c in zip(past, reversed(scale)):
            d = d + (c - r * (y @ d)) * s
        slope = g @ d
        if slope >= 0:
            past, d, slope = [], -g, -(g @ g)
        step = 1.0 if past else min(1.0, 1.0 / np.abs(g).max())
        while True:
            f1, g1 = loss(x + step * d)
            if f1 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step *= 0.5
        s, y = step * d, g1 - g
        still = f - f1 <= 1e-10 * max(1.0, abs(f))
        x, f, g = x + s, f1, g1
        if still:
            break
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1.0 / (s @ y))]
    return x


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int = BITS, l2: float = 3e-5) -> OrdinalModel:
    """Maximum likelihood with a ridge over sparse rows, to convergence."""
    levels = np.unique(grades)
    k = np.searchsorted(levels, grades)
    size = 1 << bits
    if len(levels) < 2:
        return OrdinalModel(tuple(int(x) for x in levels), np.zeros(size, dtype=np.float32), np.zeros(0), bits)
    # rows stay in blocks, so that what a step needs besides the data is a block's worth
    blocks = []
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        count = np.array([len(r[0]) for r in part])
        blocks.append((slice(at, at + len(part)), np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]).astype(np.float32), count))
    n, cuts = len(rows), len(levels) - 1
    share = np.cumsum(np.bincount(k, minlength=cuts + 1))[:-1] / n
    start = np.log(share / (1 - share))
    sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

    def thresholds(theta: np.ndarray) -> np.ndarray:
        return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = x[:size], x[size:]
        t, z, w32 = thresholds(theta), np.zeros(n), w.astype(np.float32)
        for own, idx, val, count in blocks:  # a row may be empty, so sums are by row number
            z[own] = np.bincount(np.repeat(np.arange(len(count)), count), weights=val * w32[idx], minlength=len(count))
        up = np.where(k < cuts, sig(t[np.minimum(k, cuts - 1)] - z), 1.0)  # P(grade <= k)
        down = np.where(k > 0, sig(t[np.maximum(k - 1, 0)] - z), 0.0)
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        gz = ((du - dd) / n).astype(np.float32)  # derivative of -log p by z
        gw = l2 * w
        for own, idx, val, count in blocks:
            gw += np.bincount(idx, weights=val * np.repeat(gz[own], count), minlength=size)
        gt = np.bincount(np.minimum(k, cuts - 1), weights=np.where(k < cuts, -du, 0.0) / n, minlength=cuts)
        gt += np.bincount(np.maximum(k - 1, 0), weights=np.where(k > 0, dd, 0.0) / n, minlength=cuts)
        back = np.cumsum(gt[::-1])[::-1]
        return float(-np.log(p).mean() + 0.5 * l2 * (w @ w)), np.concatenate([gw, [back[0]], back[1:] * np.exp(theta[1:])])

    x = lbfgs(loss, np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))]))
    return OrdinalModel(tuple(int(x) for x in levels), x[:size].astype(np.float32), thresholds(x[size:]), bits)


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", where: Column | None = None, sample: int = SAMPLE, bits: int = BITS, most_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents whose features take at most ``most_bytes``.

    Features are made where the texts are and stored; documents come to the driver in the order of the draw
    until the bytes are used up.
    """
    drawn = labelled_sample(docs, labels, [grade], sample, where)

    def make(b: pa.RecordBatch) -> dict:
        rows = [hashed(t, bits) for t in b.column(1).to_pylist()]
        idx = [r[0].astype("<u2" if bits <= 16 else "<u4").tobytes() for r in rows]
        val = [r[1].astype("<f2").tobytes() for r in rows]
        return {"doc_id": b.column(0), "grade": b.column(2), "size": [len(i) + len(v) for i, v in zip(idx, val)], "idx": idx, "val": val}

    made = map_batches(drawn.select("doc_id", "text", F.col(grade).cast("int").alias("grade")), "doc_id long, grade int, size long, idx binary, val binary", make)
    made = materialize(made, "features")
    # a running sum over at most ``sample`` pairs of numbers
    used = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id", F.lit(0)), "doc_id"))
    fits = made.select("doc_id", used.alias("used")).where(F.col("used") <= most_bytes).select("doc_id")
    got = sorted(made.join(F.broadcast(fits), "doc_id").select("doc_id", "grade", "idx", "val").collect(), key=lambda r: r["doc_id"])
    discard(made)
    rows = [(np.frombuffer(r["idx"], "<u2" if bits <= 16 else "<u4"), np.frombuffer(r["val"], "<f2").astype(np.float32)) for r in got]
    return fit_ordinal(rows, np.array([r["grade"] for r in got], dtype=np.int64), bits)


def score(docs: DataFrame, model: OrdinalModel, wanted: int | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_prob (of ``wanted``, else the highest grade) and keep."""
    cols = [c for c in docs.columns if c not in ("expected_grade", "tail_prob", "keep")]
    docs = docs.select(*cols)
    grades = np.array(model.grades, dtype=np.float64)
    pick = len(grades) - 2 if wanted is None else int(np.searchsorted(grades, wanted)) - 1
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def one(b: pa.RecordBatch) -> dict:
        out: dict = {c: b.column(c) for c in cols}
        if len(grades) < 2:
            return out | {"expected_grade": [float(grades[0]) if len(grades) else None] * b.num_rows, "tail_prob": [None] * b.num_rows, "keep": [True] * b.num_rows}
        tails = [sent.value.tails(t) for t in b.column("text").to_pylist()]
        tail = [float(t[pick]) if pick >= 0 else 1.0 for t in tails]
        return out | {"expected_grade": [float(grades[0] + t @ np.diff(grades)) for t in tails], "tail_prob": tail, "keep": [x >= least for x in tail]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, schema + ", expected_grade double, tail_prob double, keep boolean", one)


def keep_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose probability of the highest grade is at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(sent.value.grades) < 2:
                yield b
            else:
                yield b.filter(pa.array([bool(sent.value.tails(t)[-1] >= least) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

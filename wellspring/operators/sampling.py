"""Samples that are exact in number and repeatable: rows are ordered by a hash of seed and id.

A sample is a filter at the hash of its last row, which ``ranking`` finds, so no task holds the sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_rows, repeatable_draw


def sample_n(df: DataFrame, n: int, id_col: str = "object_id", seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return first_rows(df, n, repeatable_draw(id_col, seed), id_col)


def sample_fraction(df: DataFrame, fraction: float, id_col: str = "object_id", seed: int = 0) -> DataFrame:
    """max(1, fraction of the rows rounded half to even) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction lies in (0, 1]")
    return sample_n(df, max(1, round(fraction * df.count())), id_col, seed)


def sample_per_group(df: DataFrame, n: int, keys: Sequence[str], id_col: str = "object_id", seed: int = 0) -> DataFrame:
    """Up to n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(repeatable_draw(id_col, seed), id_col)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def geometric_sketch(df: DataFrame, n: int, vec: str = "vec", id_col: str = "object_id", seed: int = 0, steps: int = 24) -> DataFrame:
    """About evenly spread rows: cells of a grid as wide as n occupied cells allow, one row of each in turn.

    The cell size is found by bisection; each step counts distinct cells (one shuffle of cell codes).
    """
    dims = range(df.select(F.size(vec)).first()[0])
    ends = df.agg(*[f(F.get(vec, F.lit(i))).alias(f"{k}{i}") for i in dims for k, f in (("lo", F.min), ("hi", F.max))]).first()
    span = max((ends[f"hi{i}"] - ends[f"lo{i}"] for i in dims), default=1.0) or 1.0
    cell = lambda size: F.concat_ws(",", *[F.floor((F.get(vec, F.lit(i)) - ends[f"lo{i}"]) / size) for i in dims])
    lo, hi = 1e-6, 1.0
    for _ in range(steps):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if df.select(F.count_distinct(cell(mid * span))).first()[0] > n else (lo, mid)
    turn = F.row_number().over(Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col))
    return df.withColumn("__cell", cell(hi * span)).withColumn("__turn", turn).orderBy("__turn", F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n).drop("__cell", "__turn")

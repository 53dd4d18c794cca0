"""Tables behind the usual figures; drawing is left to the reader's own tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import well_col, well_row
from .ranking import quantiles


def plate_map(wells: DataFrame, value: str = "value", outlined: str = "outlined", row: Callable[[Column], Column] = well_row, col: Callable[[Column], Column] = well_col) -> DataFrame:
    """plate, row, col (from 0, as ``row`` and ``col`` read them off a well's name), value, outlined of each well."""
    return wells.select("plate", row(F.col("well")).alias("row"), col(F.col("well")).alias("col"), F.col(value).alias("value"), F.col(outlined).alias("outlined"))


def position_density(objects: DataFrame, bins: int = 40, x: str = "cx_um", y: str = "cy_um") -> DataFrame:
    """plate, row, col, n: two-dimensional histogram of positions; needs width and height."""
    at = lambda p, size: F.floor(F.least(F.col(p) / F.col(size), F.lit(0.999999)) * bins).cast("int")
    return objects.groupBy("plate", at(y, "height").alias("row"), at(x, "width").alias("col")).agg(F.count("*").alias("n"))


def colour_limits(long: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feature and its lower and upper percentile."""
    return quantiles(long, "value", (low, high), ("feature",)).select("feature", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def ecdf(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``df`` with share: the part of the group's values up to this one."""
    return df.withColumn("share", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def estimates(effects: DataFrame, terms: tuple[str, ...] = ("edge", "row", "col"), n: int = 20) -> DataFrame:
    """feature, term, estimate, low, high of the n features with the smallest FDR over terms."""
    best = effects.withColumn("__f", F.least(*[F.col(f"{t}_fdr") for t in terms])).orderBy(F.asc_nulls_last("__f"), "feature").limit(n)
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("estimate"), (F.col(t) - 1.96 * F.col(f"{t}_se")).alias("low"), (F.col(t) + 1.96 * F.col(f"{t}_se")).alias("high")) for t in terms])
    return best.select("feature", F.explode(rows).alias("r")).select("feature", "r.*")


#: Order in which a coordinate array is looked for.
COORDINATES = ("x_umap", "x_tsne", "x_pca", "x_diffmap")


def plot_coordinates(df: DataFrame, wanted: str | None = None) -> DataFrame:
    """``df`` with plot_x and plot_y from the wanted or the first embedding at hand."""
    have = [c for c in ((wanted,) if wanted else COORDINATES) if c in df.columns]
    if not have:
        raise ValueError("no embedding to plot")
    return df.withColumn("plot_x", F.get(have[0], F.lit(0))).withColumn("plot_y", F.get(have[0], F.lit(1)))

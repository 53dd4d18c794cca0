"""Outlier objects: normal scores within plate and condition, a PCA basis, local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import knn_edges
from .ranking import quantiles

TINY = 1e-10


def lof(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, id, lof from exactly k nearest neighbours of every row (keys, src, dst, distance, rank)."""
    kdist = edges.groupBy(*keys, "src").agg(F.max("distance").alias("kd")).withColumnRenamed("src", "dst")
    reach = edges.join(kdist, [*keys, "dst"]).withColumn("reach", F.greatest("kd", "distance"))
    lrd = reach.groupBy(*keys, "src").agg((1.0 / (F.avg("reach") + TINY)).alias("lrd"))
    of_dst = lrd.select(*keys, F.col("src").alias("dst"), F.col("lrd").alias("lrd_dst"))
    mean = edges.join(of_dst, [*keys, "dst"]).groupBy(*keys, "src").agg(F.avg("lrd_dst").alias("m"))
    return mean.join(lrd, [*keys, "src"]).select(*keys, F.col("src").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))


def find_outliers(vectors: DataFrame, n_neighbors: int = 20, threshold: float = 2.0, min_group: int = 10, keys: Sequence[str] = ("plate", "condition"), id_col: str = "object_id") -> DataFrame:
    """``vectors`` with outlier_score, organoid_outlier, outlier_class; groups below ``min_group`` get no score.

    The k-th neighbour is by (distance, id); k is one less than the group's size in small groups.
    """
    size = F.count("*").over(Window.partitionBy(*keys))
    big = vectors.withColumn("__n", size).where(F.col("__n") >= min_group)
    edges = knn_edges(big, big, n_neighbors, id_col, id_col, keys=keys, same=True)
    scores = lof(edges, keys).select(*keys, F.col("id").alias(id_col), F.col("lof").alias("outlier_score"))
    out = vectors.join(scores, [*keys, id_col], "left")
    odd = F.coalesce(F.col("outlier_score") >= threshold, F.lit(False))
    return out.withColumn("organoid_outlier", odd).withColumn("outlier_class", F.when(odd, "outlier").otherwise("typical"))


def score_histogram(scores: DataFrame, threshold: float = 2.0, bins: int = 60, column: str = "outlier_score") -> DataFrame:
    """bin, low, n: counts of scores clipped at the larger of 1.5 thresholds and the 99.9 % quantile."""
    rows = scores.where(F.col(column).isNotNull())
    high, least = quantiles(rows, column, (0.999,)).first(), rows.agg(F.min(column)).first()[0]
    if high is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    top = max(1.5 * threshold, high["q"][0])
    width = (top - least) / bins or 1.0
    at = F.least(F.floor((F.least(F.col(column), F.lit(top)) - least) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.lit(least) + F.col("bin") * width)

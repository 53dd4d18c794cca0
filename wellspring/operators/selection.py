"""Choice of features for embeddings: a cascade in which the first reason to drop a feature counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_scores
from ..sources.shared import materialize


def mode_fraction(long: DataFrame) -> DataFrame:
    """feature, mode_fraction: share of the most common value among non-missing ones."""
    per = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return per.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("mode_fraction"))


def well_effect(long: DataFrame) -> DataFrame:
    """feature, well_effect: intraclass correlation of wells within plate and condition, pooled, at least 0."""
    rows = long.where("value IS NOT NULL")
    wells = rows.groupBy("feature", "plate", "condition", "well").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    g = Window.partitionBy("feature", "plate", "condition")
    gm = F.sum("s").over(g) / F.sum("n").over(g)
    w = wells.withColumn("gm", gm).withColumn("m", F.col("s") / F.col("n"))
    agg = w.groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"), F.sum(F.col("ss") - F.col("n") * F.col("m") * F.col("m")).alias("ssw"), F.sum("n").alias("n"),
        F.count("*").alias("wells"), F.count_distinct("plate", "condition").alias("groups"),
    )
    msb, msw, n0 = F.try_divide(F.col("ssb"), F.col("wells") - F.col("groups")), F.try_divide(F.col("ssw"), F.col("n") - F.col("wells")), F.col("n") / F.col("wells")
    icc = F.try_divide(msb - msw, msb + (n0 - 1.0) * msw)
    return agg.select("feature", F.when(icc.isNotNull(), F.greatest(icc, F.lit(0.0))).alias("well_effect"))


def split_half_reliability(long: DataFrame, splits: int = 20, min_wells: int = 6, seed: int = 0) -> DataFrame:
    """feature, reliability: mean correlation of condition means from two halves of the wells, stepped up.

    Halves alternate in the order of an MD5 of seed, split and well within plate and condition; only conditions with two wells or more
    on a plate take part; half means are centred within the plate.
    """
    wells = long.where("value IS NOT NULL").groupBy("feature", "plate", "condition", "well").agg(F.avg("value").alias("v"))
    g = Window.partitionBy("feature", "plate", "condition")
    wells = wells.withColumn("k", F.count("*").over(g)).where("k >= 2").withColumn("__all", F.count("*").over(Window.partitionBy("feature"))).where(F.col("__all") >= min_wells)
    each = wells.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    turn = F.row_number().over(Window.partitionBy("feature", "split", "plate", "condition").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "split", "plate", "well")))) % 2
    half = each.withColumn("half", turn).groupBy("feature", "split", "plate", "condition").agg(F.avg(F.when(F.col("half") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("b"))
    p = Window.partitionBy("feature", "split", "plate")
    half = half.withColumn("a", F.col("a") - F.avg("a").over(p)).withColumn("b", F.col("b") - F.avg("b").over(p))
    r = half.groupBy("feature", "split").agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("r"))
    mean = r.groupBy("feature").agg(F.avg("r").alias("r"))
    return mean.select("feature", F.try_divide(2 * F.col("r"), 1 + F.col("r")).alias("reliability"))


def correlation_matrix(scores: DataFrame, features: Sequence[str], row: str = "object_id") -> np.ndarray:
    """Pearson correlations of the scores (row, feature, score) of rows that have all features; the result is features squared."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    place = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    pairs = scores.where(F.col("feature").isin(*features)).select(row, place[F.col("feature")].alias("i"), "score")
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda s: s["score"])
    rows = pairs.groupBy(row).agg(vec.alias("v")).where(F.size("v") == len(features)).select(array_to_vector("v").alias("v"))
    return np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray())


def redundancy_pass(order: Sequence[str], names: Sequence[str], corr: np.ndarray, limit: float = 0.9) -> dict[str, str]:
    """Dropped feature to the kept one it repeats, going through ``order`` once."""
    at = {n: i for i, n in enumerate(names)}
    kept: list[str] = []
    out: dict[str, str] = {}
    for f in order:
        if kept:
            r = np.abs([corr[at[f], at[k]] for k in kept])
            if r.max() > limit:
                out[f] = kept[int(r.argmax())]
                continue
        kept.append(f)
    return out


def select_features(long: DataFrame, drop_names: Sequence[str] = (), saturated: Sequence[str] = (), max_mode: float = 0.95, max_effect: float | None = 0.3, min_reliability: float | None = 0.2, max_corr: float | None = 0.9, splits: int = 20, seed: int = 0, row: str = "object_id") -> DataFrame:
    """feature, reason ("kept", else the first that applies), mode_fraction, well_effect, reliability.

    long: object id (``row``), plate, condition, well, feature, value.  Features that pass the first four steps
    are judged by rank-based normal scores: the well effect within plate and condition, from ``max_effect`` up a
    reason to drop; reliability and correlation within the plate.  A bound of None skips its step.

    Statistics are a few numbers per feature; they and the correlations of the features that pass so far come
    to the driver for the sequential redundancy pass.
    """
    miss = long.groupBy("feature").agg((F.count("value") < F.count("*")).alias("missing"))
    named = F.lit(False)
    for n in drop_names:
        named = named | F.col("feature").contains(n)
    full = F.col("feature").isin(*saturated) if saturated else F.lit(False)
    first = F.when(F.col("missing"), "missing values").when(named, "removed by name").when(full, "saturated").when(F.col("mode_fraction") > max_mode, "near-constant")
    judged = materialize(miss.join(mode_fraction(long), "feature", "left").select("feature", "mode_fraction", first.alias("reason")), "features")
    able = long.join(judged.where("reason IS NULL").select("feature"), "feature", "left_semi")
    within = normal_scores(able, "value", "plate", "condition", "feature").select("feature", "plate", "condition", "well", F.col("score").alias("value"))
    scores = materialize(normal_scores(able, "value", "plate", "feature").select(row, "feature", "plate", "condition", "well", "score"), "scores")
    half = split_half_reliability(scores.withColumnRenamed("score", "value"), splits, seed=seed)
    rows = judged.join(well_effect(within), "feature", "left").join(half, "feature", "left").collect()

    def why(r) -> str | None:
        if r["reason"]:
            return r["reason"]
        if max_effect is not None and r["well_effect"] is not None and r["well_effect"] > max_effect:
            return "well effect"
        return "not reproducible" if min_reliability is not None and r["reliability"] is not None and r["reliability"] < min_reliability else None

    reason = {r["feature"]: why(r) for r in rows}
    left = sorted((r for r in rows if reason[r["feature"]] is None), key=lambda r: (r["reliability"] is None, -(r["reliability"] or 0.0), r["feature"]))
    names = [r["feature"] for r in left]
    if max_corr is not None and len(names) > 1:
        reason |= {f: f"redundant with {k}" for f, k in redundancy_pass(names, names, correlation_matrix(scores, names, row), max_corr).items()}
    out = [(r["feature"], reason[r["feature"]] or "kept", r["mode_fraction"], r["well_effect"], r["reliability"]) for r in rows]
    return long.sparkSession.createDataFrame(out, "feature string, reason string, mode_fraction double, well_effect double, reliability double")

"""Normalisation to controls: skew detection, transforms, three scalers, and a check of the result.

Everything works on the long table (object_id, plate, well, condition, is_control, feature, value), so the
plan is the same for four features or four thousand; (group, feature) is the shuffle key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log1p_clipped, skewness, yeo_johnson
from ..sources.shared import discard, materialize


def reference_rows(long: DataFrame, control: str | None = "is_control") -> DataFrame:
    """Non-missing control rows, or all non-missing rows without a control column."""
    rows = long.where(F.col("value").isNotNull())
    return rows if control is None else rows.where(F.col(control))


def scaler_fit(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", value: str = "value") -> DataFrame:
    """group, feature and the centre and scale of the robust, z and min-max scalers; a zero scale becomes 1."""
    v = F.col(value)
    rows = long.where(v.isNotNull())
    if control is not None:
        rows = rows.where(F.col(control))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    fit = rows.groupBy(*group, "feature").agg(q.alias("q"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    return fit.select(*group, "feature", F.get("q", F.lit(1)).alias("median"), one(F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), "mean", one(F.col("sd")).alias("sd"), "low", one(F.col("high") - F.col("low")).alias("span"))


#: Tasks over which a group's rows are dealt in a join with its few numbers.
PARTS = 32


def scale(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", value: str = "value") -> DataFrame:
    """``long`` with robust_scaled, z_scaled and minmax_scaled.

    The fit has one row per group and feature.  Where the planner does not broadcast it, a group's rows are dealt
    to ``PARTS`` tasks by their hash, each of which meets a copy of the fit.
    """
    fit, v = scaler_fit(long, group, control, value), F.col(value)
    dealt = long.withColumn("__part", F.pmod(F.xxhash64(*long.columns), F.lit(PARTS)).cast("int"))
    copies = fit.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = dealt.join(copies, [*group, "feature", "__part"], "left").drop("__part")
    out = out.withColumns({"robust_scaled": (v - F.col("median")) / F.col("iqr"), "z_scaled": (v - F.col("mean")) / F.col("sd"), "minmax_scaled": (v - F.col("low")) / F.col("span")})
    return out.drop("median", "iqr", "mean", "sd", "low", "span")


def groups_without_controls(long: DataFrame, group: Sequence[str] = ("plate",), control: str = "is_control") -> DataFrame:
    """Groups, or features of a group, that have values but no control value: they cannot be normalised."""
    per = long.where(F.col("value").isNotNull()).groupBy(*group, "feature").agg(F.max(F.col(control).cast("int")).alias("has"))
    return per.where("has = 0").drop("has")


def control_check(scaled: DataFrame, group: Sequence[str] = ("plate",), control: str = "is_control", tolerance: float = 1e-6) -> DataFrame:
    """group, largest absolute mean of z-scaled and median of robust-scaled controls, and whether both are small."""
    per = scaled.where(F.col(control) & F.col("value").isNotNull()).groupBy(*group, "feature").agg(F.abs(F.avg("z_scaled")).alias("m"), F.abs(F.median("robust_scaled")).alias("d"))
    out = per.groupBy(*group).agg(F.max("m").alias("max_abs_mean"), F.max("d").alias("max_abs_median"))
    return out.withColumn("ok", (F.col("max_abs_mean") < tolerance) & (F.col("max_abs_median") < tolerance))


def trimmed(long: DataFrame, share: float, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values outside the [share, 1 - share] linear quantiles of their group become NULL (bounds stay)."""
    q = F.percentile(F.col(value), F.array(F.lit(share), F.lit(1.0 - share)))
    # grouped, not in a window, which would bring a group's rows to one task
    ends = long.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(q.alias("__q")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = long.withColumn("__in", F.pmod(F.xxhash64(*long.columns), F.lit(PARTS)).cast("int"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__in") == F.col("__part"))
    out = dealt.join(ends, same, "left").drop("__in", "__part", *[f"__k{i}" for i in range(len(keys))])
    return out.withColumn(value, F.when(F.col(value).between(F.get("__q", F.lit(0)), F.get("__q", F.lit(1))), F.col(value))).drop("__q")


def skew_by_group(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", trim: float = 0.005, min_cells: int = 20, value: str = "value") -> DataFrame:
    """group, feature, skew of trimmed reference values; NULL if too few or constant."""
    rows = trimmed(reference_rows(long, control), trim, [*group, "feature"], value)
    return rows.groupBy(*group, "feature").agg(skewness(F.col(value), min_cells).alias("skew"))


def skew_decision(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", threshold: float = 0.5, trim: float = 0.005, min_cells: int = 20) -> DataFrame:
    """feature, skew_raw, skew_transformed, n_groups, decision of a log1p transform (medians over groups)."""
    raw = skew_by_group(long, group, control, trim, min_cells).groupBy("feature").agg(F.median("skew").alias("skew_raw"), F.count("skew").alias("n_groups"))
    logged = skew_by_group(long.withColumn("value", log1p_clipped(F.col("value"))), group, control, trim, min_cells).groupBy("feature").agg(F.median("skew").alias("skew_transformed"))
    lowest = long.groupBy("feature").agg(F.min("value").alias("lowest"))
    out = lowest.join(raw, "feature", "left").join(logged, "feature", "left")
    r, t = F.col("skew_raw"), F.col("skew_transformed")
    decision = (
        F.when(r.isNull(), "not testable").when(F.col("lowest") < 0, "negative values").when(r < -threshold, "left-skewed").when(r <= threshold, "not skewed")
        .when(F.abs(t) < F.abs(r), "transform").otherwise("no improvement")
    )
    return out.select("feature", "skew_raw", "skew_transformed", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), decision.alias("decision"))


LAMBDA_POINTS = 15
LAMBDA_PASSES = 6


def fit_yeo_johnson(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", trim: float = 0.005, min_cells: int = 20) -> DataFrame:
    """feature, lambda, center, scale, skew_raw, skew_transformed: medians over groups of maximum-likelihood exponents in [0, 2].

    Two placements are tried, as is and standardised (median, quartile range); the standardised one is kept if its
    absolute skew is strictly smaller.  All groups are fitted at once: a pass evaluates the likelihood at
    ``LAMBDA_POINTS`` exponents of each group's interval by grouped sums, and the interval shrinks to the neighbours
    of the best; after ``LAMBDA_PASSES`` passes it is below 1e-5.
    """
    keys = [*group, "feature"]
    rows = reference_rows(long, control).where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"))
    cuts = F.array(*[F.lit(float(q)) for q in (trim, 1 - trim, 0.25, 0.5, 0.75)])
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile("value", cuts).alias("__q"), F.stddev_pop("value").alias("__sd")).where(F.col("__n") >= min_cells)
    q = [F.get("__q", F.lit(i)) for i in range(5)]
    spread = (q[4] - q[2]) / 1.349
    held = rows.join(ends, keys).where(F.col("value").between(q[0], q[1])).withColumns({"center": q[3], "scale": F.when(spread > 0, spread).otherwise(F.col("__sd"))})
    placed = F.array(F.struct(F.lit(0).alias("at"), F.col("value").alias("x")), F.struct(F.lit(1).alias("at"), F.when(F.col("scale") > 0, (F.col("value") - F.col("center")) / F.col("scale")).alias("x")))
    values = materialize(held.select(*keys, "center", "scale", F.explode(placed).alias("p")).select(*keys, "center", "scale", "p.at", "p.x").where("x IS NOT NULL"), "placed")
    each = [*keys, "at"]
    x = F.col("x")
    base = values.groupBy(*each).agg(F.count("*").alias("n"), F.var_pop("x").alias("v"), F.skewness("x").alias("raw"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), F.min("center").alias("center"), F.min("scale").alias("scale"))
    state = materialize(base.where((F.col("n") >= min_cells) & (F.col("v") > 0)).select(*each, "n", "s", "raw", "center", "scale", F.lit(0.0).alias("lo"), F.lit(2.0).alias("hi")), "exponents")
    kept = [c for c in state.columns if c not in ("lo", "hi")]
    width = (F.col("hi") - F.col("lo")) / float(LAMBDA_POINTS + 1)
    points = F.explode(F.sequence(F.lit(1), F.lit(LAMBDA_POINTS)))
    for _ in range(LAMBDA_PASSES):
        tried = state.withColumn("j", points).withColumn("lam", F.col("lo") + width * F.col("j").cast("double"))
        spreads = values.select(*each, "x").join(tried.select(*each, "j", "lam"), each).groupBy(*each, "j").agg(F.var_pop(yeo_johnson(x, F.col("lam"))).alias("v"))
        cost = F.when(F.col("v") > 0, 0.5 * F.col("n") * F.log("v") - (F.col("lam") - 1.0) * F.col("s")).otherwise(float("inf"))
        best = tried.join(spreads, [*each, "j"]).groupBy(*each).agg(F.min_by("j", F.struct(cost, "j")).cast("double").alias("__j")).join(state, each)
        before, state = state, materialize(best.select(*kept, (F.col("lo") + width * (F.col("__j") - 1.0)).alias("lo"), (F.col("lo") + width * (F.col("__j") + 1.0)).alias("hi")), "exponents")
        discard(before)
    lam = (F.col("lo") + F.col("hi")) / 2
    skews = values.drop("center", "scale").join(state.select(*each, lam.alias("lam")), each).groupBy(*each).agg(F.skewness(yeo_johnson(x, F.col("lam"))).alias("skew"))
    fits = state.withColumn("lam", lam).join(skews, each)
    pick = lambda at, c: F.median(F.when(F.col("at") == at, F.col(c)))
    med = fits.groupBy("feature").agg(pick(0, "raw").alias("raw"), *[pick(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("lam", "skew")], pick(1, "center").alias("center"), pick(1, "scale").alias("scale"))
    use = F.coalesce(F.abs("skew1") < F.abs("skew0"), F.lit(False))
    every = long.select("feature").distinct().join(med, "feature", "left")
    return every.select("feature", F.col("raw").alias("skew_raw"), F.when(use, F.col("skew1")).otherwise(F.col("skew0")).alias("skew_transformed"), F.when(use, F.col("lam1")).otherwise(F.col("lam0")).alias("lambda"), F.when(use, F.col("center")).alias("center"), F.when(use, F.col("scale")).alias("scale"))


def yeo_johnson_decision(fit: DataFrame, threshold: float = 0.5) -> DataFrame:
    r, t = F.col("skew_raw"), F.col("skew_transformed")
    return fit.withColumn("decision", F.when(r.isNull(), "not testable").when(F.abs(r) <= threshold, "not skewed").when(F.abs(t) < F.abs(r), "transform").otherwise("no improvement"))


def apply_transform(long: DataFrame, decision: DataFrame, transform: str = "log1p") -> DataFrame:
    """``long`` with a column transformed: log1p or Yeo-Johnson where the decision is to transform."""
    if transform not in ("log1p", "yeo-johnson"):
        raise ValueError("transform is 'log1p' or 'yeo-johnson'")
    names = [c for c in ("lambda", "center", "scale") if c in decision.columns]
    # one row per feature, joined by name; the planner broadcasts it while it is small
    out = long.join(decision.select("feature", "decision", *names), "feature", "left")
    v = F.col("value")
    if transform == "log1p":
        new: Column = log1p_clipped(v)
    else:
        new = yeo_johnson((v - F.coalesce("center", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0)), F.col("lambda"))
    return out.withColumn("transformed", F.when(F.col("decision") == "transform", new).otherwise(v)).drop("decision", *names)


def normalize_groups(long: DataFrame, group: Sequence[str] = ("plate",), control: str | None = "is_control", transform: str | None = None, threshold: float = 0.5, strict: bool = True) -> DataFrame:
    """All layers: transformed (where asked for and worth it), robust_scaled, z_scaled, minmax_scaled.

    ``strict`` refuses groups or features that have values but no control value, naming some of them; without
    it their layers are NULL.
    """
    if strict and control is not None and (bad := groups_without_controls(long, group, control).limit(10).collect()):
        raise ValueError(f"no control values for {[tuple(r) for r in bad]}")
    if transform == "log1p":
        long = apply_transform(long, skew_decision(long, group, control, threshold), "log1p")
    elif transform == "yeo-johnson":
        long = apply_transform(long, yeo_johnson_decision(fit_yeo_johnson(long, group, control), threshold), "yeo-johnson")
    else:
        long = long.withColumn("transformed", F.col("value"))
    return scale(long, group, control, "transformed")


def transform_histograms(long: DataFrame, columns: Sequence[str] = ("value", "transformed"), bins: int = 40) -> DataFrame:
    """feature, layer, bin, n: counts on edges shared within a feature and layer."""
    each = long.select("feature", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("v")) for c in columns])).alias("s")).select("feature", "s.*").where("v IS NOT NULL")
    ends = each.groupBy("feature", "layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = each.join(ends, ["feature", "layer"])
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return placed.withColumn("bin", at.cast("int")).groupBy("feature", "layer", "bin").agg(F.count("*").alias("n"))


"""Filters that keep account: range filters, cut-off objects, controls, complete features, outgrowth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def control_mask(control: Mapping[str, str]) -> Column:
    """True where every control column has its value; missing values are not controls."""
    if not control:
        raise ValueError("a control needs at least one column")
    return F.coalesce(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in control.items()]), F.lit(False))


def range_reason(feature: str, low: float | None = None, high: float | None = None, keep_missing: bool = True) -> Column:
    """Why a row fails ``low <= feature <= high`` (too low, then too high, then missing), NULL if it passes."""
    v = F.col(feature)
    reason = F.lit(None).cast("string")
    if not keep_missing:
        reason = F.when(v.isNull(), F.lit(f"{feature} missing"))
    if high is not None:
        reason = F.when(v > high, F.lit(f"{feature} > {high:g}")).otherwise(reason)
    if low is not None:
        reason = F.when(v < low, F.lit(f"{feature} < {low:g}")).otherwise(reason)
    return reason


def split_by_reason(df: DataFrame, reason: Column, step: str, log_columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and removed rows (log columns, step, reason); together they are all rows."""
    marked = df.withColumn("reason", reason)
    kept = marked.where("reason IS NULL").drop("reason")
    removed = marked.where("reason IS NOT NULL").select(*(log_columns or df.columns), F.lit(step).alias("step"), "reason")
    return kept, removed


def append_removed(log: DataFrame | None, removed: DataFrame) -> DataFrame:
    return removed if log is None else log.unionByName(removed, allowMissingColumns=True)


def with_image_size(df: DataFrame, stored: DataFrame | None = None, plate: str = "plate", box: Sequence[str] = ("x_um", "y_um", "len_x_um", "len_y_um")) -> DataFrame:
    """Adds width and height: the largest extent on the plate unless ``stored`` (plate, width, height) has it."""
    x, y, w, h = (F.col(c) for c in box)
    # a row per plate goes to the objects; a window would bring a plate's objects to one task
    sizes = df.groupBy(F.col(plate).alias("__plate")).agg(F.max(x + w).alias("width"), F.max(y + h).alias("height"))
    df = df.drop("width", "height").join(F.broadcast(sizes), F.col(plate).eqNullSafe(F.col("__plate")), "left").drop("__plate")
    if stored is None:
        return df
    stored = stored.select(F.col(plate).alias("__p"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    out = df.join(stored, F.col(plate) == F.col("__p"), "left")  # one row per plate
    return out.withColumn("width", F.coalesce("__w", "width")).withColumn("height", F.coalesce("__h", "height")).drop("__p", "__w", "__h")


def border_reason(tolerance: float = 0.0, box: Sequence[str] = ("x_um", "y_um", "len_x_um", "len_y_um")) -> Column:
    """Sides of the image that a box touches, joined by commas; NULL if none.  Needs width and height."""
    x, y, w, h = (F.col(c) for c in box)
    sides = F.concat_ws(", ", F.when(x <= tolerance, "left"), F.when(y <= tolerance, "top"), F.when(x + w >= F.col("width") - tolerance, "right"), F.when(y + h >= F.col("height") - tolerance, "bottom"))
    return F.when(sides != "", sides)


def remove_cut_objects(df: DataFrame, tolerance: float = 0.0, stored: DataFrame | None = None, log_columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    sized = with_image_size(df, stored)
    kept, removed = split_by_reason(sized, border_reason(tolerance), "cut off", log_columns or df.columns)
    return kept.select(*df.columns), removed


def complete_features(long: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Names of features without a missing value in the long table."""
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.count("*").alias("rows")).where("n = rows" if n_rows is None else F.col("n") == n_rows).select("feature")


def outgrowth(objects: DataFrame, layout: DataFrame, n_seeded: int, removed: DataFrame | None = None, keys: Sequence[str] = ("other", "cell_line", "medium", "well", "plate")) -> DataFrame:
    """Objects per well against cells seeded; cut-off objects removed before count again, empty wells count 0."""
    rows = objects.select(*keys)
    if removed is not None:
        rows = rows.unionByName(removed.where("step = 'cut off'").select(*keys))
    counts = rows.groupBy("plate", "well").agg(F.count("*").alias("n"))
    out = layout.select(*keys).distinct().join(counts, ["plate", "well"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select(*keys, n.alias("organoid_no"), F.lit(n_seeded).cast("long").alias("cells_seeded"), (n * 100.0 / n_seeded).alias("pct_outgrowth"))


def threshold_override(thresholds: DataFrame, changes: DataFrame) -> DataFrame:
    """``final`` replaced where ``changes`` (round, stain, final) has another value."""
    new = changes.select("round", "stain", F.col("final").alias("__final"))
    return thresholds.join(new, ["round", "stain"], "left").withColumn("final", F.coalesce("__final", "final")).drop("__final")


def missing_thresholds(panel: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stains in use that have no threshold."""
    used = panel.where("stain <> ''").select("round", "stain").distinct()
    return used.join(thresholds.where("final IS NOT NULL"), ["round", "stain"], "left_anti")


def mixes_with_stain(panel: DataFrame, stain: str) -> DataFrame:
    return panel.where(F.col("stain") == stain).select("mix").distinct()


def plates_with_value(layout: DataFrame, value: str, columns: Sequence[str] = ("medium", "abs", "cell_line", "other")) -> DataFrame:
    return layout.where(F.array_contains(F.array(*columns), value)).select("plate").distinct()


def status_counts(df: DataFrame, *keys: str, status: str = "status") -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count("*").alias("n"))


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """``df`` as it is; missing columns are an error that names them."""
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks the columns {gone}")
    return df


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is not a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def feature_vectors(df: DataFrame, features: Sequence[str] | None = None, embedding: str | None = None, out: str = "vec") -> DataFrame:
    """``df`` with an array of the named features, or of a stored embedding; rows with a missing entry are an error when read."""
    v = F.col(embedding).cast("array<double>") if embedding else F.array(*[F.col(f"`{f}`").cast("double") for f in features or ()])
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.withColumn(out, F.when(whole, v).otherwise(F.raise_error(F.lit("a feature is missing or not finite")).cast("array<double>")))

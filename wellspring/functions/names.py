"""Names that carry meaning: wells, objects, features, natural order, normalised keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and columns of the usual plate formats, smallest first.
PLATE_SHAPES = {6: (2, 3), 12: (3, 4), 24: (4, 6), 48: (6, 8), 96: (8, 12), 384: (16, 24), 1536: (32, 48)}
WELL = r"^\s*([A-Za-z]+)(\d+)\s*$"
OBJECT_ID = "^(.*)-([^-]+)-([^-]+)$"
FEATURE = r"^R(\d+)__(.+?)_((?:T_)?(?:mean|max|min|std|Q\d+|area|area_T|area_T_ratio|asymmetry|potency|substructures_size|substructures_count|moments_weighted-\d-\d))$"
TABLE_FEATURE = "^R(\\d+)__(.+?)__(.+)$"
PAIR = "^(.+)--(.+)_PearsonR$"


def row_index(letters: Column) -> Column:
    """A to 0, Z to 25, AA to 26."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def row_name(index: Column) -> Column:
    """Inverse of ``row_index`` for rows below 702."""
    one = lambda i: F.char((i + 65).cast("int"))
    return F.when(index < 26, one(index)).otherwise(F.concat(one(F.floor(index / 26) - 1), one(index % 26)))


def well_row(well: Column) -> Column:
    return F.when(well.rlike(WELL), row_index(F.regexp_extract(well, WELL, 1)))


def well_col(well: Column) -> Column:
    return F.when(well.rlike(WELL), F.regexp_extract(well, WELL, 2).cast("int") - 1)


def object_id(plate: Column, well: Column, label: Column) -> Column:
    return F.concat_ws("-", plate, well, label)


def object_parts(uid: Column) -> tuple[Column, Column, Column]:
    """Plate (may hold dashes), well and label of an object id."""
    return tuple(F.regexp_extract(uid, OBJECT_ID, i) for i in (1, 2, 3))


def natural_key(s: Column, width: int = 12) -> Column:
    """String that sorts as people count: digit runs are padded to one width."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(r)), "")


def natural_sorted(names: list[str]) -> list[str]:
    return sorted(names, key=lambda s: [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", s)])


def match_key(s: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def parse_feature(name: Column) -> dict[str, Column]:
    """round, stain, statistic, thresholded and kind of a feature name."""
    channel, table, pair = name.rlike(FEATURE), name.rlike(TABLE_FEATURE), name.rlike(PAIR)
    statistic = F.regexp_extract(name, FEATURE, 3)
    return {
        "round": F.when(channel, F.regexp_extract(name, FEATURE, 1).cast("int")).when(table, F.regexp_extract(name, TABLE_FEATURE, 1).cast("int")),
        "stain": F.when(pair, F.lit(None).cast("string")).when(channel, F.regexp_extract(name, FEATURE, 2)),
        "statistic": F.when(pair, "PearsonR").when(channel, statistic).when(table, F.regexp_extract(name, TABLE_FEATURE, 3)).otherwise(name),
        "thresholded": F.coalesce(channel & statistic.rlike("^(T_|area_T)"), F.lit(False)),
        "kind": F.when(pair, "correlation").when(channel, "intensity").when(table, "table").otherwise("morphology"),
    }


def condition_label(*columns: str) -> Column:
    """Condition columns joined by `` | `` (missing ones print as nan); ``all`` without columns."""
    if not columns:
        return F.lit("all")
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])

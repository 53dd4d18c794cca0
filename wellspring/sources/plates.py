"""Plates on disk, plate layouts and staining panels."""

from __future__ import annotations

import os
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterable, Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import PLATE_SHAPES, natural_sorted

#: The four sheets of a layout workbook and the columns that they give.
SHEETS = {"MediumLayout": "medium", "StainingLayout": "abs", "LineLayout": "cell_line", "OtherLayout": "other"}
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
Cell = tuple[int, int, str]


def find_plates(root: str, suffix: str = ".zarr", max_depth: int | None = None) -> list[str]:
    """Folders that end in ``suffix`` at the shallowest depth that has any, in natural order."""
    level, depth = [root], 0
    while level and (max_depth is None or depth <= max_depth):
        hits = [p for p in level if p.rstrip("/").endswith(suffix)]
        if hits:
            return natural_sorted(hits)
        level = [e.path for p in level if os.path.isdir(p) for e in os.scandir(p) if e.is_dir()]
        depth += 1
    raise FileNotFoundError(f"no folder ends in {suffix} below {root}")


def read_xlsx(path: str) -> dict[str, list[Cell]]:
    """Sheet name to its filled cells (row, column, text), from 0; standard library only."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: dict[str, list[Cell]] = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[s.get(_REL)].lstrip("/")
            cells: list[Cell] = []
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}c"):
                letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                if text is not None and text.strip():
                    number = re.fullmatch(r"(-?\d+)\.0+", text.strip())
                    cells.append((int(digits) - 1, col - 1, number[1] if number else text.strip()))
            out[s.get("name")] = cells
        return out


def parse_grid(cells: Iterable[Cell]) -> tuple[dict[str, dict[str, str]], dict[str, set[str]]]:
    """Plate to well to value, and plate to folder hints, of one sheet.

    A block starts at ``Barcode:`` with the id to its right (and perhaps ``Folder:`` and a hint); its header
    counts columns from 1 within ten rows; rows begin with their letters.
    """
    at = {(r, c): v for r, c, v in cells}
    plates: dict[str, dict[str, str]] = {}
    hints: dict[str, set[str]] = defaultdict(set)
    for (r, c), v in sorted(at.items()):
        if v.lower() != "barcode:":
            continue
        plate = at.get((r, c + 1))
        if plate is None:
            raise ValueError(f"no barcode beside the cell in row {r + 1}")
        for k in sorted(k for rr, k in at if rr == r):
            if at[r, k].lower() in ("folder:", "zarr:", "plate folder:") and (r, k + 1) in at:
                hints[plate].add(at[r, k + 1])
        head = next(((hr, hc) for hr in range(r + 1, r + 11) for hc in range(c, c + 4) if at.get((hr, hc)) == "1" and at.get((hr, hc + 1)) == "2"), None)
        if head is None:
            raise ValueError(f"no column header below barcode {plate}")
        width = 1
        while at.get((head[0], head[1] + width)) == str(width + 1):
            width += 1
        wells = plates.setdefault(plate, {})
        row = head[0] + 1
        while re.fullmatch(r"[A-Za-z]{1,2}", at.get((row, head[1] - 1), "")):
            for k in range(width):
                if (value := at.get((row, head[1] + k))) is not None:
                    wells[f"{at[row, head[1] - 1].upper()}{k + 1:02d}"] = value
            row += 1
        if (row - head[0] - 1, width) not in PLATE_SHAPES.values():
            raise ValueError(f"plate {plate} has an unknown shape: {row - head[0] - 1} x {width}")
    return plates, hints


def layout_from_sheets(spark: SparkSession, sheets: dict[str, list[Cell]]) -> tuple[DataFrame, DataFrame]:
    """layout (plate, well and four columns) and plates (plate, hint); a well has all four values or none."""
    values: dict[tuple[str, str], dict[str, str]] = defaultdict(dict)
    hints: dict[str, set[str]] = defaultdict(set)
    for sheet, column in SHEETS.items():
        if sheet not in sheets:
            raise ValueError(f"sheet {sheet} is missing")
        grid, found = parse_grid(sheets[sheet])
        for p, wells in grid.items():
            for w, v in wells.items():
                values[p, w][column] = v
        for p, h in found.items():
            hints[p] |= h
    if bad := sorted(k for k, v in values.items() if len(v) < len(SHEETS)):
        raise ValueError(f"wells without a value in every sheet: {bad[:10]}")
    if twice := {p: sorted(h) for p, h in hints.items() if len(h) > 1}:
        raise ValueError(f"plates with several folder hints: {twice}")
    rows = [(p, w, *[v[c] for c in SHEETS.values()]) for (p, w), v in sorted(values.items())]
    layout = spark.createDataFrame(rows, "plate string, well string, medium string, abs string, cell_line string, other string")
    plates = spark.createDataFrame([(p, next(iter(hints.get(p, ())), None)) for p in natural_sorted(sorted({p for p, _ in values}))], "plate string, hint string")
    return layout, plates


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Layout and plates of a workbook, or of the first ``Layout*.xlsx`` of a folder in natural order."""
    if os.path.isdir(path):
        books = natural_sorted([f for f in os.listdir(path) if re.fullmatch(r"Layout.*\.xlsx", f)])
        if not books:
            raise FileNotFoundError(f"no Layout*.xlsx in {path}")
        path = os.path.join(path, books[0])
    return layout_from_sheets(spark, read_xlsx(path))


def staining_panel(table: DataFrame) -> DataFrame:
    """mix, round, stains (array by channel, '' for gaps) from rows (target, channel, mix, round, type).

    Brightfield, secondary and incomplete rows are dropped, mixes are comma-separated, rounds default to 0.
    Two stains on one channel of a mix raise an error when rows are read.
    """
    has = lambda c: F.col(c) if c in table.columns else F.lit(None).cast("string")
    rows = table.select(F.trim("target").alias("stain"), has("channel").try_cast("int").alias("channel"), has("mix").alias("mix"), F.coalesce(has("round").try_cast("int"), F.lit(0)).alias("round"), F.lower(F.coalesce(has("type"), F.lit(""))).alias("type"))
    rows = rows.where(F.col("stain").isNotNull() & F.col("channel").isNotNull() & F.col("mix").isNotNull() & ~F.lower("stain").contains("brightfield") & ~F.col("type").contains("secondary") & (F.col("channel") >= 1))
    rows = rows.withColumn("mix", F.explode(F.split("mix", r"\s*,\s*"))).withColumn("mix", F.trim("mix")).where("mix <> ''").distinct()
    per = rows.groupBy("mix", "round", "channel").agg(F.count("*").alias("n"), F.min("stain").alias("stain"))
    fine = F.when(F.col("n") == 1, F.col("stain")).otherwise(F.raise_error(F.concat(F.lit("two stains on channel "), F.col("channel").cast("string"), F.lit(" of mix "), F.col("mix"))))
    by = per.select("mix", "round", "channel", fine.alias("stain")).groupBy("mix", "round").agg(F.map_from_entries(F.collect_list(F.struct("channel", "stain"))).alias("m"), F.max("channel").alias("top"))
    return by.select("mix", "round", F.transform(F.sequence(F.lit(1), F.col("top")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("stains"))


def panel_rows(panel: DataFrame) -> DataFrame:
    """mix, round, channel (from 1), stain of a panel."""
    return panel.select("mix", "round", F.posexplode("stains").alias("i", "stain")).select("mix", "round", (F.col("i") + 1).alias("channel"), "stain")


def image_index(paths: DataFrame) -> DataFrame:
    """plate, well, round, path from image folders ``<plate>.zarr/<row>/<column>/<round>``."""
    pattern = r"([^/]+)\.zarr/([A-Za-z]+)/(\d+)/(\d+)/?$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = paths.where(F.col("path").rlike(pattern))
    return rows.select(part(1).alias("plate"), F.concat(F.upper(part(2)), F.lpad(part(3), 2, "0")).alias("well"), part(4).cast("int").alias("round"), "path")


def plate_roots(objects: DataFrame, depth: int = 3) -> DataFrame:
    """plate, folder: an image path without its last ``depth`` parts; the least one of a plate."""
    parts = F.split("path", "/")
    return objects.where("path IS NOT NULL").groupBy("plate").agg(F.min(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/")).alias("folder"))


def grid_view(layout: DataFrame, value: str, columns: Sequence[int] = tuple(range(1, 25))) -> DataFrame:
    """plate, row and a column for each plate column."""
    at = layout.select("plate", F.regexp_extract("well", "^([A-Za-z]+)", 1).alias("row"), F.regexp_extract("well", r"(\d+)$", 1).cast("int").alias("col"), value)
    return at.groupBy("plate", "row").pivot("col", list(columns)).agg(F.min(value))

"""Readers, writers and streams."""

import gzip
import json
import os
import zipfile
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from wellspring.sources import plates, tables
from wellspring.streaming import plates as stream_plates


def grid(plate, wells, rows=8, cols=12, hint=None, at=0):
    cells = [(at, 0, "Barcode:"), (at, 1, plate)] + ([(at, 3, "Folder:"), (at, 4, hint)] if hint else [])
    cells += [(at + 2, c, str(c)) for c in range(1, cols + 1)] + [(at + 3 + r, 0, chr(65 + r)) for r in range(rows)]
    return cells + [(at + 3 + ord(w[0]) - 65, int(w[1:]), v) for w, v in wells.items()]


def book(path, sheets):
    """A minimal workbook with inline strings."""
    col = lambda c: chr(65 + c) if c < 26 else chr(64 + c // 26) + chr(65 + c % 26)
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        shared = []
        for i, cells in enumerate(sheets.values(), 1):
            xml = ""
            for n, (r, c, v) in enumerate(cells):
                if n % 3 == 0:
                    shared.append(v)
                    xml += f'<c r="{col(c)}{r + 1}" t="s"><v>{len(shared) - 1}</v></c>'
                elif v.isdigit():
                    xml += f'<c r="{col(c)}{r + 1}"><v>{v}.0</v></c>'
                else:
                    xml += f'<c r="{col(c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData><row>{xml}</row></sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_layout_workbook(spark, tmp_path):
    wells = {"A01": "x", "B12": "y"}
    book(f"{tmp_path}/Layout10.xlsx", {"MediumLayout": []})
    book(f"{tmp_path}/Layout2.xlsx", {s: grid("P-1", wells, hint="run1") + grid("P-2", {"H01": "z"}, at=20) for s in plates.SHEETS})
    layout, found = plates.read_layout(spark, str(tmp_path))
    assert {(r["plate"], r["well"], r["medium"]) for r in layout.collect()} == {("P-1", "A01", "x"), ("P-1", "B12", "y"), ("P-2", "H01", "z")}
    assert {r["plate"]: r["hint"] for r in found.collect()} == {"P-1": "run1", "P-2": None}
    view = plates.grid_view(layout, "medium", range(1, 13)).where("plate = 'P-1' AND row = 'A'").first()
    assert view["1"] == "x" and view["2"] is None


def test_layout_errors(spark, tmp_path):
    sheets = {s: grid("P", {"A01": "x"}) for s in plates.SHEETS}
    with pytest.raises(ValueError, match="every sheet"):
        plates.layout_from_sheets(spark, sheets | {"LineLayout": grid("P", {"A02": "x"})})
    with pytest.raises(ValueError, match="missing"):
        plates.layout_from_sheets(spark, {"MediumLayout": []})
    with pytest.raises(ValueError, match="hints"):
        plates.layout_from_sheets(spark, sheets | {"LineLayout": grid("P", {"A01": "x"}, hint="a"), "OtherLayout": grid("P", {"A01": "x"}, hint="b")})
    with pytest.raises(ValueError, match="shape"):
        plates.parse_grid(grid("P", {"A01": "x"}, rows=5))
    with pytest.raises(FileNotFoundError):
        plates.read_layout(spark, str(tmp_path))


def test_find_plates(tmp_path):
    for p in ("a/p10.zarr", "a/p2.zarr", "b/c/p1.zarr"):
        os.makedirs(tmp_path / p)
    assert [os.path.basename(p) for p in plates.find_plates(str(tmp_path))] == ["p2.zarr", "p10.zarr"]
    with pytest.raises(FileNotFoundError):
        plates.find_plates(str(tmp_path), max_depth=0)


def test_panel(spark):
    cols = "target string, channel string, mix string, round string, type string"
    rows = [("DAPI", "1", "AB1, AB2", None, ""), ("KRT7", "3", "AB1", None, "primary"), ("Brightfield", "2", "AB1", None, ""), ("Goat", "2", "AB1", None, "Secondary"), ("CDX2", "2", "AB2", "1", None), (None, "4", "AB1", None, None)]
    got = {(r["mix"], r["round"]): r["stains"] for r in plates.staining_panel(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("AB1", 0): ["DAPI", "", "KRT7"], ("AB2", 0): ["DAPI"], ("AB2", 1): ["", "CDX2"]}
    with pytest.raises(Exception, match="two stains"):
        plates.staining_panel(spark.createDataFrame([*rows, ("X", "1", "AB1", None, "")], cols)).collect()
    assert plates.panel_rows(plates.staining_panel(spark.createDataFrame(rows, cols))).where("stain = ''").count() == 2


def test_images_and_roots(spark):
    df = spark.createDataFrame([("/d/bc-1.zarr/B/3/0",), ("/d/other",)], "path string")
    assert plates.image_index(df).collect()[0][:] == ("bc-1", "B03", 0, "/d/bc-1.zarr/B/3/0")
    assert plates.plate_roots(df.limit(1).withColumn("plate", F.lit("bc-1"))).first()["folder"] == "/d/bc-1.zarr"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 1.5, "x", "P"), ("2", float("nan"), "y", "Q")], "label string, v double, s string, plate string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    df.drop("v").write.json(f"{tmp_path}/t.json")
    t = tables.read_table(spark, f"{tmp_path}/t.parquet")
    assert t.where("v IS NULL").count() == 1 and tables.split_columns(t) == (["v"], ["s", "plate"])
    assert tables.read_table(spark, f"{tmp_path}/t.csv").count() == 2 and tables.read_table(spark, f"{tmp_path}/t.json").count() == 2
    df.where("false").write.parquet(f"{tmp_path}/none.parquet")
    assert tables.read_table(spark, f"{tmp_path}/none.parquet") is None
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.h5")
    a, b = tables.save_csv(df, f"{tmp_path}/out"), tables.save_csv(df, f"{tmp_path}/out")
    assert a.endswith("out.csv") and b.endswith("out-1.csv")
    data = tables.Dataset(t, t.limit(1), {"q": t}, {"a": 1})
    at = tables.save_dataset(data, f"{tmp_path}/set")
    back = tables.load_dataset(spark, at)
    assert back.objects.count() == 2 and back.removed.count() == 1 and back.side["q"].count() == 2 and back.config == {"a": 1}
    assert tables.save_dataset(data, f"{tmp_path}/set").endswith("set-1")
    with pytest.raises(ValueError, match="no match"):
        tables.save_matches(t, t, f"{tmp_path}/m")
    assert os.path.isdir(f"{tmp_path}/m") and os.path.isdir(f"{tmp_path}/m_unmatched.csv")


def zarr_array(path, data, chunks, codec):
    os.makedirs(path)
    meta = {"shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": {"id": codec} if codec else None, "fill_value": 0, "order": "C", "dimension_separator": "."}
    with open(f"{path}/.zarray", "w") as f:
        json.dump(meta, f)
    for i in np.ndindex(*[-(-n // c) for n, c in zip(data.shape, chunks)]):
        part = np.zeros(chunks, dtype=data.dtype)
        cut = data[tuple(slice(a * c, a * c + c) for a, c in zip(i, chunks))]
        part[tuple(slice(0, n) for n in cut.shape)] = cut
        with open(f"{path}/" + ".".join(map(str, i)), "wb") as f:
            f.write({None: bytes, "blosc": bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec](part.tobytes()))


def zarr_array_3(path, data, chunks, codec):
    """The same array as version 3 stores it."""
    zarr_array(path, data, chunks, codec)
    os.remove(f"{path}/.zarray")
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
    meta = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default"}, "codecs": codecs, "fill_value": 0}
    with open(f"{path}/zarr.json", "w") as f:
        json.dump(meta, f)
    for name in [n for n in os.listdir(path) if n[0].isdigit()]:
        to = f"{path}/c/" + name.replace(".", "/")
        os.makedirs(os.path.dirname(to), exist_ok=True)
        os.rename(f"{path}/{name}", to)


@pytest.mark.parametrize("codec", [None, "gzip", "zstd"])
def test_zarr_3(spark, tmp_path, codec):
    img = np.arange(2 * 1 * 7 * 9, dtype="<u2").reshape(2, 1, 7, 9)
    zarr_array_3(f"{tmp_path}/a", img, (1, 1, 4, 4), codec)
    crop = tables.crop_pixels(spark, f"{tmp_path}/a", 2, 3, 2, 2, pad=1, channel=1)
    assert {(r["y"], r["x"]): r["value"] for r in crop.collect()} == {(y, x): float(img[1, 0, y, x]) for y in range(1, 5) for x in range(2, 6)}


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
def test_zarr(spark, tmp_path, codec):
    img = np.arange(2 * 1 * 7 * 9, dtype="<u2").reshape(2, 1, 7, 9)
    zarr_array(f"{tmp_path}/a", img, (1, 1, 4, 4), codec)
    got = tables.read_zarr(spark, f"{tmp_path}/a")
    assert got.count() == img.size and all(img[tuple(r["index"])] == r["value"] for r in got.collect())
    crop = tables.crop_pixels(spark, f"{tmp_path}/a", 2, 3, 2, 2, pad=1, channel=1)
    assert {(r["y"], r["x"]): r["value"] for r in crop.collect()} == {(y, x): float(img[1, 0, y, x]) for y in range(1, 5) for x in range(2, 6)}


def test_unknown_codec(spark, tmp_path):
    zarr_array(f"{tmp_path}/b", np.zeros((2, 2), dtype="<u1"), (2, 2), "blosc")
    with pytest.raises(Exception, match="blosc"):
        tables.read_zarr(spark, f"{tmp_path}/b").collect()


def test_roi_scan(spark, tmp_path):
    spark.createDataFrame([("7", 1.0, 2.0, 4.0, 6.0)], "label string, x_micrometer double, y_micrometer double, len_x_micrometer double, len_y_micrometer double").write.parquet(f"{tmp_path}/r.parquet")
    layout = spark.createDataFrame([("P", "A01", "m", "ab", "c", "o")], "plate string, well string, medium string, abs string, cell_line string, other string")
    r = tables.roi_scan(spark, {("P", "A01"): f"{tmp_path}/r.parquet", ("P", "A02"): f"{tmp_path}/r.parquet"}, layout).collect()
    assert len(r) == 1 and r[0]["object_id"] == "P-A01-7" and r[0]["cx_um"] == 3.0
    one = spark.createDataFrame([("8", 5.0, 1.0)], "label string, x_um double, extra double")
    at = f"{tmp_path}/with space+plus"
    one.coalesce(1).write.json(f"{at}/t.json")
    one.write.option("header", True).csv(f"{at}/t.csv")
    one.write.parquet(f"{at}/t.parquet")
    many = {("P", "A01"): f"{tmp_path}/r.parquet", ("P", "A02"): f"{at}/t.json", ("P", "A03"): f"{at}/t.csv", ("P", "A04"): f"{at}/t.parquet", ("Q", "A01"): f"{tmp_path}/r.parquet"}
    wells = spark.createDataFrame([(p, w) for p, w in many], "plate string, well string")
    rows = tables.roi_scan(spark, many, wells.withColumns({"len_x_um_": F.lit(0)})).collect()
    assert sorted((r["plate"], r["well"], r["label"], r["x_um"], r["extra"]) for r in rows) == [("P", "A01", "7", 1.0, None), *[("P", f"A0{i}", "8", 5.0, 1.0) for i in (2, 3, 4)], ("Q", "A01", "7", 1.0, None)]


def test_streams(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_plates.per_batch(stream, lambda b: b.groupBy(F.col("event_type").alias("plate")).agg(F.count("*").alias("n")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.agg(F.sum("n")).first()[0] == src.count() and out.select("batch").distinct().count() == 3
    w = stream_plates.arrivals(stream.withColumnRenamed("event_type", "plate"))
    q = w.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrivals").agg(F.sum("n")).first()[0] == src.count()

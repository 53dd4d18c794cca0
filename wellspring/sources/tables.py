"""Feature tables in and out: Parquet, CSV, JSON, Zarr arrays; datasets as folders; never overwriting."""

from __future__ import annotations

import gzip
import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.stats import to_null


@dataclass(frozen=True)
class Dataset:
    """Objects, what was removed from them, side tables and settings of a screen."""

    objects: DataFrame
    removed: DataFrame | None = None
    side: dict[str, DataFrame] = field(default_factory=dict)
    config: dict = field(default_factory=dict)


def read_table(spark: SparkSession, path: str, backend: str | None = None, index: str = "label") -> DataFrame | None:
    """A feature table with its index as a string column ``label``; NaN becomes NULL; None if it has no rows.

    Backends: parquet, csv, json (one object per line); by default after the path's ending.
    """
    backend = (backend or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet").lower()
    backend = {"pq": "parquet", "jsonl": "json", "ndjson": "json"}.get(backend, backend)
    if backend == "parquet":
        df = spark.read.parquet(path)
    elif backend == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif backend == "json":
        df = spark.read.json(path)
    else:
        raise ValueError(f"unknown backend {backend!r}")
    df = to_null(df)
    if index in df.columns:
        df = df.withColumn("label", F.col(index).cast("string"))
    return None if df.isEmpty() else df


def split_columns(df: DataFrame, keep: Sequence[str] = ("label",)) -> tuple[list[str], list[str]]:
    """Numeric columns (features) and the other ones (metadata)."""
    numeric = [c for c, t in df.dtypes if c not in keep and t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    return numeric, [c for c, _ in df.dtypes if c not in keep and c not in numeric]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def free_path(spark: SparkSession, path: str, ending: str = "") -> str:
    """``path`` plus ending, with -1, -2, ... before the ending while it exists."""
    if not _exists(spark, path + ending):
        return path + ending
    return next(p for i in itertools.count(1) if not _exists(spark, p := f"{path}-{i}{ending}"))


def save_csv(df: DataFrame, path: str) -> str:
    """Writes a folder of CSV parts under a free name."""
    out = free_path(df.sparkSession, path, ".csv")
    df.write.mode("errorifexists").option("header", True).csv(out)
    return out


def save_dataset(data: Dataset, path: str, partition: str | None = "plate") -> str:
    """Objects, removed rows, side tables and settings under a free folder name."""
    spark = data.objects.sparkSession
    out = free_path(spark, path)
    writer = data.objects.write
    (writer.partitionBy(partition) if partition and partition in data.objects.columns else writer).parquet(f"{out}/objects")
    if data.removed is not None:
        data.removed.write.parquet(f"{out}/removed")
    for name, df in data.side.items():
        df.write.parquet(f"{out}/side_tables/{name}")
    spark.createDataFrame([(json.dumps(data.config, default=str), sorted(data.side), data.removed is not None)], "config string, side array<string>, removed boolean").coalesce(1).write.json(f"{out}/config")
    return out


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    info = spark.read.schema("config string, side array<string>, removed boolean").json(f"{path}/config").first()
    side = {n: spark.read.parquet(f"{path}/side_tables/{n}") for n in info["side"] or []}
    return Dataset(spark.read.parquet(f"{path}/objects"), spark.read.parquet(f"{path}/removed") if info["removed"] else None, side, json.loads(info["config"]))


def save_matches(merged: DataFrame, unmatched: DataFrame, path: str, error_on_unmatched: bool = True) -> tuple[str, str]:
    """Writes matches and rows without one, then complains if there are any of the latter."""
    spark = merged.sparkSession
    a = free_path(spark, path)
    merged.write.parquet(a)
    b = save_csv(unmatched, f"{path}_unmatched")
    if error_on_unmatched and (n := unmatched.count()):
        raise ValueError(f"{n} objects have no match; see {b}")
    return a, b


def concat_plates(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a plate lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# -- Zarr arrays ------------------------------------------------------------------------------------------


class _Chunk(InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


def _decoder(codec: str | None):
    """Function from stored to plain bytes; codecs beyond the standard library need their package."""
    if codec is None:
        return lambda raw: raw
    if codec in ("zlib", "gzip"):
        return zlib.decompress if codec == "zlib" else gzip.decompress
    if codec == "zstd":
        try:
            import zstandard
        except ImportError as e:
            raise ValueError("codec zstd needs the package zstandard") from e
        return lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if codec in ("blosc", "lz4"):
        try:
            import numcodecs
        except ImportError as e:
            raise ValueError(f"codec {codec} needs the package numcodecs") from e
        return numcodecs.get_codec({"id": codec}).decode
    raise ValueError(f"codec {codec} cannot be decoded")


def _zarr_layout(path: str) -> dict:
    """shape, chunks, dtype, order, fill, codec and the name of a chunk of an array of version 2 or 3."""
    if os.path.exists(f"{path}/.zarray"):
        with open(f"{path}/.zarray") as f:
            m = json.load(f)
        return {"shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"], "order": m.get("order", "C"), "fill": m.get("fill_value") or 0, "codec": (m.get("compressor") or {}).get("id"), "sep": m.get("dimension_separator", "."), "head": ""}
    with open(f"{path}/zarr.json") as f:
        m = json.load(f)
    if m.get("node_type") != "array" or m["chunk_grid"]["name"] != "regular":
        raise ValueError("a Zarr array of version 3 needs a regular chunk grid")
    codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
    packed = [c for c in codecs if c not in ("bytes", "crc32c")]
    if len(packed) > 1 or "crc32c" in codecs:
        raise ValueError(f"codecs {list(codecs)} cannot be decoded")
    key = m.get("chunk_key_encoding", {"name": "default"})
    sep = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
    dtype = np.dtype(m["data_type"]).newbyteorder(">" if codecs.get("bytes", {}).get("endian") == "big" else "<").str
    return {"shape": m["shape"], "chunks": m["chunk_grid"]["configuration"]["chunk_shape"], "dtype": dtype, "order": "C", "fill": m.get("fill_value") or 0, "codec": packed[0] if packed else None, "sep": sep, "head": f"c{sep}" if key["name"] == "default" else ""}


class ZarrReader(DataSourceReader):
    """A partition is one chunk, so readers never hold more than one; it leaves as Arrow batches."""

    def __init__(self, path: str, box: dict[int, tuple[int, int]]):
        self.path, self.box = path.rstrip("/"), box
        self.meta = _zarr_layout(self.path)
        _decoder(self.meta["codec"])

    def partitions(self) -> list[_Chunk]:
        spans = []
        for d, (n, c) in enumerate(zip(self.meta["shape"], self.meta["chunks"])):
            lo, hi = self.box.get(d, (0, n))
            spans.append(range(max(0, lo) // c, min(math.ceil(n / c), math.ceil(min(hi, n) / c))))
        return [_Chunk(i) for i in itertools.product(*spans)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        m, index = self.meta, partition.index
        name = f"{self.path}/{m['head']}" + m["sep"].join(map(str, index))
        if os.path.exists(name):
            with open(name, "rb") as f:
                raw = _decoder(m["codec"])(f.read())
            data = np.frombuffer(raw, dtype=m["dtype"]).reshape(m["chunks"], order=m["order"])
        else:
            data = np.full(m["chunks"], m["fill"], dtype=m["dtype"])
        start = [i * c for i, c in zip(index, m["chunks"])]
        span = [(max(s, self.box.get(d, (0, n))[0], 0), min(s + c, n, self.box.get(d, (0, n))[1])) for d, (s, c, n) in enumerate(zip(start, m["chunks"], m["shape"]))]
        part = data[tuple(slice(max(lo - s, 0), max(hi - s, 0)) for (lo, hi), s in zip(span, start))]
        if part.size:
            at = np.stack([x.ravel() + lo for x, (lo, _) in zip(np.indices(part.shape, dtype=np.int32), span)], axis=1)
            values = part.ravel().astype(np.float64)
            for b in range(0, len(values), 1 << 16):
                few = at[b : b + (1 << 16)]
                where = pa.ListArray.from_arrays(pa.array(np.arange(len(few) + 1, dtype=np.int32) * at.shape[1]), pa.array(few.ravel()))
                yield pa.RecordBatch.from_arrays([where, pa.array(values[b : b + (1 << 16)])], names=["index", "value"])


class ZarrSource(DataSource):
    """``spark.read.format("zarr_array").option("box", '{"2": [10, 20]}').load(path)``: index array<int>, value double."""

    @classmethod
    def name(cls) -> str:
        return "zarr_array"

    def schema(self) -> str:
        return "index array<int>, value double"

    def reader(self, schema) -> ZarrReader:
        box = {int(k): tuple(v) for k, v in json.loads(self.options.get("box", "{}")).items()}
        return ZarrReader(self.options["path"], box)


def read_zarr(spark: SparkSession, path: str, box: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Elements of a Zarr array (version 2 or 3); only chunks that meet ``box`` (dimension to range) are opened."""
    spark.dataSource.register(ZarrSource)
    return spark.read.format("zarr_array").option("box", json.dumps({str(k): list(v) for k, v in (box or {}).items()})).load(path)


def crop_pixels(spark: SparkSession, path: str, top: int, left: int, height: int, width: int, pad: int = 20, channel: int | None = None) -> DataFrame:
    """channel, y, x, value of a box of a (channel, z, y, x) image, padded; z is 0; coordinates stay the image's."""
    box = {1: (0, 1), 2: (max(0, top - pad), top + height + pad), 3: (max(0, left - pad), left + width + pad)}
    if channel is not None:
        box[0] = (channel, channel + 1)
    at = lambda i: F.get("index", F.lit(i))
    return read_zarr(spark, path, box).select(at(0).alias("channel"), at(2).alias("y"), at(3).alias("x"), "value")


BOX = {"x_micrometer": "x_um", "y_micrometer": "y_um", "len_x_micrometer": "len_x_um", "len_y_micrometer": "len_y_um"}


def _many_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The rows of all tables, each with the ``path`` that it comes from: one read for each kind of file."""
    parts = []
    for backend in ("parquet", "json"):
        if own := [p for p in paths if (os.path.splitext(p.rstrip("/"))[1].lstrip(".") or "parquet") in {"parquet": ("parquet", "pq"), "json": ("json", "jsonl", "ndjson")}[backend]]:
            read = spark.read.option("mergeSchema", True).parquet(*own) if backend == "parquet" else spark.read.json(own)
            # files have been listed by now; each belongs to the path that it is or that holds it
            bare = lambda f: re.sub("^[A-Za-z0-9]+:/+", "/", f)
            known = {p.rstrip("/"): p for p in own}
            files = [(bare(f), unquote(bare(f))) for f in read.inputFiles()]
            named = spark.createDataFrame([(f, known.get(plain) or known[os.path.dirname(plain)]) for f, plain in files], "__file string, path string")
            rows = read.withColumn("__file", F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z0-9]+:/+", "/")).join(named, "__file")
            parts.append(to_null(rows.drop("__file")))
    for p in paths:  # columns of CSV files go by their place, so files with other headers can't be read at once
        if os.path.splitext(p.rstrip("/"))[1] == ".csv":
            parts.append(to_null(spark.read.csv(p, header=True, inferSchema=True)).withColumn("path", F.lit(p)))
    if not parts:
        raise ValueError(f"no table of a known kind among {sorted(paths)[:10]}")
    return concat_plates(parts)


def roi_scan(spark: SparkSession, tables: dict[tuple[str, str], str], layout: DataFrame, index: str = "label") -> DataFrame:
    """ROI tables by (plate, well) as one table with object ids and layout columns; wells outside the layout are left out.

    Parquet and JSON tables are read together and told apart by their file, so the plan does not grow with wells.
    """
    wells = spark.createDataFrame([(p, w, path) for (p, w), path in sorted(tables.items())], "plate string, well string, path string")
    rows = _many_tables(spark, sorted(set(tables.values())))
    if rows.isEmpty():
        raise ValueError(f"no ROI table has rows; looked at {sorted(tables.values())[:10]}")
    for long_name, name in BOX.items():
        if long_name in rows.columns:
            rows = rows.withColumn(name, F.coalesce(name, long_name) if name in rows.columns else F.col(long_name)).drop(long_name)
    rows = rows.withColumn("label", F.col(index).cast("string"))
    rows = rows.join(wells, "path").join(layout, ["plate", "well"])
    return rows.withColumn("object_id", F.concat_ws("-", "plate", "well", "label")).withColumn("cx_um", F.col("x_um") + F.col("len_x_um") / 2).withColumn("cy_um", F.col("y_um") + F.col("len_y_um") / 2)

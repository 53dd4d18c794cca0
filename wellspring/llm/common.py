"""Shared plumbing: reading tables, the shared folder, bounded samples, batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A standard table; ``spread`` deals a table of fewer files than cores over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a temporary one on a local master, whose tasks run on this machine, and an error on a
    cluster, whose executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    return store(df, path)


def store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to and read from ``path``."""
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int, where=None, salt: int = 0) -> DataFrame:
    """At most ``limit`` labelled documents, drawn by a hash of the id: doc_id, text and ``columns``, a row per id.

    The drawn labels are at most ``limit`` rows of a few numbers, hence the broadcast.  Rows without id or
    label are left out; of an id's repeated labels or texts the smallest is taken.
    """
    few = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        few = few.where(F.col(c).isNotNull())
    if where is not None:
        few = few.where(where)
    few = few.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    few = few.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(few), "doc_id")
    return met.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", "text", *columns)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns columns as a dict of arrays or lists."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)

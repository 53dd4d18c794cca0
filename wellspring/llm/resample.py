"""Importance resampling towards a target: documents drawn by hashed n-gram weights with Gumbel noise.

Each partition's texts go to an in-process DuckDB in slices: SQL takes words, unnests them, forms runs of one to
three by window functions, hashes them with a registered zlib CRC function and counts the buckets of each text.
The counts are spilled to Parquet, with one row of sums a partition; Spark merges these sums over the corpus and
over the target, turns each bucket into a gain (log of the ratio of smoothed shares) and scores every document
from its spilled counts.

How it scales.  Texts are read once and never shuffled; a slice holds about a million characters, and a longer text
is cut between words into pieces that see the two words after them, so a task's memory has a bound and no run of
words is lost.  What is merged is ``buckets`` rows a partition.  Ranks come from a sort by ranges of five numbers
a document (``operators.ranking``), not from one task.

Defined results.  Null text has no words, weight 0 and is never drawn.  Null ids are hashed as empty strings and
come last among ties; repeated rows are scored and ranked each, ties in all of score and id in any order (such
rows are alike).  Other columns are ignored.  An empty corpus gives an empty result; an empty target smooths to
equal shares.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import discard, materialize

BUCKETS = 10_000
SLICE = 1_000_000
MEMORY = "256MB"
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>, total boolean"

_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_GAP = re.compile("[^A-Za-z0-9\x80-\U0010ffff]")

#: Words of each piece and of what follows it, as rows with their place; runs that begin in the piece; bucket counts.
SQL = """
WITH split AS (SELECT piece, row, regexp_extract_all({low}, '{word}') AS own, regexp_extract_all({low_next}, '{word}') AS more FROM pieces),
 words AS (SELECT piece, row, len(own) AS own, unnest(own || more) AS w, unnest(range(len(own) + len(more))) AS i FROM split),
 hashed AS (SELECT piece, row, own, i, zlib_crc(w) AS c, CAST(strlen(w) AS BIGINT) AS n FROM words),
 runs AS (SELECT row, own, i, c AS one, lead(c) OVER p AS c2, lead(n) OVER p AS n2, lead(c, 2) OVER p AS c3, lead(n, 2) OVER p AS n3 FROM hashed WINDOW p AS (PARTITION BY piece ORDER BY i)),
 pairs AS (SELECT *, zlib_crc_join(one, c2, n2) AS two FROM runs WHERE i < own),
 grams AS (SELECT row, unnest([one, two, zlib_crc_join(two, c3, n3)]) % {buckets} AS bucket FROM pairs),
 counts AS (SELECT row, bucket, count(*) AS n FROM grams WHERE bucket IS NOT NULL GROUP BY row, bucket)
SELECT row, bucket, n FROM counts ORDER BY row, bucket"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_SQL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _zero_bytes(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of each byte value at each of the four places of a checksum: 4 x 256."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    out = (np.arange(256, dtype=np.uint32)[None] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]).astype(np.uint32)
    for _ in range(n):
        out = step[out & 0xFF] ^ (out >> np.uint32(8))
    return out


class _Shifts:
    """Checksums moved past ``n`` bytes: tables for short lengths, powers of two for the rest."""

    SHORT = 64

    def __init__(self):
        one = _zero_bytes(1)
        rows = [_zero_bytes(0)]
        for _ in range(self.SHORT - 1):
            rows.append(self.apply(one, rows[-1]))
        self.short = np.stack(rows)
        self.powers = [one]

    @staticmethod
    def apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24]

    def past(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n) or int(n.max()) < self.SHORT:
            t = self.short
            return t[n, 0, crc & 0xFF] ^ t[n, 1, crc >> 8 & 0xFF] ^ t[n, 2, crc >> 16 & 0xFF] ^ t[n, 3, crc >> 24]
        out = crc.copy()
        for k in range(int(n.max()).bit_length()):
            if k == len(self.powers):
                self.powers.append(self.apply(self.powers[-1], self.powers[-1]))
            on = (n >> k & 1).astype(bool)
            out[on] = self.apply(self.powers[k], out[on])
        return out


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


@lru_cache(maxsize=2)
def _connection(buckets: int):
    """DuckDB on one thread with the checksum functions, one for all tasks of a worker; and its query."""
    import duckdb

    shifts, blank = _Shifts(), np.uint32(zlib.crc32(b" "))

    def crc(words: pa.ChunkedArray) -> pa.Array:
        """zlib's checksum of each word, read from the column's own bytes."""
        raw = _one(words).cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].tolist()
        data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] else b""
        return pa.array([zlib.crc32(data[x:y]) for x, y in zip(ends, ends[1:])], pa.int64())

    def join(a: pa.ChunkedArray, b: pa.ChunkedArray, n: pa.ChunkedArray) -> pa.Array:
        """Checksum of a text, a blank and a word of n bytes, from those of text and word."""
        a, b, n = map(_one, (a, b, n))
        there = b.is_valid().to_numpy(zero_copy_only=False)
        a, b, n = (x.fill_null(0).to_numpy() for x in (a, b, n))
        spaced = shifts.past(a.astype(np.uint32), np.ones(len(a), dtype=np.int64)) ^ blank
        return pa.array((shifts.past(spaced, n) ^ b.astype(np.uint32)).astype(np.int64), mask=~there)

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
    con.create_function("zlib_crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
    con.create_function("zlib_crc_join", join, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow", null_handling="special")
    return con, SQL.format(low=_LOWER.format("body"), low_next=_LOWER.format("next"), word=_WORD_SQL, buckets=buckets)


def pieces(text: str, size: int) -> Iterator[tuple[str, str]]:
    """``text`` cut between words into pieces of about ``size``, each with the next two words after it."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if not gap:
            break
        after = [m[0] for m, _ in zip(_WORD.finditer(text, gap.end()), range(2))]
        yield text[at : gap.end()], " ".join(after)
        at = gap.end()
    yield text[at:], ""


def counter(buckets: int, slice_chars: int):
    """What a task does with its batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, query = _connection(buckets)
        sums = np.zeros(buckets, dtype=np.int64)

        def run(ids: list, cut: list[tuple[int, str, str]]) -> pa.RecordBatch:
            con.register("pieces", pa.table({"piece": pa.array(range(len(cut)), pa.int64()), "row": pa.array([c[0] for c in cut], pa.int64()), "body": pa.array([c[1] for c in cut], pa.string()), "next": pa.array([c[2] for c in cut], pa.string())}))
            found = con.sql(query).to_arrow_table()
            row, bucket, n = (found.column(i).to_numpy() for i in range(3))
            sums[:] += np.bincount(bucket, weights=n, minlength=buckets).astype(np.int64)
            ends = np.searchsorted(row, np.arange(len(ids)), side="right")
            features = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(n)])[ends]]).astype(np.int64))
            # f features of w words: f = w + (w - 1) + (w - 2), without those below zero
            words = np.where(features >= 3, features // 3 + 1, (features > 0).astype(np.int64))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((bucket, pa.int32()), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words), pa.array(features), *lists, pa.array([False] * len(ids))], names=NAMES)

        ids, cut, held = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                ids.append(i)
                cut += [(len(ids) - 1, body, after) for body, after in pieces(text, slice_chars)]
                held += len(text) + 16
                if held >= slice_chars:
                    yield run(ids, cut)
                    ids, cut, held = [], [], 0
        if ids:
            yield run(ids, cut)
        some = np.flatnonzero(sums)
        one = [pa.array([v], t) for v, t in ((some, pa.list_(pa.int32())), (sums[some], pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([int(sums.sum())]), *one, pa.array([True])], names=NAMES)

    return count


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, slice_chars: int = SLICE) -> DataFrame:
    """n_words, n_features and counts of the buckets of each text, spilled; and a row of sums (``total``) a partition."""

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(texts.mapInArrow(counter(buckets, slice_chars), COUNTS), "bucket_counts")


NAMES = ["doc_id", "n_words", "n_features", "buckets", "counts", "total"]


def merged(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sum of each bucket over all partitions: ``buckets`` numbers at most reach the driver."""
    rows = counted.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    out = np.zeros(buckets, dtype=object)
    for b, n in rows.groupBy("x.buckets").agg(F.sum("x.counts")).collect():
        out[b] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the corpus, rounded down."""
    n = len(corpus)
    all_t, all_s = float(sum(target) + n), float(sum(corpus) + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for t, s in zip(target, corpus)], dtype=np.int64)


def scored(counted: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document from its spilled counts."""

    # a literal of ``buckets`` numbers; rows stay in the JVM
    table = F.from_json(F.lit(str(gain.tolist())), "array<bigint>")
    products = F.zip_with("buckets", "counts", lambda b, n: F.get(table, b) * n)
    weight = F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)
    weighed = counted.where(~F.col("total")).select("doc_id", "n_words", "n_features", weight.alias("weight"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """n_features, weight, score and rank of every document; the best ``percent`` of those with enough words have a rank."""
    corpus = bucket_counts(docs, buckets)
    aim = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    gain = gains(merged(aim, buckets), merged(corpus, buckets))
    discard(aim)
    fit = (F.col("n_words") >= least_words).alias("fit")
    all_docs = scored(corpus, gain, seed).select("doc_id", "n_features", "weight", "score", fit)
    ranked = numbered(all_docs, F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    discard(corpus)
    draw = percent * ranked.where("fit").count() // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))

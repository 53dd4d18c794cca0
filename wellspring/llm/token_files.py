"""Token ids as files of patched frame-of-reference blocks.

A file is a row of segments.  A segment holds whole documents: their ids and lengths, and the token ids of all of
them in blocks of 128.  A block subtracts its least id, packs the rest at the width of a percentile of its values
and lists the ids that need more (position and high bits); a table of byte offsets finds any block without
decoding those before it.

How it scales.  Texts are dealt by ranges of (doc_id, hash of the text), sorted, and encoded partition by
partition, so files follow one another in order of doc_id and no row meets more than a segment of others (a
segment closes with the document that brings it to ``segment_tokens``).  Equal ids lie side by side, and a hot
one is spread over partitions by its texts; of equal rows any order gives the same files.  Spark's own writer
commits the files, so a lost executor leaves none half-written.  Reading needs one number a partition to know
where each document starts.

Defined results.  Null text counts as empty (the end id alone).  Null ids come first; repeated rows are written
each; other columns are ignored; an empty table gives no segment and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir
from .packing import _byte_letters

END = 2
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 18
SEGMENTS_PER_FILE = 64
CACHE_PARTS = 600_000
CACHED_LENGTH = 64
HEAD = struct.Struct("<8sQQQQQQQI")
MAGIC = b"PFOR-1\r\n"
DOCS = "doc_id long, part long, place long, n_tokens long, ids_crc32 long"

#: The rules of the tokenizer that the cache repeats.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\\s{L}{N}]+|\\s+(?!\\S)|\\s+"

#: Where letters, numbers and white space mean the same to all pattern engines: below U+0250, without separator controls, U+0085 and U+00A0.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")


def _pattern() -> re.Pattern:
    """The tokenizer's pattern for plain texts, its letters and numbers written out."""
    of = lambda kind: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)
    return re.compile(SPLIT.replace("{L}", of("L")).replace("{N}", of("N")))


class PartCache:
    """Token ids of whole texts through a bounded cache of the parts that the tokenizer splits them into; exact for any text.

    Parts are tokenized one by one by the tokenizer's model, as the tokenizer does.  Texts beyond the plain
    letters, texts that hold a special token, and all texts where the tokenizer's rules are others than these go
    to the tokenizer as they are.  Of two generations of parts the older is dropped when the younger is full.
    """

    def __init__(self, path: str, limit: int = CACHE_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        own = json.loads(self.tokenizer.to_str())
        self.known = own["normalizer"] is None and own["pre_tokenizer"] == PRE_TOKENIZER
        self.special = [t["content"] for t in own["added_tokens"]]
        self.model, self.letters, self.split = self.tokenizer.model, _byte_letters(), _pattern()
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            letters = part.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(part) <= CACHED_LENGTH:
            self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.known or _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.parts) > self.limit:
            self.parts, self.older = {}, self.parts
        get, new = self.parts.get, self._new
        return b"".join([get(p) or new(p) for p in self.split.findall(text)])


@lru_cache(maxsize=2)
def _cache(path: str) -> PartCache:
    return PartCache(path)


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least id, width, number of exceptions and byte offset of each block, and the bytes of all blocks.

    A block's bytes are its low bits, then the positions of its exceptions (a byte each), then their high bits
    (four bytes each).  The last block is filled up with its last id.
    """
    n = -(-len(ids) // block)
    whole = np.full(n * block, ids[-1] if len(ids) else 0, dtype=np.uint32)
    whole[: len(ids)] = ids
    rows = whole.reshape(n, block)
    least = rows.min(axis=1)
    above = rows - least[:, None]
    at = max(0, int(np.ceil(percentile * block)) - 1)
    width = _bits(np.partition(above, at, axis=1)[:, at]) if n else np.zeros(0, dtype=np.int64)
    high = (above.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    of, position = np.nonzero(high)
    exceptions = np.bincount(of, minlength=n)
    packed = block * width // 8
    size = packed + 5 * exceptions
    start = np.cumsum(size) - size
    body = np.empty(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        here = np.flatnonzero(width == w)
        bits = (above[here][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
        body[start[here][:, None] + np.arange(block * w // 8)] = np.packbits(bits.astype(np.uint8).reshape(len(here), -1), axis=1, bitorder="little")
    if len(of):
        nth = np.arange(len(of)) - (np.cumsum(exceptions) - exceptions)[of]
        tail = start[of] + packed[of]
        body[tail + nth] = position
        body[(tail + exceptions[of] + 4 * nth)[:, None] + np.arange(4)] = high[of, position].astype("<u4")[:, None].view(np.uint8)
    return least, width, exceptions, start, body


def unpack_blocks(least: np.ndarray, width: np.ndarray, exceptions: np.ndarray, start: np.ndarray, body: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the given blocks; ``start`` may point anywhere into ``body``."""
    out = np.zeros((len(least), block), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        here = np.flatnonzero(width == w)
        bits = np.unpackbits(body[start[here][:, None] + np.arange(block * w // 8)], axis=1, bitorder="little")
        out[here] = bits.reshape(len(here), block, w).astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    of = np.repeat(np.arange(len(least)), exceptions)
    if len(of):
        nth = np.arange(len(of)) - (np.cumsum(exceptions) - exceptions)[of]
        tail = start[of] + (block * width // 8)[of]
        high = body[(tail + exceptions[of] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[of, body[tail + nth]] += high << width[of].astype(np.uint32)
    return (out + least[:, None]).reshape(-1)


class Segment(NamedTuple):
    """A segment with its tables; token ids stay packed until ``tokens`` asks for some."""

    part: int
    number: int
    place: int
    doc_ids: list
    lengths: np.ndarray
    n_tokens: int
    least: np.ndarray
    width: np.ndarray
    exceptions: np.ndarray
    start: np.ndarray
    body: np.ndarray

    def tokens(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from ``first`` on (by default all); only the blocks that hold them are read."""
        last = self.n_tokens if count is None else min(self.n_tokens, first + count)
        a, b = first // BLOCK, -(-last // BLOCK)
        if last <= first:
            return np.zeros(0, dtype=np.uint32)
        ids = unpack_blocks(self.least[a:b], self.width[a:b], self.exceptions[a:b], self.start[a:b], self.body)
        return ids[first - a * BLOCK : last - a * BLOCK]


def write_segment(part: int, number: int, place: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """Header, documents, block tables, blocks and a checksum of all of it."""
    least, width, exceptions, start, body = pack_blocks(ids)
    parts = [
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(), np.array([i is not None for i in doc_ids], dtype="u1").tobytes(), np.array(lengths, dtype="<u4").tobytes(),
        least.astype("<u4").tobytes(), width.astype("u1").tobytes(), exceptions.astype("u1").tobytes(), start.astype("<u8").tobytes(), body.tobytes(),
    ]
    inner = b"".join(parts)
    head = HEAD.pack(MAGIC, part, number, place, len(doc_ids), len(ids), len(least), len(inner), BLOCK)
    return head + inner + struct.pack("<I", zlib.crc32(inner, zlib.crc32(head)))


def read_segments(content: bytes) -> Iterator[Segment]:
    """The segments of a file; a damaged one is an error."""
    at = 0
    while at < len(content):
        magic, part, number, place, n_docs, n_tokens, n_blocks, size, block = HEAD.unpack_from(content, at)
        end = at + HEAD.size + size
        if magic != MAGIC or block != BLOCK or struct.unpack_from("<I", content, end)[0] != zlib.crc32(memoryview(content)[at:end]):
            raise ValueError(f"damaged segment at byte {at}")
        at += HEAD.size
        cols = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("u1", n_blocks), ("<u8", n_blocks)):
            cols.append(np.frombuffer(content, dtype=kind, count=n, offset=at))
            at += cols[-1].nbytes
        ids, there, lengths, least, width, exceptions, start = cols
        body = np.frombuffer(content, dtype=np.uint8, count=end - at, offset=at)
        yield Segment(part, number, place, [i if t else None for i, t in zip(ids.tolist(), there)], lengths, n_tokens, least, width.astype(np.int64), exceptions.astype(np.int64), start.astype(np.int64), body)
        at = end + 5  # checksum and the writer's line end


def write_files(docs: DataFrame, tokenizer_path: str, path: str, end: int = END, segment_tokens: int = SEGMENT_TOKENS, segments_per_file: int = SEGMENTS_PER_FILE) -> None:
    """Token ids of all ``docs``, each followed by ``end``, as files below ``path`` in ascending order of doc_id."""
    tail = struct.pack("<I", end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        cache = _cache(tokenizer_path)
        number = place = held = 0
        ids, lengths, raw = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, place, held
            made = write_segment(part, number, place, ids, lengths, np.frombuffer(b"".join(raw), dtype="<u4"))
            number, place, held = number + 1, place + held, 0
            for x in (ids, lengths, raw):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([made], type=pa.binary())], names=["segment"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = cache.encode(text.as_py() or "") + tail
                ids.append(i)
                lengths.append(len(found) // 4)
                raw.append(found)
                held += lengths[-1]
                if held >= segment_tokens:
                    yield close()
        if ids:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    made = texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, "segment binary")
    made.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", segments_per_file).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` as rows of their content."""
    return spark.read.format("binaryFile").load(path).select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the files.

    Where a partition starts is the sum of those before it; a number a partition is what the driver holds.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for s in read_segments(content.as_py()):
                    ends = np.cumsum(s.lengths, dtype=np.int64)
                    starts = ends - s.lengths
                    raw = memoryview(s.tokens().astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist())]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(np.full(n, s.part)), pa.array(s.place + starts), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    read = materialize(files(spark, path).mapInArrow(decode, DOCS), "token_documents")
    before, bases = 0, []
    for part, n in sorted(read.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases.append((part, before))
        before += n
    base = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    return read.join(base, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, place and ids of each segment: the corpus as arrays of ids in the order (part, place)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for s in read_segments(content.as_py()):
                    ids = pa.array([s.tokens().astype(np.int32)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([s.part], pa.int64()), pa.array([s.place], pa.int64()), ids], names=["part", "place", "ids"])

    return files(spark, path).mapInArrow(decode, "part long, place long, ids array<int>")


def written_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Documents as the files give them back; the files are deleted once read."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_files(docs, tokenizer_path, path)
    found = read_documents(spark, path)
    gone = files(spark, path)
    gone.stored_at = path
    discard(gone)
    return found

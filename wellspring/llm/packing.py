"""Best-fit packing of tokenised documents into sequences under several capacities at once.

A document is its token ids followed by id 1; one that is longer than a sequence is cut into whole
sequences, of which the last may be shorter.  A piece asks for tokens, one document place and attention
cost (the square of its length); a sequence has a capacity for each.  Pieces go, longest first, to the open
sequence that fits under every capacity and is best by the rule: ``norm`` (least weighted norm of what is
left over) or ``dot`` (largest weighted product of demand and residual).

How it scales.  Tokens are counted and check-summed where the text is read; only five numbers a piece
travel.  Pieces are dealt evenly, whatever their source or length, into groups of at most about
``group_pieces`` pieces, a group to a task, so a task's rows have a bound and the loss is at most a part of one
sequence in thousands.

Defined results.  Null text counts as empty (one piece holding id 1).  Repeated rows are packed each.
Null ids pass through.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

END = 1
MAX_TOKENS = 4096
CACHE_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: The rules of the tokenizer that the cache repeats.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
SPECIAL = {"<|startoftext|>", "<|endoftext|>"}

#: Where splitting at white space and lower-casing a word by itself is the tokenizer's own normalisation:
#: below U+0250, without the four separator controls, the dotted capital I and special-token brackets.
_PLAIN = re.compile("[^\x00-\x1b\x20-;=-įı-ɏ]")


def _pattern() -> re.Pattern:
    """The tokenizer's word pattern for plain texts: its letter and number classes below U+0250."""
    of = lambda kind: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^\\s{of('L')}{of('N')}]+")


def _byte_letters() -> dict[int, int]:
    """Byte to the letter that stands for it in byte-level vocabularies: itself if it prints, else the next free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + n for n, b in enumerate(rest)}


class WordCache:
    """Token ids of whole texts through a bounded cache of white-space words; exact for any text.

    The tokenizer lower-cases, drops white space and never joins across it, so a plain text's ids are those
    of its words in a row; a new word is cut by the tokenizer's pattern and its parts go to the tokenizer's
    model.  Any other text, and every text where the tokenizer's own rules are others than these, goes to the
    tokenizer as it is.  The cache has two generations of ``limit`` words:
    when the younger is full it becomes the older, and words still in use move back.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.pattern, self.letters = self.tokenizer.model, _pattern(), _byte_letters()
        own = json.loads(self.tokenizer.to_str())
        self.known = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and {t["content"] for t in own["added_tokens"]} == SPECIAL
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _learn(self, word: str) -> None:
        if (found := self.older.get(word)) is None:
            if word.isalpha():
                found = self._part(word)
            else:
                found = b"".join([self.words.get(p) or self._part(p) for p in self.pattern.findall(word)])
        self.words[word] = found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        out = []
        for t in texts:
            if not self.known or _PLAIN.search(t):
                out.append(self._whole(t))
                continue
            split = t.lower().split()
            for w in set(split).difference(self.words):
                self._learn(w)
            out.append(b"".join(map(self.words.__getitem__, split)))
        return out


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    tail = np.array([END], dtype="<u4").tobytes()

    def cut(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        step = 64
        for at in range(0, len(ids), step):
            for i, raw in zip(ids[at : at + step], _cache(tokenizer_path).encode([t or "" for t in texts[at : at + step]])):
                raw += tail
                for n, p in enumerate(range(0, len(raw), 4 * max_tokens)):
                    part = raw[p : p + 4 * max_tokens]
                    for k, v in zip(out, (i, n, p // 4, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PIECES, cut)


def best_fit(lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the given order of arrival.

    A single piece always fits an empty sequence in tokens; where its own cost exceeds ``max_cost`` it gets
    a sequence of its own.  Residuals count as parts of each capacity, so the weights compare like with like.
    """
    n = len(lengths)
    cap_d, cap_c = float(max_docs or max_tokens), float(max_cost or max_tokens**2)
    left, docs, cost = (np.zeros(n) for _ in range(3))
    name = np.zeros(n, dtype=np.int64)
    opened = live = 0
    seq, off = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    least = lengths.min() if n else 0
    wt, wd, wc = weights
    for i, size in enumerate(lengths.tolist()):
        at, sq = -1, float(size) * size
        if live:
            ok = np.flatnonzero((left[:live] >= size) & (docs[:live] >= 1) & (cost[:live] >= sq))
            if len(ok):
                t, d, c = left[ok], docs[ok], cost[ok]
                if rule == "dot":
                    score = -(wt * t * size / max_tokens**2 + wd * d / cap_d**2 + wc * c * sq / cap_c**2)
                else:
                    score = wt * ((t - size) / max_tokens) ** 2 + wd * ((d - 1) / cap_d) ** 2 + wc * ((c - sq) / cap_c) ** 2
                at = int(ok[np.argmin(score)])
        if at < 0:
            at = live
            left[at], docs[at], cost[at], name[at] = max_tokens, cap_d, max(cap_c, sq), opened
            opened += 1
            live += 1
        seq[i], off[i] = name[at], max_tokens - left[at]
        left[at] -= size
        docs[at] -= 1
        cost[at] -= sq
        if left[at] < least or docs[at] < 1:  # full: the last open one takes its place
            live -= 1
            for x in (left, docs, cost, name):
                x[at] = x[live]
    return seq, off


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", group_pieces: int = 16_384) -> DataFrame:
    """Sequence and offset for each piece of a stored table of pieces."""
    groups = max(1, math.ceil(parts.count() / group_pieces))

    def one(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in pdfs if len(p)]
        if held:
            pdf = pd.concat(held).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            seq, off = best_fit(pdf["length"].to_numpy(), max_tokens, max_docs, max_cost, rule)
            yield pdf.assign(sequence_id=(TaskContext.get().partitionId() << 32) + seq, offset=off)

    return parts.repartition(groups).mapInPandas(one, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm") -> DataFrame:
    """Tokenise, cut and pack ``docs``."""
    return pack(materialize(pieces(docs, tokenizer_path, max_tokens), "pieces"), max_tokens, max_docs, max_cost, rule)

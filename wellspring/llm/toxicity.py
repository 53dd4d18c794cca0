"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (words and word beginnings of four to six letters) that is
learnt from the labelled rows alone, none is written by hand, also after common disguises are undone; how near second-person
words stand to lexicon words; shares of capitals, shouted words, exclamation and question marks, other
punctuation and digits; rates of disguised words; length.

The labelled sample (at most ``sample`` rows, drawn by a hash of the id; a documented bound) is split into
parts by another hash.  A row's features are made with the lexicon of the other parts, and the calibration
sees margins of trees that were grown on the other parts, so none is fitted to what another has seen; the
final lexicon and trees use all of the sample.  Only text is an input.

How it scales.  Scoring is one pass over whole texts without a shuffle; lexicon (at most ``LEXICON`` entries) and trees go to the
tasks.  The fit collects counts of the sample's words above a floor, and one dense row per sampled text.

Defined results.  Null text counts as empty and is scored.  Null ids, repeated rows and ties pass through;
labels without id or value are left out; other columns are ignored.  Without labels of both kinds the score
is the share of label 1 (0.0 without any).  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_isotonic, fit_trees
from .common import labelled_sample, map_batches, materialize

SAMPLE = 18_000
LEXICON = 4_000
PARTS = 3
HEADS = (4, 5, 6)
SECOND_PERSON = frozenset("you your yours yourself u ur youre yall du dein deine dir dich ihr euch tu toi ton ta tes vous votre tú ti te usted vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
#: Words with signs or digits for letters; a hyphen or underscore parts words.
_RUN = re.compile(r"(?:[^\W_]|[@$*!|+])+")
_MIXED = re.compile(r"[^\W\d_][@$*!|0-9+]+[^\W\d_]|\d[^\W\d_]+\d")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_UNDO = str.maketrans("@4$51!|0378", "aassiiioetb")
_REPEAT = re.compile(r"(.)\1{2,}")
NAMES = ("learnt", "begin", "any", "undone", "near_you", "you", "caps", "shout", "bang", "ask", "punct", "digit", "odd", "spaced", "repeat", "words", "hits", "word_len")


def beginnings(w: str) -> list[str]:
    return [w[:n] + "*" for n in HEADS if len(w) > n]


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    begins: frozenset[str]

    @cached_property
    def by_length(self) -> dict[int, str]:
        """Words of each length, a line each."""
        return {n: "\n".join(sorted(w for w in self.words if len(w) == n)) for n in {len(w) for w in self.words}}


def features(text: str | None, lex: Lexicon) -> list[float]:
    t = text or ""
    words = _WORD.findall(t.lower())
    n = len(words) or 1
    chars = len(t) or 1
    counts = Counter(words)
    learnt_w = {w for w in counts if w in lex.words}
    begin_w = {w for w in counts if len(w) > 4 and any(b in lex.begins for b in beginnings(w))}
    bad = learnt_w | begin_w
    total = lambda s: sum(counts[w] for w in s)
    you = {w for w in counts if w in SECOND_PERSON}
    near = 0.0
    if bad and you:
        b = np.array([i for i, w in enumerate(words) if w in bad])
        y = np.array([i for i, w in enumerate(words) if w in you])
        p = np.searchsorted(y, b)
        gap = np.minimum(np.abs(b - y[np.minimum(p, len(y) - 1)]), np.abs(b - y[np.maximum(p - 1, 0)]))
        near = float((1.0 / (1.0 + gap)).sum())
    odd = [w.lower() for w in _RUN.findall(t) if _MIXED.search(w)] if _MIXED.search(t) else []
    spaced = [re.sub(r"[ .\-_*]", "", m[0]).lower() for m in _SPACED.finditer(t)]
    known = lambda w: w in lex.words or any(x in lex.begins for x in beginnings(w))
    masked = lambda w: "*" in w and len(w) in lex.by_length and re.search("^" + re.escape(w).replace(r"\*", ".") + "$", lex.by_length[len(w)], re.M)
    undone = sum(known(_REPEAT.sub(r"\1", w.translate(_UNDO))) or bool(masked(w)) for w in odd) + sum(known(w) for w in spaced)
    repeats = [w for w in counts if _REPEAT.search(w)]
    undone += sum(known(_REPEAT.sub(r"\1", w)) for w in repeats)
    caps = sum(map(str.isupper, t)) if not t.isascii() else sum(t.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    shout = sum(1 for w in _WORD.findall(t) if len(w) > 2 and w.isupper()) if caps > 0.05 * chars else 0
    punct = sum(t.count(c) for c in "!?.,;:-()\"'*#$%&@/\\|")
    k = 100.0 / n
    hits = total(bad) + undone
    return [
        total(learnt_w) * k, total(begin_w) * k, hits * k, undone * k, near * k, total(you) * k, caps / chars, shout / n, t.count("!") * k, t.count("?") * k, punct / chars,
        sum(t.count(c) for c in "0123456789") / chars, len(odd) * k, len(spaced) * k, len(repeats) * k, float(np.log1p(len(words))), float(min(hits, 20)), sum(map(len, words)) / n,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0.0, 1.0)


def word_counts(sample: DataFrame, label: str) -> DataFrame:
    """w, part, tox, clean: in how many rows of each part a word or word beginning stands, by label."""
    ws = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    df = sample.select("part", F.col(label).alias("y"), ws.alias("ws"))
    heads = [F.array_distinct(F.transform(F.filter("ws", _longer(n)), _head(n))) for n in HEADS]
    each = df.select("part", "y", F.explode(F.concat("ws", *heads)).alias("w"))
    return each.groupBy("w", "part").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("tox"), F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("clean"))


def _longer(n: int):
    return lambda w: F.length(w) > n


def _head(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def learn_lexicons(counts: DataFrame, parts: int, size: int = LEXICON, floor: int = 4, purity: float = 0.9) -> list[Lexicon]:
    """For each part the lexicon of the others, and last that of all: entries in at least ``floor`` rows, ``purity`` of them with label 1."""
    own = [F.sum(F.when(F.col("part") != p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for p in range(parts) for c in ("tox", "clean")]
    sums = counts.groupBy("w").agg(*own, F.sum("tox").alias(f"tox{parts}"), F.sum("clean").alias(f"clean{parts}"))
    sums = materialize(sums.where(F.col(f"tox{parts}") >= floor), "words")
    out = []
    for p in range(parts + 1):
        tox, clean = F.col(f"tox{p}"), F.col(f"clean{p}")
        top = [r["w"] for r in sums.where((tox >= floor) & (tox >= purity * (tox + clean))).orderBy(tox.desc(), clean, "w").limit(size).collect()]
        out.append(Lexicon(frozenset(w for w in top if not w.endswith("*")), frozenset(w for w in top if w.endswith("*"))))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    drawn = labelled_sample(docs, labels, [label], sample, where, salt=9)
    drawn = materialize(drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")).repartition(24), "labelled")
    *others, lex = learn_lexicons(word_counts(drawn, label), PARTS)

    def make(b: pa.RecordBatch) -> dict:
        part = b.column(3).to_pylist()
        return {"doc_id": b.column(0), "y": b.column(2), "part": part, "x": [features(t, others[p]) for t, p in zip(b.column(1).to_pylist(), part)]}

    rows = map_batches(drawn.select("doc_id", "text", F.col(label).cast("int").alias("y"), "part"), "doc_id long, y int, part int, x array<double>", make).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=np.float64), np.array([r["part"] for r in rows])
    base = float(y.mean()) if len(y) else 0.0
    if any(len(set(y[part != p].tolist())) < 2 for p in range(PARTS)):
        return ToxicityModel(lex, None, np.zeros(1), np.zeros(1), base)
    margin = np.zeros(len(y))
    for p in range(PARTS):  # each part's margins come from trees that have not seen it
        margin[part == p] = fit_trees(x[part != p], y[part != p]).margin(x[part == p])
    knots, values = fit_isotonic(margin, y)
    return ToxicityModel(lex, fit_trees(x, y), knots, values, base)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and the number of trees

    def one(b: pa.RecordBatch) -> dict:
        m = sent.value
        x = np.array([features(t, m.lexicon) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
        return {"doc_id": b.column(0), "score": m.scores(x)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", one)

"""Importance resampling against a plain dictionary of hashed n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from wellspring.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def naive(docs, target):
    counted = [(i, *features(t)) for i, t in docs]
    corpus, aim = Counter(), Counter()
    for _, _, c in counted:
        corpus.update(c)
    for t in target:
        aim.update(features(t)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, c in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = [r[:4] for r in fit[: 5 * len(fit) // 100]]
    return sorted(map(str, (r[:4] for r in rows))), drawn


def check(got, docs, target):
    plain = lambda v: None if pd.isna(v) else int(v)
    rows = [tuple(map(plain, r)) for r in got[["doc_id", "n_features", "weight", "score", "rank"]].itertuples(index=False)]
    want, drawn = naive(docs, target)
    assert sorted(str(r[:4]) for r in rows) == want
    ranked = sorted((r for r in rows if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[:4] for r in ranked] == drawn


def test_query(spark, sf):
    docs, bench = (pd.read_parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    check(queries.op12_resampling(spark, sf).toPandas(), zip(docs.doc_id, docs.text), bench.text)


ODD = [None, "", "...", "one", "Two words", "Three Words here", "ÄÖ İı ſ K 漢字 x" * 9, "a\x00b\x7fc\x80d", "w" * 200 + " " + "v" * 70 + " tail", "ab " * 4000, "A-Z 0_9 " * 20]


def odd_table(spark):
    rows = [(i % 7 if i % 4 else None, t, "n") for i, t in enumerate(ODD * 12)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, counts string").repartition(5)


def test_odd_texts_null_ids_and_repeated_rows_match_brute_force_and_sql(spark):
    rows, docs = odd_table(spark)
    target = spark.createDataFrame([("ab ab words here",), (None,)], "text string")
    got = resample.resampled(docs, target).toPandas()
    check(got, [r[:2] for r in rows], ["ab ab words here", None])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", target.toArrow())
    sql = con.sql(queries.ORACLES["op12_resampling"]).df()
    assert sorted(map(str, sql.fillna(-1).astype(int).values.tolist())) == sorted(map(str, got[sql.columns].fillna(-1).astype(int).values.tolist()))


def test_long_texts_in_pieces_lose_no_run(spark):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + "x" * 500 + " end"
    docs = spark.createDataFrame([(1, text), (2, "a b c")], "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_features, r.buckets, r.counts) for r in df.where("NOT total").collect())
    whole, cut = (resample.bucket_counts(docs, slice_chars=n) for n in (1_000_000, 100))
    assert key(whole) == key(cut)
    assert "".join(p for p, _ in resample.pieces(text, 100)) == text


def test_checksums_of_joined_words():
    shifts = resample._Shifts()
    words = [b"", b"a", b"xyz" * 30, b"q" * 63, b"q" * 64, b"z" * 5000]
    for some in (words, words[:4]):
        a = np.array([zlib.crc32(b"left")] * len(some), dtype=np.uint32)
        got = shifts.past(a, np.array([len(w) for w in some])) ^ np.array([zlib.crc32(w) for w in some], dtype=np.uint32)
        assert got.tolist() == [zlib.crc32(b"left" + w) for w in some]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resampled(docs, bench).count() == 0
    some = spark.createDataFrame([(i, "one two three " * 9) for i in range(40)], "doc_id long, text string")
    got = resample.resampled(some, bench).collect()
    assert len(got) == 40 and sum(r["rank"] is not None for r in got) == 2

"""Bounds that are stated, odd tables through the pipeline, extreme vectors, hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wellspring.llm import common, near_dedup, neighbours, packing, quality, queries


def test_a_sample_has_a_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None), (None, "x"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in common.labelled_sample(docs, labels, ["quality"], 10).collect())
    assert got == [(1, "a", 0), (2, "", 1)]


def test_the_fit_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda rows, grades, bits: seen.append(sum(len(i) * 4 for i, _ in rows)))
    quality.train(docs, labels)
    quality.train(docs, labels, most_bytes=seen[0] // 2)
    assert 0 < seen[1] <= seen[0] // 2


def test_lbfgs_finds_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 20))
    h, c = a.T @ a + np.eye(20), rng.normal(size=20)
    x = quality.lbfgs(lambda v: (0.5 * v @ h @ v - c @ v, h @ v - c), np.zeros(20))
    assert np.allclose(x, np.linalg.solve(h, c), atol=1e-4)


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://x"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_scores_of_extreme_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    scale = np.array([1e300, 1e-300, 1.0, 1e150])[np.arange(40) % 4]
    df = spark.createDataFrame([(i * 5, v.tolist()) for i, v in enumerate(base * scale[:, None])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(neighbours.usable(df), F.col("vec_id") % 50 == 0, block=16).toPandas().sort_values(["query_id", "rank"])
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 40, 10):
        cos = unit @ unit[q]
        cos[q] = -9
        best = np.argsort(-cos)[:5]
        mine = got[got.query_id == q * 5]
        assert mine.vec_id.tolist() == (best * 5).tolist() and np.allclose(mine.score, cos[best], atol=1e-12)


def test_copies_past_the_bound(spark):
    rows = [(i, "one two three four") for i in range(300)] + [(1000 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(20)] + [(2000 + i, None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r["doc_id"]: tuple(r) for r in near_dedup.near_duplicates(df, copies=n).collect()} for n in (50, 10**9))
    assert a == b and len(a) == 420


def test_groups_of_pieces_are_even(spark):
    parts = common.materialize(spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 4096 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32")), "parts")
    got = packing.pack(parts, group_pieces=1000).toPandas()
    sizes = got.groupby(got.sequence_id // 2**32).size()
    assert len(sizes) == 10 and sizes.max() <= 1300 and len(got) == 10_000
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_unknown_tokenizers_are_asked_for_the_whole_text(tmp_path):
    import json

    own = json.load(open(queries.tokenizer_path()))
    own["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(own))
    cache = packing.WordCache(str(path))
    text = "Some Text, 12 times"
    assert np.frombuffer(cache.encode([text])[0], "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.WordCache(queries.tokenizer_path()).known and not cache.known


def test_pipeline_on_odd_tables(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(6)
    text = lambda: " ".join(rng.choice(words, 40))
    leak = text()
    rows = [(i, text()) for i in range(30)]
    rows += [rows[3], (40, rows[4][1]), (41, None), (42, ""), (None, rows[5][1]), (None, None), (43, f"x {leak} y"), (44, text() + " password = abcdefgh12345678"), (45, text() + " z" * 50_000)]
    extra = ["'e' AS keep", "1 AS fp", "2.5D AS tail_prob", "doc_id AS bad_id", "doc_id AS kept_id", "array(1) AS seeds", "'h' AS hs"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", *extra)
    columns = docs.columns

    def run(docs, labels, items):
        at = str(tmp_path / f"t{rng.integers(1 << 30)}")
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        kept = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, at)
            assert kept.columns == columns, name
        return kept.toPandas(), corpus_pipeline.run(spark, at).toPandas()

    kept, packed = run(docs, [], [(1, leak), (None, leak), (2, None)])
    assert sorted(kept.doc_id.dropna()) == [*range(30), 41, 44, 45] and kept.doc_id.isna().sum() == 2
    assert (kept.keep == "e").all() and (kept.fp == 1).all() and kept.text[kept.doc_id == 44].item().endswith("[SECRET]")
    assert sorted(set(packed.doc_id.dropna())) == sorted(kept.doc_id.dropna()) and packed.groupby("sequence_id").length.sum().max() <= 4096
    kept, packed = run(docs.where("false"), [(1, 1, 0)], [])
    assert len(kept) == len(packed) == 0

"""The pipeline stage by stage against brute force over what the stage before kept."""

import numpy as np
import pandas as pd
import pytest
from test_contracts import base_secrets, brute_components, brute_leaks, brute_print

import __spark_entry__
import corpus_pipeline


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and sorted({k.split("_")[0] for k in q if k.startswith("op") and k[2].isdigit()}) == sorted(f"op{n}" for n in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
        out.append((docs.columns, docs.toPandas()))
    return out


def test_stages(outputs, sf):
    first = pd.read_parquet(f"{sf}/documents.parquet")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    for columns, _ in outputs[:-1]:
        assert columns == first.columns.tolist()
    good, one, clean, scanned, packed = (df for _, df in outputs)
    kept = labels.merge(first[["doc_id"]], on="doc_id")
    kept["kept"] = kept.doc_id.isin(good.doc_id)
    assert ((kept.quality == 1) == kept.kept).mean() > 0.97
    comps = brute_components({int(i): brute_print(t or "") for i, t in zip(good.doc_id, good.text)})
    assert sorted(one.doc_id) == sorted(set(comps.values()))
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    bad = {d for d, _ in brute_leaks({int(i): t or "" for i, t in zip(one.doc_id, one.text)}, dict(zip(b.item_id, b.text)))}
    assert sorted(clean.doc_id) == sorted(set(one.doc_id) - bad)
    assert sorted(scanned.doc_id) == sorted(clean.doc_id) and not any(base_secrets(t or "") for t in scanned.text)
    same = scanned.merge(clean, on="doc_id")
    free = [not base_secrets(t or "") for t in same.text_y]
    assert (same.text_x == same.text_y)[free].mean() > 0.99
    assert set(packed.doc_id) == set(scanned.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    assert packed.sequence_id.nunique() <= int(np.ceil(packed.length.sum() / 4096)) + 1


def test_run(spark, sf, outputs):
    got = corpus_pipeline.run(spark, sf).toPandas()
    want = outputs[-1][1]
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got[keys].sort_values(keys).values.tolist() == want[keys].sort_values(keys).values.tolist()

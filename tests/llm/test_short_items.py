"""Decontamination by items of any length and in scripts without spaces."""

import itertools
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from wellspring.llm import decontaminate, queries


@pytest.mark.parametrize("n", range(1, 17))
def test_masks_find_every_accepted_item(n):
    places = [frozenset(o + i for i in m) for m in decontaminate.masks_for(n) for o in range(n - m[-1])]
    for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
        assert any(not p & set(gone) for p in places), gone


def brute(docs, items):
    split = lambda t: re.findall(r"[一-鿿぀-ヿ]|[^\W_一-鿿぀-ヿ]+", t.lower())
    out = {}
    for (d, t), (q, s) in itertools.product(docs.items(), items.items()):
        w, v = split(t), split(s)
        win = min(16, len(v))
        best = (0, 0)
        for diag in range(-len(v) + 1, len(w)) if v else ():
            agree = [0 <= diag + j < len(w) and w[diag + j] == x for j, x in enumerate(v)]
            best = max(best, *((sum(agree[a : a + win]), -max(diag, 0)) for a in range(len(v) - win + 1)))
        if v and best[0] >= math.ceil(0.8 * win):
            out[d, q] = (best[0], win, -best[1])
    return out


@pytest.mark.parametrize("carry", [True, False])
def test_items_of_every_length(spark, monkeypatch, carry):
    if not carry:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    docs, items = {}, {0: "...", 99: "机器学习模型的训练数据应当去除测试题目", 98: "これはテストです"}
    for n in range(1, 18):
        item = rng.choice(vocab, n).tolist()
        items[n] = " ".join(item)
        allowed = min(n, 16) - math.ceil(0.8 * min(n, 16))
        ways = list(itertools.combinations(range(n), allowed))
        picked = ways if len(ways) <= 60 else [ways[i] for i in rng.choice(len(ways), 20, replace=False)]
        for gone in [(), *picked, *([tuple(range(allowed + 1))] if n > allowed else [])]:
            copy = ["odd" if p in gone else x for p, x in enumerate(item)]
            docs[len(docs)] = " ".join([*rng.choice(vocab, 3), *copy, *rng.choice(vocab, 2)])
    docs |= {5000: "前置文字机器学习模型的训练资料应当去除测试题目。之后", 5001: "机器学习", 5002: "abcこれはテストです。", 5003: ""}
    got = decontaminate.overlaps(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["words"], r["window"], r["start_word"]) for r in got.collect()}
    assert got == brute(docs, items)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": docs.keys(), "text": docs.values()}))
    con.register("benchmark", pd.DataFrame({"item_id": items.keys(), "text": items.values()}))
    sql = con.sql(queries.ORACLES["op10_decontamination"]).df()
    assert got == {(r.doc_id, r.item_id): (r.words, r.window, r.start_word) for r in sql.itertuples()}
    assert (5000, 99) in got and (5002, 98) in got and (5001, 99) not in got

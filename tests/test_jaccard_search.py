"""The Jaccard graph searches its neighbours once."""

import numpy as np
import pyarrow as pa
import pytest

from wellspring.operators import embedding, neighbours


def test_edges_are_searched_once(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(120)], "id long, vec array<double>")
    got = embedding.jaccard_graph(neighbours.knn_edges(v, v, 5, same=True, blocks=4))
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = {}
    for r in neighbours.knn_edges(v, v, 5, same=True).collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    want = {(i, j): len(near[i] & near[j]) / len(near[i] | near[j]) for i in near for j in near if i < j and (j in near[i] or i in near[j]) and near[i] & near[j]}
    assert {(r["src"], r["dst"]): r["weight"] for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("wide", [False, True])
def test_rows_within_the_bounds_are_found_without_an_order(wide):
    rng = np.random.default_rng(9)
    q, r = rng.normal(size=(30, 3)), rng.normal(size=(400, 3))
    r[50] = r[60] = q[0]
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2))
    bound = np.sort(d, axis=1)[:, 300 if wide else 2]
    codes = np.concatenate([np.arange(30), 1000 + np.arange(400)])
    codes[30 + 50] = 0  # its own row
    d[0, 50] = np.inf
    i, j, found = neighbours._nearest_in_tile(q, r, 4, codes, bound)
    want = [(a, b) for a in range(30) for b in np.lexsort((np.arange(400), d[a]))[:4] if d[a, b] <= bound[a]]
    assert list(zip(i.tolist(), j.tolist())) == want and np.allclose(found, [d[a, b] for a, b in want])


def test_ids_without_a_share_have_no_codes():
    assert neighbours._codes(pa.array([1, 2]), pa.array([3, 4])) is None
    assert neighbours._codes(pa.array(["a", "b"]), pa.array(["b"])).tolist() == [0, 1, 1]

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import neighbours


def table(spark, x, groups=None):
    groups = groups if groups is not None else ["g"] * len(x)
    return spark.createDataFrame([(i, str(g), r.tolist()) for i, (r, g) in enumerate(zip(x, groups))], "id long, g string, vec array<double>")


def brute(q, r, k, allowed):
    out = {}
    for i in range(len(q)):
        d = np.sqrt(((r - q[i]) ** 2).sum(axis=1))
        near = sorted((d[j], j) for j in range(len(r)) if allowed(i, j))[:k]
        out[i] = [j for _, j in near]
    return out


def found(edges):
    out = {}
    for r in edges.orderBy("src", "rank").collect():
        out.setdefault(r.src, []).append(r.dst)
    return out


def clusters(n, dims=6, centres=12, seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 8, (centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))


@pytest.mark.parametrize("pivots", [1, 2, 9, 40])
def test_same_neighbours_for_any_number_of_pivots(spark, pivots):
    rng = np.random.default_rng(1)
    x = np.concatenate([clusters(150), np.round(rng.normal(0, 2, (80, 6))), np.zeros((30, 6))])  # ties and copies too
    v = table(spark, x)
    assert found(neighbours.knn_edges(v, v, 4, same=True, blocks=pivots)) == brute(x, x, 4, lambda i, j: i != j)


@pytest.mark.parametrize("pivots", [1, 12])
def test_other_queries_and_groups(spark, pivots):
    rng = np.random.default_rng(2)
    x, q = clusters(160, seed=3), rng.normal(0, 9, (60, 6))
    gx, gq = rng.integers(0, 3, 160), rng.integers(0, 4, 60)
    got = found(neighbours.knn_edges(table(spark, q, gq), table(spark, x, gx), 5, keys=("g",), blocks=pivots))
    want = brute(q, x, 5, lambda i, j: gq[i] == gx[j])
    assert got == {i: w for i, w in want.items() if w}


def test_blocks_of_a_cell_all_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    x = clusters(300, centres=3, seed=4)
    v = table(spark, x)
    assert found(neighbours.knn_edges(v, v, 3, same=True, blocks=5)) == brute(x, x, 3, lambda i, j: i != j)


def test_clustered_rows_meet_few_others(spark):
    x = clusters(4000, dims=8, centres=30, seed=5)
    v = table(spark, x)
    share = neighbours.visited_share(v, v, 10, same=True, blocks=32)
    assert share < 0.2
    assert neighbours.visited_share(v, v, 10, same=True) == 1.0  # one block


def test_empty_sides(spark):
    v = table(spark, clusters(20))
    assert neighbours.knn_edges(v, v.limit(0), 3).count() == 0
    assert neighbours.knn_edges(v.limit(0), v, 3, blocks=4).count() == 0
    assert neighbours.knn_edges(v, v, 30, same=True, blocks=3).groupBy("src").count().agg(F.min("count"), F.max("count")).first() == (19, 19)


def test_a_query_travels_once_a_part_not_once_a_cell(spark):
    x = np.random.default_rng(8).normal(0, 1, (600, 16))  # bounds exclude next to no cell
    v = table(spark, x)
    index = neighbours.MetricIndex(v, "id", "vec", (), 30)
    first = index.first_pass(v, "id", "vec", 5, True)
    parts = index.parts.agg(F.max("part") + 1).first()[0]
    assert index.wanted(first).agg(F.sum(F.size("q_ids"))).first()[0] <= 600 * parts


def test_many_parts_and_shares_give_the_same_neighbours(spark, monkeypatch):
    for name, n in (("BLOCK", 32), ("CELL", 16), ("PART", 70), ("SHARE", 40)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(9)
    x = np.concatenate([np.round(rng.normal(0, 2, (260, 3))), np.zeros((60, 3))])  # ties by id, as text
    v = table(spark, x).withColumn("id", F.format_string("k%03d", "id"))
    got = found(neighbours.knn_edges(v, v, 6, same=True))
    assert got == {f"k{i:03d}": [f"k{j:03d}" for j in near] for i, near in brute(x, x, 6, lambda i, j: i != j).items()}

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import curves


def arc(n, seed=0, noise=0.12):
    """Points around three quarters of a circle of radius 4, with their true time from 0 to 1."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n))
    a = t * 1.5 * np.pi
    return t, np.stack([4 * np.cos(a), 4 * np.sin(a), np.zeros(n)], axis=1) + rng.normal(0, noise, (n, 3))


def table(spark, x, clusters):
    return spark.createDataFrame([(i, str(c), r.tolist()) for i, (r, c) in enumerate(zip(x, clusters))], "object_id long, cluster string, vec array<double>")


def test_time_along_a_bent_curve(spark):
    t, x = arc(900)
    df = table(spark, x, np.minimum((t * 5).astype(int), 4))
    got = curves.principal_lineages(df, "0").orderBy("id").toPandas()
    assert np.corrcoef(got.pseudotime, t)[0, 1] > 0.998
    assert np.abs(got.pseudotime - t).max() < 0.06
    assert (got.weight_1 == 1).all() and got.pseudotime.between(0, 1).all()
    # straight lines through the centroids are far worse where the curve bends
    _, lines, _ = curves.fit_curves(df, "0", passes=0)
    rough = curves.project(x, lines[0])[1].mean()
    assert curves.project(x, curves.fit_curves(df, "0")[1][0])[1].mean() < 0.6 * rough


def test_two_branches_share_their_trunk(spark):
    rng = np.random.default_rng(1)
    s = rng.random(1200)
    side = rng.integers(0, 2, 1200) * 2 - 1
    x = np.stack([s * 10, np.where(s > 0.5, side * (s - 0.5) * 8, 0.0)], axis=1) + rng.normal(0, 0.1, (1200, 2))
    cluster = np.where(s < 0.25, "a", np.where(s < 0.5, "b", np.where(s < 0.75, np.where(side > 0, "c", "d"), np.where(side > 0, "e", "f"))))
    got = curves.principal_lineages(table(spark, x, cluster), "a").orderBy("id").toPandas()
    assert {"lineage_1", "lineage_2"} <= set(got.columns) and "lineage_3" not in got.columns
    trunk = s < 0.4
    assert (got.weight_1[trunk] > 0).all() and (got.weight_2[trunk] > 0).all()
    assert np.abs(got.lineage_1[trunk] - got.lineage_2[trunk]).max() < 0.5
    assert (got.lineage_2[cluster == "e"].isna() | got.lineage_1[cluster == "e"].isna()).all()
    assert np.corrcoef(got.pseudotime, s)[0, 1] > 0.99


def test_one_cluster_and_empty_tables(spark):
    df = table(spark, np.random.default_rng(2).normal(size=(30, 2)), ["0"] * 30)
    assert curves.principal_lineages(df, "0").where(F.col("pseudotime").isNull()).count() == 0
    with pytest.raises(ValueError):
        curves.principal_lineages(df.limit(0), "0")


def test_rows_are_projected_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    x, line = rng.normal(size=(53, 3)), rng.normal(size=(5, 3))
    whole = curves.project(x, line)
    monkeypatch.setattr(curves, "ROWS", 10)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(whole, curves.project(x, line), strict=True))
    at, away, run = np.zeros(53), np.full(53, np.inf), 0.0
    for a, b in zip(line, line[1:]):
        t = np.clip((x - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        d = np.linalg.norm(x - a - t[:, None] * (b - a), axis=1)
        at, away, run = np.where(d < away, run + t * np.linalg.norm(b - a), at), np.minimum(d, away), run + np.linalg.norm(b - a)
    assert np.allclose(whole[0], at) and np.allclose(whole[1], away)

"""Yeo-Johnson fits of all groups at once against a search on each group's values alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import normalize


def moved(x, lam):
    up, down = np.maximum(x, 0), np.maximum(-x, 0)
    a = np.log1p(up) if abs(lam) < 1e-8 else (np.power(up + 1, lam) - 1) / lam
    b = -np.log1p(down) if abs(lam - 2) < 1e-8 else -(np.power(1 + down, 2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, a, b)


def best(x):
    cost = lambda lam: 0.5 * len(x) * np.log(moved(x, lam).var()) - (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()
    grid = np.linspace(0, 2, 4001)
    return grid[np.argmin([cost(v) for v in grid])]


def skew(x):
    m = x - x.mean()
    return (m**3).mean() / (m * m).mean() ** 1.5


@pytest.mark.parametrize("kind", ["lognormal", "left", "normal"])
def test_equals_a_search_on_each_group(spark, kind):
    rng = np.random.default_rng(7)
    draw = {"lognormal": lambda n: rng.lognormal(1, 0.8, n), "left": lambda n: 50 - rng.lognormal(1, 0.7, n), "normal": lambda n: rng.normal(3, 2, n)}[kind]
    groups = {p: draw(400) for p in ("a", "b", "c")}
    long = spark.createDataFrame([(p, "f", float(v), True) for p, x in groups.items() for v in x], "plate string, feature string, value double, is_control boolean")
    got = normalize.fit_yeo_johnson(long).first()
    per = []
    for x in groups.values():
        lo, hi = np.quantile(x, [0.005, 0.995])
        v = x[(x >= lo) & (x <= hi)]
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        w = (v - q2) / ((q3 - q1) / 1.349)
        per.append((skew(v), best(v), skew(moved(v, best(v))), best(w), skew(moved(w, best(w))), q2, (q3 - q1) / 1.349))
    raw, lam0, s0, lam1, s1, centre, scale = np.median(np.array(per), axis=0)
    use = abs(s1) < abs(s0)
    assert np.isclose(got.skew_raw, raw)
    assert abs(got["lambda"] - (lam1 if use else lam0)) < 1e-3 and abs(got.skew_transformed - (s1 if use else s0)) < 5e-3
    assert (got.center is not None) == use and (not use or np.isclose(got.center, centre) and np.isclose(got.scale, scale))


def test_few_and_constant_values_are_not_testable(spark):
    rows = [("a", "few", float(i)) for i in range(5)] + [("a", "flat", 2.0)] * 60 + [("a", "none", None)] * 30
    long = spark.createDataFrame(rows, "plate string, feature string, value double").withColumn("is_control", F.lit(True))
    got = {r.feature: r for r in normalize.yeo_johnson_decision(normalize.fit_yeo_johnson(long)).collect()}
    assert set(got) == {"few", "flat", "none"} and all(r.decision == "not testable" and r["lambda"] is None for r in got.values())

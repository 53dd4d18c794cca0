"""Column expressions and numerics against hand-made numbers and the standard library."""

import math
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.functions import names, stats


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_average_ranks_and_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 3.0, 7.0, 9.5, 11.0)], "v double").withColumn("g", F.lit(1))
    assert sorted(r["r"] for r in df.withColumn("r", stats.avg_rank("v", "g")).collect()) == [1, 2.5, 2.5, 4, 5, 6, 7]
    r = df.agg(F.percentile("v", 0.75).alias("q"), stats.skewness(F.col("v"), 3).alias("s"), stats.skewness(F.col("v"), 30).alias("few")).first()
    assert r["q"] == 8.25 and r["s"] == pytest.approx(0.456872, abs=1e-6) and r["few"] is None


def test_nan_becomes_null_and_is_not_ranked(spark):
    df = stats.to_null(spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (None, "c")], "v double, k string"))
    assert [r["v"] for r in df.orderBy("k").collect()] == [1.0, None, None]
    got = stats.normal_scores(df.withColumn("g", F.lit(0)), "v", "g").collect()
    assert len(got) == 1 and got[0]["score"] == 0.0


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.075, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9, 0.0, 1.0]
    got = column(spark, p, stats.normal_ppf)
    for x, g in zip(p[:-2], got):
        assert g == pytest.approx(statistics.NormalDist().inv_cdf(x), rel=1e-13, abs=1e-13)
    assert got[-2:] == [None, None]


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None, 0.5])], "i int, p double").where("i < 5")
    got = {r["i"]: r["fdr"] for r in stats.bh_fdr(df, "p").collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5] and got[4] is None


def test_student_t():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-10)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0) and stats.t_two_sided(math.inf, 3) == 0.0 and stats.t_two_sided(None, 3) is None
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert stats.t_ppf(0.975, 1) == pytest.approx(12.706204736, rel=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.floats(-30, 30), st.floats(1, 200))
def test_student_t_is_symmetric_and_bounded(t, df):
    assert stats.t_two_sided(t, df) == pytest.approx(stats.t_two_sided(-t, df)) and 0 <= stats.t_two_sided(t, df) <= 1 + 1e-12


def test_yeo_johnson(spark):
    x = [-2.0, -0.5, 0.0, 0.5, 3.0, None]
    for lam in (0.0, 0.5, 1.0, 2.0):
        got = column(spark, x, lambda c, lam=lam: stats.yeo_johnson(c, F.lit(lam)))
        for v, g in zip(x[:-1], got):
            want = (math.log1p(v) if lam == 0 else ((v + 1) ** lam - 1) / lam) if v >= 0 else (-math.log1p(-v) if lam == 2 else -((1 - v) ** (2 - lam) - 1) / (2 - lam))
            assert g == pytest.approx(want, abs=1e-12)
        assert got[-1] is None


def test_row_names(spark):
    assert column(spark, ["A", "P", "AA", "AF", "h"], names.row_index, "string") == [0, 15, 26, 31, 7]
    assert column(spark, [0, 15, 26, 31, 51, 52], names.row_name, "int") == ["A", "P", "AA", "AF", "AZ", "BA"]
    assert column(spark, ["B07", " c12 ", "7B", None], names.well_row, "string") == [1, 2, None, None]
    assert column(spark, ["B07", " c12 ", "7B", None], names.well_col, "string") == [6, 11, None, None]


def test_object_ids_keep_dashes_of_the_plate(spark):
    df = spark.createDataFrame([("bc-1-A03-17",)], "uid string")
    assert df.select(*names.object_parts(F.col("uid"))).first()[:] == ("bc-1", "A03", "17")


def test_natural_order(spark):
    want = ["d1", "D2", "d10", "e1"]
    assert names.natural_sorted(["d10", "e1", "d1", "D2"]) == want
    df = spark.createDataFrame([(x,) for x in ("d10", "e1", "d1", "D2")], "s string")
    assert [r["s"] for r in df.orderBy(names.natural_key(F.col("s"))).collect()] == want


def test_feature_names(spark):
    rows = ["R1__DAPI_mean", "R0__KRT7_T_Q95", "R0__KRT7_area_T", "area", "R2__tab__feat", "A--B_PearsonR"]
    df = spark.createDataFrame([(r,) for r in rows], "f string")
    got = {r["f"]: r for r in df.select("f", *[c.alias(k) for k, c in names.parse_feature(F.col("f")).items()]).collect()}
    assert got["R1__DAPI_mean"][1:] == (1, "DAPI", "mean", False, "intensity")
    assert got["R0__KRT7_T_Q95"]["thresholded"] and got["R0__KRT7_area_T"]["thresholded"] and got["area"]["kind"] == "morphology"
    assert got["R2__tab__feat"]["kind"] == "table" and got["A--B_PearsonR"]["kind"] == "correlation"


def test_condition_label(spark):
    df = spark.createDataFrame([("a", None)], "m string, o string")
    assert df.select(names.condition_label("m", "o"), names.condition_label()).first()[:] == ("a | nan", "all")


def test_normal_scores_ignore_monotone_changes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(rng.gamma(2, 1, 50))], "i int, v double").withColumn("g", F.lit(0))
    a = {r["i"]: r["score"] for r in stats.normal_scores(df, "v", "g").collect()}
    b = {r["i"]: r["score"] for r in stats.normal_scores(df.withColumn("v", F.exp("v")), "v", "g").collect()}
    assert a == pytest.approx(b)

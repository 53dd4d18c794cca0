import math

from pyspark.sql import functions as F

from wellspring.functions import stats


def test_p_values_and_quantiles_in_the_plan_equal_the_plain_ones(spark):
    rows = [(t, float(df)) for df in (1, 2, 3, 7, 30, 299, 5000) for t in (0.0, 0.3, -1.0, 2.5, 9.0, 60.0)]
    df = spark.createDataFrame(rows, "t double, df double")
    for r in df.select("t", "df", stats.t_p_value(F.col("t"), F.col("df")).alias("p")).collect():
        assert math.isclose(r.p, stats.t_two_sided(r.t, r.df), rel_tol=1e-9, abs_tol=1e-14)
    few = spark.createDataFrame([(float(n),) for n in (1, 4, 25, 1000)], "df double")
    for r in few.select("df", stats.t_quantile(0.05, F.col("df")).alias("q")).collect():
        assert math.isclose(r.q, stats.t_ppf(0.975, r.df), rel_tol=1e-8)


def test_nulls_and_limits(spark):
    df = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (float("nan"), 3.0), (float("inf"), 3.0), (float("-inf"), 3.0)], "t double, df double")
    assert [r.p for r in df.select(stats.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()] == [None, None, None, None, 0.0, 0.0]


def test_log_gamma(spark):
    z = [0.5, 1.0, 1.5, 10.0, 1234.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(stats.log_gamma(F.col("z"))).collect()
    assert all(math.isclose(r[0], math.lgamma(v), rel_tol=1e-12, abs_tol=1e-12) for r, v in zip(got, z))

from pyspark.sql import functions as F

from wellspring.operators import ranking


def test_numbers_follow_the_order_over_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("score"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("part"))
    got = ranking.numbered(df.repartition(7), F.col("score").desc(), F.col("id")).orderBy("rank").collect()
    want = sorted(df.collect(), key=lambda r: (-r.score, r.id))
    assert [(r.id, r.score, r.part) for r in got] == [tuple(r) for r in want]
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (None,), (1,)], "v long")
    got = ranking.numbered(df, F.col("v").asc_nulls_first(), name="n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(None, 1), (None, 2), (1, 3), (1, 4), (1, 5)]
    assert ranking.numbered(df.limit(0), "v").count() == 0


def test_order_statistics_of_groups_ties_and_wild_spreads(spark):
    import random

    rng = random.Random(3)
    rows = [("a", rng.choice([0.0, 1.0, -1.0, 5e-324, 1e300, -1e300, rng.random(), 10.0 ** rng.randint(-200, 200)])) for _ in range(900)]
    rows += [("b", 2.0)] * 300 + [("c", None)] * 3 + [("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ranks = spark.createDataFrame([(g, r) for g in "abcd" for r in (1, 2, 150, 451, 899, 900, 2000)], "g string, rank long")
    got = {(r.g, r["rank"]): r.value for r in ranking.order_statistics(df, "v", ranks, ["g"]).collect()}
    want = {}
    for g in "abcd":
        held = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, r): held[r - 1] for r in (1, 2, 150, 451, 899, 900, 2000) if r <= len(held)}
    assert got == want


def test_quantiles_equal_the_aggregate(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(977)) / 7.0).alias("v"))
    got = {r.g: r.q for r in ranking.quantiles(df, "v", (0.0, 0.01, 0.37, 1.0), ["g"]).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.01, 0.37, 1.0)))).alias("q")).collect():
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[r.g], r.q))
    assert ranking.quantiles(df.where("v IS NULL"), "v", (0.5,)).count() == 0


def test_first_rows_take_ties_by_id_and_all_if_few(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(100)] + [(5, 0)] * 40, "id long, k long").repartition(5)
    got = sorted((r.k, r.id) for r in ranking.first_rows(df, 63, F.col("k"), "id").collect())
    assert got == sorted([(i // 10, i) for i in range(100)] + [(0, 5)] * 40)[:63]
    assert ranking.first_rows(df, 500, F.col("k"), "id").count() == 140

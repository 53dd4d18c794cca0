"""Screens of more wells, objects and pixels than one plate of the test tables holds."""

import numpy as np
from pyspark.sql import functions as F

from wellspring.functions import stats
from wellspring.operators import filters, image, joins, quality
from wellspring.operators.ranking import value_ranks
from wellspring.plans import screen, views


def test_wells_beyond_the_alphabet_are_named_as_in_sql(spark):
    keys = [0, 25 * 48, 26 * 48, 58 * 48 + 5, 130 * 48, 1249 * 48 + 47, 60_000]
    k = spark.createDataFrame([(n,) for n in keys], "k long").withColumn("well", views.well_name(F.floor(F.col("k") / 48), F.col("k") % 48))
    got = k.select("k", "well", views.well_row(F.col("well")), views.well_col(F.col("well"))).collect()
    assert [tuple(r) for r in got] == [(n, chr(65 + n // 48) + f"{n % 48 + 1:02d}", n // 48, n % 48) for n in keys]


def test_the_row_that_looks_like_a_byte_order_mark_keeps_its_letter(spark):
    key = (0xFEFF - 65) * 48 + 30
    well = views.well_name(F.floor(F.col("k") / 48), F.col("k") % 48)
    got = spark.createDataFrame([(key,)], "k long").select(well.alias("well")).select("well", views.well_row(F.col("well")), views.well_col(F.col("well"))).first()
    assert tuple(got) == ("\ufeff31", key // 48, 30)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_count_scores_gather_no_list_of_a_group(spark):
    wells = spark.range(3000).select(F.lit("P").alias("plate"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("well"), (F.col("id") % 2).cast("string").alias("condition"), (F.col("id") * 7919 % 41).alias("n_organoids"))
    got = quality.count_scores(wells)
    assert "collect_list" not in plan(got)
    pdf = wells.where("n_organoids > 0").toPandas()
    pdf["v"] = np.log1p(pdf["n_organoids"].astype(float))
    groups = {c: g["v"].to_numpy() for c, g in pdf.groupby("condition")}
    at = {c: {w: i for i, w in enumerate(g["well"])} for c, g in pdf.groupby("condition")}
    pdf["r"] = [v - np.median(np.delete(groups[c], at[c][w])) for w, c, v in zip(pdf["well"], pdf["condition"], pdf["v"])]
    spread = 1.4826 * np.median(np.abs(pdf["r"] - np.median(pdf["r"])))
    want = dict(zip(pdf["well"], pdf["r"] / spread))
    found = {r["well"]: r["count_z"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[w] - want[w]) < 1e-9 for w in want)


def test_pixels_are_not_joined_with_themselves(spark, sf):
    px = views.pixels(spark, sf)
    for got in (joins.pair_correlations(px), image.raw_moments(px, 2, True, ("object_id", "channel")), image.straight_edges(px)):
        assert "Join" not in plan(got)


def test_few_objects_are_dealt_over_tasks(spark, sf):
    assert views.pixels(spark, sf).rdd.getNumPartitions() >= 4 and views.crops(spark, sf).rdd.getNumPartitions() >= 4


def test_the_panel_meets_the_pixels_not_the_other_way_round(spark, sf):
    stains = spark.createDataFrame([(0, 1, "DAPI"), (0, 2, "KRT7")], "round int, channel int, stain string")
    got = image.estimate_thresholds(views.pixels(spark, sf).where("object_id < 3"), stains)
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in physical and "BuildLeft" not in physical
    one = views.pixels(spark, sf).where("object_id = 1 AND channel = 2").toPandas()
    img = np.zeros((21, 21))
    img[one["y"], one["x"]] = one["value"]
    raw = got.where("stain = 'KRT7'").first()["raw"]
    assert len(raw) == 3 and image.triangle_threshold(image.gaussian_blur(img, 3.0).ravel()) in raw


def test_image_sizes_do_not_bring_a_plate_to_one_task(spark):
    o = spark.createDataFrame([("a", 0.0, 1.0, 2.0, 3.0), ("a", 5.0, 0.0, 1.0, 1.0), (None, 7.0, 7.0, 1.0, 2.0)], "plate string, x_um double, y_um double, len_x_um double, len_y_um double")
    got = filters.with_image_size(o)
    assert "Window" not in plan(got)
    assert sorted((r["plate"] or "", r["x_um"], r["width"], r["height"]) for r in got.collect()) == [("", 7.0, 8.0, 9.0), ("a", 0.0, 6.0, 4.0), ("a", 5.0, 6.0, 4.0)]


def test_points_of_one_file_are_dealt_over_tasks(spark):
    point = lambda n: spark.range(0, n, 1, 1).select(F.lit("P").alias("plate"), "id", (F.col("id") % 5).cast("double").alias("x"), F.lit(0.0).alias("y"))
    found = joins.range_pairs(point(40), point(30), 5.0, keys=("plate",))
    assert "RepartitionByExpression" in plan(found)
    assert found.count() == found.distinct().count() == 40 * 30


def test_normal_scores_bring_no_group_to_one_task(spark):
    df = spark.range(0, 4000, 1, 3).select("id", F.when(F.col("id") % 4 > 0, F.lit("p")).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 977) / 8).alias("v"))
    got = stats.normal_scores(df, "v", "k")
    assert got.columns == ["id", "k", "v", "score"]
    old = df.where("v IS NOT NULL").withColumn("r", stats.avg_rank("v", "k")).withColumn("n", F.expr("count(*) OVER (PARTITION BY k)"))
    want = {r["id"]: r["s"] for r in old.select("id", stats.normal_ppf((F.col("r") - 0.5) / F.col("n")).alias("s")).collect()}
    found = {r["id"]: r["score"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-14 for i in want)
    parts = value_ranks(df, "v", ["k"])
    assert sorted(r["n"] for r in parts.groupBy("k").agg(F.max("n").alias("n")).collect()) == sorted(r["n"] for r in df.where("v IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).collect())
    windows = [line for line in plan(parts).splitlines() if "Window [sum(__c" in line]
    assert windows and all("[__part" in line for line in windows)


def test_names_of_complete_features_go_to_the_rows(spark, sf):
    long = views.long_li(spark, sf).withColumn("value", F.when(~((F.col("feature") == "l_tax") & (F.col("value") > 0.07)), F.col("value")))
    got = screen.on_complete_features(long)
    assert "strategy=broadcast" in plan(got)
    assert {r["feature"] for r in got.select("feature").distinct().collect()} == {"l_quantity", "l_extendedprice", "l_discount"}

"""Operators against hand-checkable cases and brute force in NumPy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellspring.operators import embedding, filters, image, joins, neighbours, normalize, outliers, presentation, quality, sampling, selection


def long_frame(spark, rows):
    """rows: plate, well, condition, is_control, feature, value."""
    return spark.createDataFrame(rows, "plate string, well string, condition string, is_control boolean, feature string, value double")


def screen(seed=0, plates=2, wells=8, objects=12, shift=None):
    rng = np.random.default_rng(seed)
    rows = []
    for p, w, f in itertools.product(range(plates), range(wells), ("f_mean", "g_mean")):
        cond = "ctrl" if w % 4 == 0 else f"c{w % 4}"
        for _ in range(objects):
            rows.append((f"P{p}", f"A{w + 1:02d}", cond, cond == "ctrl", f, float(rng.normal() + (shift or {}).get((p, w, f), 0.0))))
    return rows


def test_filter_with_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 5.0, 10.0, None])], "i int, v double")
    kept, removed = filters.split_by_reason(df, filters.range_reason("v", 2, 10), "s")
    assert sorted(r["i"] for r in kept.collect()) == [1, 2, 3] and [r["reason"] for r in removed.collect()] == ["v < 2"]
    kept, removed = filters.split_by_reason(df, filters.range_reason("v", 2, 9, keep_missing=False), "s", ["i"])
    assert {r["i"]: r["reason"] for r in removed.collect()} == {0: "v < 2", 2: "v > 9", 3: "v missing"} and kept.count() == 1
    assert filters.append_removed(removed, removed).count() == 6


def test_control_mask(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "m string, c string")
    assert [r[0] for r in df.select(filters.control_mask({"m": "a", "c": "x"})).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        filters.control_mask({})


def test_border(spark):
    rows = [("P", 0.0, 5.0, 2.0, 2.0), ("P", 5.0, 0.5, 2.0, 2.0), ("P", 8.0, 8.0, 2.0, 2.0), ("P", 4.0, 4.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "plate string, x_um double, y_um double, len_x_um double, len_y_um double")
    kept, removed = filters.remove_cut_objects(df, 1.0)
    assert [r["x_um"] for r in kept.collect()] == [4.0] and {r["reason"] for r in removed.collect()} == {"left", "top", "right, bottom"}
    stored = spark.createDataFrame([("P", 100.0, 100.0)], "plate string, width double, height double")
    assert filters.remove_cut_objects(df, 1.0, stored)[0].count() == 2


def test_outgrowth_counts_cut_and_empty_wells(spark):
    cols = "plate string, well string, medium string, cell_line string, other string"
    layout = spark.createDataFrame([("P", "A01", "m", "c", "d1"), ("P", "A02", "m", "c", "d1")], cols)
    obj = spark.createDataFrame([("P", "A01", "m", "c", "d1")] * 3, cols)
    cut = spark.createDataFrame([("P", "A01", "m", "c", "d1", "cut off"), ("P", "A01", "m", "c", "d1", "size")], cols + ", step string")
    got = {r["well"]: (r["organoid_no"], r["pct_outgrowth"]) for r in filters.outgrowth(obj, layout, 10, cut).collect()}
    assert got == {"A01": (4, 40.0), "A02": (0, 0.0)}


def test_cliffs_delta(spark):
    rows = [("P", "A", "c", False, "f", v) for v in (3.0, 4.0, 5.0)] + [("P", "B", "c", False, "f", v) for v in (1.0, 2.0, 3.0)]
    got = {r["well"]: r for r in quality.well_deltas(long_frame(spark, rows), 3).collect()}
    assert got["A"]["delta"] == pytest.approx(8 / 9) and got["B"]["delta"] == pytest.approx(-8 / 9) and got["A"]["variance"] == pytest.approx(7 / 27)
    assert all(r["delta"] is None for r in quality.well_deltas(long_frame(spark, rows), 4).collect())


def test_cliffs_delta_brute_force_and_monotone(spark):
    rows = screen(3)
    pdf = pd.DataFrame(rows, columns=["plate", "well", "condition", "is_control", "feature", "value"])
    got = {(r["plate"], r["well"], r["feature"]): r["delta"] for r in quality.well_deltas(long_frame(spark, rows)).collect()}
    for (p, c, f), g in pdf.groupby(["plate", "condition", "feature"]):
        for w, own in g.groupby("well"):
            rest = g[g.well != w].value.to_numpy()
            assert got[p, w, f] == pytest.approx(np.sign(own.value.to_numpy()[:, None] - rest[None]).mean(), abs=1e-12)
    moved = {(r["plate"], r["well"], r["feature"]): r["delta"] for r in quality.well_deltas(long_frame(spark, rows).withColumn("value", F.exp("value"))).collect()}
    assert moved == pytest.approx(got)


def test_planted_well_is_flagged(spark):
    rows = screen(1, 1, 24, 15, {(0, 5, f): -6.0 for f in ("f_mean", "g_mean")})
    long = long_frame(spark, rows)
    wells = quality.well_table(long.where("feature = 'f_mean'"), spark.createDataFrame([("P0", "A06", 15), ("P0", "H12", 0)], "plate string, well string, organoid_no long"))
    flags = {r["well"]: r for r in quality.well_flags(long, wells).collect()}
    assert flags["A06"]["flagged"] and "stain dropout: f_mean (d=-1.00), g_mean (d=-1.00)" in flags["A06"]["reasons"] and flags["A06"]["deviating_fraction"] == 1.0
    assert flags["H12"]["condition"] == "unknown" and flags["H12"]["reasons"] == "no organoids"
    assert not flags["A02"]["flagged"]
    marked = quality.mark_flagged(long, quality.well_flags(long, wells))
    assert {r["well"] for r in marked.where("NOT well_qc_pass").select("well").distinct().collect()} == {"A06"}
    assert quality.mark_flagged(long, quality.well_flags(long, wells), remove=True).count() == long.count() - 30


def test_count_scores_leave_the_well_out(spark):
    counts = [5, 7, 9, 40]
    rows = [("P", f"A{i:02d}", "c", False, "f", 0.0) for i, n in enumerate(counts) for _ in range(n)]
    got = {r["well"]: r["count_z"] for r in quality.count_scores(quality.well_table(long_frame(spark, rows))).collect()}
    v = np.log1p(counts)
    res = np.array([v[i] - np.median(np.delete(v, i)) for i in range(4)])
    s = 1.4826 * np.median(np.abs(res - np.median(res)))
    assert [got[f"A{i:02d}"] for i in range(4)] == pytest.approx(list(res / s))


def test_ring_of_border_wells(spark):
    wells = lambda names: spark.createDataFrame([("P", n) for n in names], "plate string, well string")
    block = [f"{r}{c:02d}" for r in "BCD" for c in (2, 3, 4)]
    full = {r["well"]: r["ring"] for r in quality.well_geometry(wells(block)).collect()}
    assert not full["C03"] and sum(full.values()) == 8
    hollow = {r["well"]: r for r in quality.well_geometry(wells([b for b in block if b != "C03"])).collect()}
    assert all(r["ring"] for r in hollow.values()) and len(hollow) == 8
    assert (hollow["B02"]["rows"], hollow["B02"]["cols"]) == (4, 6) or hollow["B02"]["rows"] >= 4


def test_position_effects_recover_a_slope(spark):
    rng = np.random.default_rng(0)
    wells = [(f"{chr(65 + r)}{c + 1:02d}", r, c) for r in range(8) for c in range(12)]
    geo = quality.well_geometry(spark.createDataFrame([("P", w) for w, _, _ in wells], "plate string, well string"))
    d = spark.createDataFrame([("P", w, "f", float(0.5 * (r / 7 - 0.5) + 0.01 * rng.normal())) for w, r, _ in wells], "plate string, well string, feature string, delta double")
    e = quality.position_effects(d, geo).first()
    assert e["row"] == pytest.approx(0.5, abs=0.02) and e["row_p"] < 1e-10 and abs(e["col"]) < 0.02 and e["n_wells"] == 96 and e["row_fdr"] <= 1
    assert presentation.estimates(quality.position_effects(d, geo)).count() == 3


def test_saturation_uses_exact_channels(spark):
    rows = [("P", "A01", "c", False, f"{ch}_max", v) for ch, vs in (("R0__DAPI", [255.0] * 5 + [1.0] * 5), ("R0__DAPI_2", [255.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0])) for v in vs]
    sat = quality.saturation(long_frame(spark, rows), 255.0, max_fraction=0.2)
    assert {r["channel"]: (r["saturated_fraction"], r["flagged"]) for r in sat.collect()} == {"R0__DAPI": (0.5, True), "R0__DAPI_2": (0.1, False)}
    feats = spark.createDataFrame([("R0__DAPI_max",), ("R0__DAPI_Q99",), ("R0__DAPI_2_max",), ("R0__DAPI_mean",)], "feature string")
    assert sorted(r["feature"] for r in quality.saturated_features(feats, sat).collect()) == ["R0__DAPI_Q99", "R0__DAPI_max"]


def test_label_swap_is_flagged(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):
        cond = "a" if i < 15 else "b"
        true = "b" if i == 3 else cond
        rows.append(("P", f"w{i:02d}", cond, False, ([0.0, 0.0] + rng.normal(0, 0.3, 2) + (6.0 if true == "b" else 0.0)).tolist()))
    v = spark.createDataFrame(rows, "plate string, well string, condition string, control boolean, vec array<double>")
    got = {r["well"]: r for r in quality.label_consistency(v).collect()}
    assert got["w03"]["flagged"] and got["w03"]["closest_other_condition"] == "b" and sum(r["flagged"] for r in got.values()) == 1


def test_activity_finds_the_active_condition(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p, i in itertools.product(("P", "Q"), range(18)):
        cond = "ctrl" if i < 8 else ("act" if i < 13 else "null")
        rows.append((p, f"w{i:02d}", cond, cond == "ctrl", (rng.normal(0, 1, 6) + (4.0 if cond == "act" else 0.0)).tolist()))
    v = spark.createDataFrame(rows, "plate string, well string, condition string, control boolean, vec array<double>")
    got = {r["condition"]: r for r in quality.phenotypic_activity(v, 300).collect()}
    assert got["act"]["active"] and got["act"]["mAP"] > 0.95 and got["act"]["n_plates"] == 2 and got["act"]["n_wells"] == 10
    assert not got["null"]["active"] and 0 < got["null"]["chance_mAP"] < got["act"]["mAP"]


def test_batch_effects_shrink_after_normalisation(spark):
    rows = screen(5, 3, 12, 20)
    rows = [(p, w, c, k, f, v + 5.0 * int(p[1])) for p, w, c, k, f, v in rows]
    long = normalize.scale(long_frame(spark, rows))
    for r in quality.batch_effects(long).collect():
        assert r["control_before"] > 0.9 and r["others_before"] > 0.9 and r["others_after"] < 0.6 and r["plates"] == 3


def test_assay_window(spark):
    rows = [("P", f"w{i}", "f", v, c) for c, vs in (("pos", [10.0, 11.0, 12.0]), ("neg", [0.0, 1.0, 2.0])) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "plate string, well string, feature string, value double, condition string")
    r = quality.assay_window(df, F.col("condition") == "pos", F.col("condition") == "neg").first()
    assert r["z_prime"] == pytest.approx(1 - 3 * 2 / 10) and r["ssmd"] == pytest.approx(10 / math.sqrt(2)) and r["n_plates"] == 1


def test_scalers_centre_controls(spark):
    long = long_frame(spark, screen(2) + [("P0", "A01", "ctrl", True, "flat", 3.0)] * 4 + [("P0", "A02", "c1", False, "flat", 5.0)])
    s = normalize.scale(long)
    assert all(r["ok"] for r in normalize.control_check(s).collect())
    assert {r["z_scaled"] for r in s.where("feature = 'flat' AND value = 5").collect()} == {2.0}
    bad = normalize.groups_without_controls(long.unionByName(long_frame(spark, [("P9", "A01", "x", False, "f", 1.0)])))
    assert [(r["plate"], r["feature"]) for r in bad.collect()] == [("P9", "f")]
    lone = long.unionByName(long_frame(spark, [("P9", "A01", "x", False, "f", 1.0)]))
    with pytest.raises(ValueError, match="no control values"):
        normalize.normalize_groups(lone)
    assert normalize.normalize_groups(lone, strict=False).where("plate = 'P9'").first()["z_scaled"] is None


def test_skew_decisions(spark):
    rng = np.random.default_rng(0)
    kinds = {"gamma": rng.gamma(1, 2, 400), "normal": rng.normal(10, 1, 400), "neg": rng.gamma(1, 2, 400) - 1, "left": 30 - rng.gamma(1, 2, 400), "few": rng.gamma(1, 1, 5)}
    long = long_frame(spark, [("P", "w", "c", True, k, float(v)) for k, vs in kinds.items() for v in vs])
    got = {r["feature"]: r["decision"] for r in normalize.skew_decision(long).collect()}
    assert got == {"gamma": "transform", "normal": "not skewed", "neg": "negative values", "left": "left-skewed", "few": "not testable"}
    fit = {r["feature"]: r for r in normalize.yeo_johnson_decision(normalize.fit_yeo_johnson(long)).collect()}
    assert fit["gamma"]["decision"] == "transform" and abs(fit["gamma"]["skew_transformed"]) < 0.3 and 0 <= fit["gamma"]["lambda"] <= 2 and fit["few"]["decision"] == "not testable"
    for kind in ("log1p", "yeo-johnson", None):
        out = normalize.normalize_groups(long, transform=kind)
        assert {"transformed", "robust_scaled", "z_scaled", "minmax_scaled"} <= set(out.columns) and out.count() == long.count()
    with pytest.raises(ValueError):
        normalize.apply_transform(long, normalize.skew_decision(long), "sqrt")


def test_trim_is_inclusive(spark):
    long = long_frame(spark, [("P", "w", "c", False, "f", float(v)) for v in [1, 1, 1, 2, 3, 4, 5, 9, 9, 9]])
    r = quality.trimmed_well_means(long).first()
    assert r["value"] == pytest.approx(np.mean([1, 1, 1, 2, 3, 4, 5, 9, 9, 9]))


def greedy(pairs):
    used1, used2, out = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in used1 and b not in used2:
            used1.add(a)
            used2.add(b)
            out.add((a, b))
    return out


def test_greedy_matching(spark):
    pt = lambda rows: spark.createDataFrame(rows, "plate string, well string, id int, x double, y double")
    m, lost = joins.match_one_to_one(pt([("P", "A", 0, 0.0, 0.0), ("P", "A", 1, 1.0, 0.0)]), pt([("P", "A", 9, 0.9, 0.0)]), 2.0)
    assert [(r["id1"], r["id2"]) for r in m.collect()] == [(1, 9)] and [r["id"] for r in lost.collect()] == [0]
    with pytest.raises(ValueError):
        joins.match_one_to_one(pt([("P", "A", 0, 0.0, 0.0)]), pt([("P", "A", 9, 50.0, 0.0)]), 2.0)
    rng = np.random.default_rng(7)
    a = [("P", "A", i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (40, 2)))]
    b = [("P", "A", i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (40, 2)))]
    pairs = [(p[2], q[2], math.hypot(p[3] - q[3], p[4] - q[4])) for p in a for q in b if math.hypot(p[3] - q[3], p[4] - q[4]) <= 3]
    got = joins.range_pairs(pt(a), pt(b), 3.0)
    assert sorted((r["id1"], r["id2"]) for r in got.collect()) == sorted((x, y) for x, y, _ in pairs)
    assert {(r["id1"], r["id2"]) for r in joins.greedy_match(got).collect()} == greedy(pairs)
    both = joins.merge_matched(pt(a), pt(b), joins.greedy_match(got))
    assert "A_x" in both.columns and "B_x" in both.columns
    with pytest.raises(ValueError):
        joins.merge_matched(pt(a), pt(b), got, prefix_a="Z_", prefix_b="Z_")


def test_rounds_and_zip(spark):
    a = spark.createDataFrame([("o1", "P", 1.0), ("o2", "P", 2.0)], "object_id string, plate string, v double")
    b = spark.createDataFrame([("o2", "P", 5.0), ("o3", "P", 6.0)], "object_id string, plate string, v double")
    out = joins.merge_rounds({0: a, 1: b}, shared=["plate"])
    assert out.count() == 3 and out.where("plate IS NULL").count() == 0 and out.where("object_id = 'o3'").first()["R0__v"] is None
    assert joins.merge_rounds({0: a, 1: b}, "inner", shared=["plate"]).count() == 1
    with pytest.raises(ValueError):
        joins.merge_rounds({0: a}, "left")
    t = spark.createDataFrame([("P", "A", "1", 1.0), ("P", "A", "2", 2.0)], "plate string, well string, label string, a double")
    assert joins.zip_tables([t, t.withColumnRenamed("a", "b")]).count() == 2
    with pytest.raises(Exception, match="same objects"):
        joins.zip_tables([t, t.where("label = '1'").withColumnRenamed("a", "b")]).collect()


def test_folders(spark):
    p = spark.createDataFrame([("P-1", None)], "plate string, hint string")
    f = lambda *x: spark.createDataFrame([(s,) for s in x], "folder string")
    assert joins.resolve_folders(p, f("/d/p_1.zarr", "/d/p_2.zarr")).first()["folder"] == "/d/p_1.zarr"
    assert joins.resolve_folders(p, f("/d/p_1a", "/d/p_1b")).first()["problem"] == "several folders"
    assert joins.resolve_folders(p, f("/d/x")).first()["problem"] == "no folder"
    two = spark.createDataFrame([("P-1", None), ("P_1", None)], "plate string, hint string")
    assert {r["problem"] for r in joins.resolve_folders(two, f("/d/p1")).collect()} == {"folder claimed twice"}


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)).round(1)
    v = spark.createDataFrame([(i, r.tolist(), "ab"[i % 2]) for i, r in enumerate(x)], "id int, vec array<double>, label string")
    rows = lambda n: sorted((r["src"], r["rank"], r["dst"]) for r in joins.knn_edges(v, v, 4, same=True, blocks=n).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = sorted((i, k + 1, int(j)) for i in range(50) for k, j in enumerate(sorted(range(50), key=lambda j: (d[i, j], j))[:4]))
    assert rows(1) == want == rows(7)
    assert joins.knn_label_transfer(v.where("id < 30"), v.where("id >= 30"), "label", 5).count() == 20


def test_lof_and_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 2)), [[15.0, 15.0]]])
    v = spark.createDataFrame([("P", "c", i, r.tolist()) for i, r in enumerate(x)] + [("P", "small", 99, [0.0, 0.0])], "plate string, condition string, object_id int, vec array<double>")
    got = {r["object_id"]: r for r in outliers.find_outliers(v, 10).collect()}
    assert got[40]["organoid_outlier"] and sum(r["organoid_outlier"] for r in got.values()) == 1 and got[99]["outlier_score"] is None
    assert outliers.score_histogram(outliers.find_outliers(v, 10)).agg(F.sum("n")).first()[0] == 41
    same = spark.createDataFrame([("P", "c", i, [1.0, 1.0]) for i in range(12)], "plate string, condition string, object_id int, vec array<double>")
    assert {round(r["outlier_score"], 6) for r in outliers.find_outliers(same, 5).collect()} == {1.0}


def test_sampling(spark):
    df = spark.range(100).select(F.col("id").alias("object_id"), (F.col("id") % 3).alias("g"))
    a = {r["object_id"] for r in sampling.sample_n(df, 10).collect()}
    assert len(a) == 10 and a == {r["object_id"] for r in sampling.sample_n(df.repartition(7), 10).collect()} and a != {r["object_id"] for r in sampling.sample_n(df, 10, seed=1).collect()}
    assert sampling.sample_fraction(df, 0.125).count() == 12 and sampling.sample_fraction(df, 1e-9).count() == 1
    assert sampling.sample_per_group(df, 5, ["g"]).count() == 15
    v = df.withColumn("vec", F.array((F.col("object_id") % 10).cast("double"), F.lit(0.0)))
    assert sampling.geometric_sketch(v, 10).select("vec").distinct().count() >= 8
    with pytest.raises(ValueError):
        sampling.sample_n(df, 0)
    with pytest.raises(ValueError):
        sampling.sample_fraction(df, 1.5)


def test_feature_selection(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n, (p, w, i) in enumerate(itertools.product(range(2), range(16), range(10))):
        cond = f"c{w % 4}"
        base = float(w % 4) * 3 + rng.normal()
        vals = {"good": base, "twin": base * 2 + 1e-3 * rng.normal(), "const": 1.0, "noise_hole": None if i == 0 else rng.normal(), "plate_name": base + rng.normal(), "by_well": 50.0 * (w * 7 % 16) + rng.normal(), "noise": rng.normal()}
        rows += [(n, f"P{p}", f"A{w:02d}", cond, f, None if v is None else float(v)) for f, v in vals.items()]
    long = spark.createDataFrame(rows, "object_id long, plate string, well string, condition string, feature string, value double")
    got = {r["feature"]: r for r in selection.select_features(long, ["plate"]).collect()}
    reason = {k: r["reason"] for k, r in got.items()}
    assert reason["const"] == "near-constant" and reason["noise_hole"] == "missing values" and reason["plate_name"] == "removed by name"
    assert reason["by_well"] == "well effect" and got["by_well"]["well_effect"] > 0.85 and got["good"]["well_effect"] < 0.3 and got["const"]["well_effect"] is None
    assert sorted(reason[k] for k in ("good", "twin")) in (["kept", "redundant with good"], ["kept", "redundant with twin"])
    free = {r["feature"]: r["reason"] for r in selection.select_features(long, max_effect=None, min_reliability=None, max_corr=None).collect()}
    assert {k for k, v in free.items() if v == "kept"} == {"good", "twin", "plate_name", "by_well", "noise"}


def test_activity_null_keeps_wells_that_resemble_one_another(spark):
    """Wells come in groups that look alike, whatever their condition: the null must not call them active."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):  # each condition meets controls of a plate of its own
        centres = rng.normal(size=(4, 5))
        for i in range(26):
            rows.append((f"P{c:02d}", f"w{i:02d}", f"c{c:02d}" if i < 6 else "ctrl", i >= 6, (centres[rng.integers(4)] + 0.2 * rng.normal(size=5)).tolist()))
    v = spark.createDataFrame(rows, "plate string, well string, condition string, control boolean, vec array<double>")
    p = [r["p"] for r in quality.phenotypic_activity(v, 200, centred=True).collect()]
    assert len(p) == 60 and sum(x <= 0.05 for x in p) <= 8 and 0.35 < np.mean(p) < 0.65


def test_precisions_against_plain_ones():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 3))
    x[4] = 0
    with np.errstate(invalid="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = rng.random((6, 12)) < 0.4
    got = quality._precisions(unit, labels)
    for r, i in itertools.product(range(6), range(12)):
        order = sorted((j for j in range(12) if j != i), key=lambda j: -np.nan_to_num(unit[i] @ unit[j], nan=-np.inf))
        hits = [labels[r, j] for j in order]
        want = [sum(hits[: n + 1]) / (n + 1) for n, h in enumerate(hits) if h]
        assert np.isnan(got[r, i]) if not labels[r, i] or not want else np.isclose(got[r, i], np.mean(want))


def test_plate_formats(spark):
    wells = lambda *w: spark.createDataFrame([("P", x) for x in w], "plate string, well string")
    got = quality.well_geometry(wells("A01", "C03"), 384).first()
    assert (got["rows"], got["cols"]) == (16, 24) and quality.well_geometry(wells("A01", "C03")).first()["rows"] == 3
    for bad, size in ((wells("A01", "?"), None), (wells("A01"), 100), (wells("C03"), 6)):
        with pytest.raises(ValueError):
            quality.well_geometry(bad, size)


def test_neighbours_of_large_groups_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(330, 4))
    group = np.where(np.arange(330) < 260, "a", "b")
    v = spark.createDataFrame([(i, str(g), r.tolist()) for i, (g, r) in enumerate(zip(group, x))], "id long, g string, vec array<double>")
    got = joins.knn_edges(v, v, 3, keys=("g",), same=True).toPandas()
    assert len(got) == 990
    for i in range(330):
        d = np.where((group == group[i]) & (np.arange(330) != i), np.linalg.norm(x - x[i], axis=1), np.inf)
        assert got[got.src == i].sort_values("rank").dst.tolist() == np.argsort(d)[:3].tolist()


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1]) + 7
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    m = embedding.pca_fit(df, list("abcd"), 2)
    s = np.array([r["x_pca"] for r in embedding.pca_scores(df, m).collect()])
    u, d, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(s), np.abs((x - x.mean(0)) @ v[:2].T), atol=1e-8) and np.allclose(m.ratio, (d**2 / (d**2).sum())[:2])
    assert m.loadings(spark).count() == 8 and len(embedding.pca_fit(df, list("abcd"), variance=0.5).components) == 1
    with pytest.raises(ValueError):
        embedding.pca_fit(df, list("abcd"), 9)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in (0, 6, 12)])
    return spark.createDataFrame([(i, r.tolist(), str(i // 40)) for i, r in enumerate(x)], "object_id int, vec array<double>, truth string").cache()


def test_clusters(spark, blobs):
    k = embedding.kmeans(blobs, 3, starts=3).groupBy("truth").agg(F.count_distinct("cluster").alias("k"), F.min("cluster").alias("c")).collect()
    assert all(r["k"] == 1 for r in k) and len({r["c"] for r in k}) == 3
    g = embedding.jaccard_graph(joins.knn_edges(blobs, blobs, 10, "object_id", "object_id", same=True)).cache()
    found = embedding.phenograph(blobs, 10, min_size=3).cache()
    pure = found.join(blobs.withColumnRenamed("object_id", "id"), "id").groupBy("cluster").agg(F.count_distinct("truth").alias("k"))
    assert 3 <= pure.count() <= 12 and pure.where("k > 1").count() == 0
    truth = embedding.modularity(g, blobs.select(F.col("object_id").alias("id"), F.col("truth").alias("cluster")))
    assert truth > 0.6 and embedding.modularity(g, found) > truth - 0.02
    assert {r["cluster"] for r in embedding.phenograph(blobs, 10, min_size=1000).collect()} == {"-1"}


def test_layouts_keep_blobs_apart(spark, blobs):
    for fn, col in ((lambda: embedding.tsne(blobs, 15, steps=300), "x_tsne"), (lambda: embedding.umap(blobs, 10, epochs=60), "x_umap"), (lambda: embedding.diffusion_map(blobs, 2, 10), "x_diffmap")):
        p = fn().toPandas().sort_values("id")
        y, t = np.stack(p[col]), np.arange(120) // 40
        cent = np.stack([y[t == k].mean(0) for k in range(3)])
        assert (((y[:, None] - cent[None]) ** 2).sum(-1).argmin(1) == t).mean() > 0.95, col
    with pytest.raises(ValueError):
        embedding.tsne(blobs, max_rows=10)
    sample = blobs.where("object_id % 2 = 0")
    fitted = sample.select(F.col("object_id").alias("id"), F.col("vec").alias("x_emb"))
    moved = embedding.carry_over(blobs, fitted, sample, "x_emb").toPandas().sort_values("id")
    truth = blobs.toPandas().sort_values("object_id")
    assert np.abs(np.stack(moved.x_emb) - np.stack(truth.vec)).mean() < 0.5


def test_layouts_cover_every_row(blobs):
    n = blobs.count()
    whole = embedding.sweep(blobs, embedding.umap, "x_umap", [{"n_neighbors": 10, "epochs": 30}, {"n_neighbors": 5, "epochs": 30}], 10_000)
    assert whole.count() == 2 * n and whole.where("last").select("settings").distinct().first()[0] == "n_neighbors=5, epochs=30"
    part = embedding.laid_out(blobs, embedding.diffusion_map, "x_diffmap", n // 2, n_comps=2, k=10)
    assert part.count() == n == part.select("id").distinct().count() and part.where("size(x_diffmap) <> 2").isEmpty()
    with pytest.raises(ValueError):
        embedding.sweep(blobs, embedding.umap, "x_umap", [], 100)
    got = embedding.kmeans_sweep(blobs, [2, 3], starts=2)
    assert got.select("cluster_k2").distinct().count() == 2 and got.where("cluster <> cluster_k3").isEmpty() and got.select("cluster").distinct().count() == 3


def test_lineages(blobs):
    df = blobs.withColumnRenamed("truth", "cluster")
    assert {frozenset(e[:2]) for e in embedding.cluster_tree(df)} == {frozenset("01"), frozenset("12")}
    p = embedding.lineages(df, "0").toPandas()
    assert p.lineage.unique().tolist() == [1] and 0 <= p.pseudotime.min() and p.pseudotime.max() <= 1
    assert p.groupby(p.id // 40).pseudotime.mean().is_monotonic_increasing


def disk(r, pad=3):
    n = 2 * (r + pad) + 1
    y, x = np.mgrid[:n, :n] - (r + pad)
    return np.hypot(y, x) <= r


def test_square(spark):
    rows = [("o", 0, 1, y, x, 1.0, 5 <= y < 15 and 5 <= x < 15) for y in range(20) for x in range(20)]
    px = spark.createDataFrame(rows, "object_id string, round int, channel int, y int, x int, value double, in_mask boolean")
    r = image.morphology(px, sigma=0.5).first()
    assert (r["area"], r["extent"], r["solidity"], round(r["eccentricity"], 9), r["area_convex"]) == (100.0, 1.0, 1.0, 0.0, 100.0)
    e = image.straight_edges(px).first()
    assert e["StraightEdge_longest_fraction"] == 1.0 and e["StraightEdge_total_fraction"] == 1.0
    assert r["feret_diameter_max"] == pytest.approx(10 * math.sqrt(2)) and r["concavity"] == 0.0
    st = image.intensity_stats(px.withColumn("over_threshold", F.lit(False)), (0.5,)).first()
    assert st["T_mean"] == 0.0 and st["asymmetry"] == 1.0 and st["area_T"] == 0.0
    two = px.withColumn("in_mask", F.col("in_mask") & (F.col("x") != 10))
    assert image.per_object(two, image.shape_features, image.SHAPE).count() == 0


def test_disk_shapes():
    m = disk(30)
    f = image.shape_features(m)
    assert f["perimeter"] == pytest.approx(2 * math.pi * 30.3, rel=0.03) and f["circularity"] == pytest.approx(1, abs=0.05) and f["solidity"] > 0.95 and f["concavity"] < 0.05
    assert image.distance_transform(m).max() == pytest.approx(30.5, abs=0.8)
    bite = m.copy()
    bite[:20, 28:38] = False
    assert image.shape_features(bite)["concavity_count"] >= 1


def test_distance_transform_brute_force():
    rng = np.random.default_rng(0)
    m = np.pad(rng.random((12, 15)) > 0.3, 1)
    out = np.argwhere(~m)
    want = np.array([[np.sqrt(((out - (i, j)) ** 2).sum(1)).min() for j in range(m.shape[1])] for i in range(m.shape[0])])
    assert np.allclose(image.distance_transform(m), want)


def test_labels_and_thinning():
    m = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 0, 1], [1, 1, 1, 1]], dtype=bool)
    assert image.label(m)[1] == 2 and image.label(m, diagonal=True)[1] == 1
    bar = np.zeros((15, 40), dtype=bool)
    bar[5:10, 3:37] = True
    s = image.thin(bar)
    assert s.sum(axis=0).max() == 1 and 25 <= s.sum() <= 34


def test_crypts():
    m = np.pad(disk(20), 40)
    c = m.shape[0] // 2
    m[c - 4 : c + 5, c : c + 55] = True
    f = image.crypt_features(m, sigma=1.0)
    assert f["crypt_count"] >= 1 and f["crypt_length_max"] == pytest.approx(45, abs=8)
    assert image.crypt_features(np.zeros((5, 5), dtype=bool))["crypt_count"] == 0


def test_triangle_and_blur():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(10, 2, 5000), rng.normal(60, 10, 300)])
    assert 13 < image.triangle_threshold(v) < 45
    img = np.zeros((21, 21))
    img[10, 10] = 1
    b = image.gaussian_blur(img, 2)
    assert b.sum() == pytest.approx(1) and b.argmax() == 220
    assert image.substructures(np.array([[1, 0, 1]], dtype=bool)) == {"substructures_count": 2.0, "substructures_size": 1.0}


def test_thresholds_and_names(spark):
    rng = np.random.default_rng(0)
    rows = [(o, 0, 1, y, x, float(100 if 4 < y < 12 and 4 < x < 12 else rng.normal(10, 1)), True) for o in range(4) for y in range(16) for x in range(16)]
    px = spark.createDataFrame(rows, "object_id int, round int, channel int, y int, x int, value double, in_mask boolean")
    stains = spark.createDataFrame([(0, 1, "DAPI"), (0, 2, "")], "round int, channel int, stain string")
    t = image.estimate_thresholds(px, stains, sigma=1.0)
    assert len(t.first()["raw"]) == 4
    over = image.over_threshold(px, spark.createDataFrame([(0, 1, 50.0)], "round int, channel int, final double"), 1.0)
    st = image.intensity_stats(over, (0.5,)).first()
    assert 40 <= st["area_T"] <= 60 and st["T_mean"] > 80
    with pytest.raises(ValueError):
        image.quantile_names([0.291, 0.289])
    assert image.quantile_name(0.29) == "Q29"


def test_figure_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "i int, x_pca array<double>")
    assert presentation.plot_coordinates(df).first()["plot_y"] == 2.0
    with pytest.raises(ValueError):
        presentation.plot_coordinates(df, "x_umap")

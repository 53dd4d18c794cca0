import numpy as np
import pytest

from wellspring.operators import crops, image, joins

SCHEMA = "object_id string, " + crops.CROP
PANEL = "round int, channel int, stain string, final double"


def crop(name, rnd, mask, planes, top=0, left=0):
    h, w = mask.shape
    return (name, rnd, top, left, h, w, mask.ravel().tolist(), list(range(1, len(planes) + 1)), [p.ravel().tolist() for p in planes])


@pytest.fixture(scope="module")
def disc():
    y, x = np.mgrid[:17, :19]
    return (y - 8) ** 2 + (x - 9) ** 2 <= 40


def values(spark, rows, panel, **more):
    df = crops.features(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(panel, PANEL), **more)
    return {(r.object_id, r.feature): r.value for r in df.collect()}


def test_pixels_and_crops_give_the_same(spark, disc):
    rng = np.random.default_rng(0)
    planes = [rng.integers(0, 50, disc.shape).astype(float) for _ in range(3)]
    px = [("a", 0, c + 1, int(y) + 3, int(x) - 2, float(p[y, x]), bool(disc[y, x])) for c, p in enumerate(planes) for y, x in np.ndindex(disc.shape)]
    pixels = spark.createDataFrame(px, "object_id string, round int, channel int, y int, x int, value double, in_mask boolean")
    got = crops.assemble(pixels).collect()
    assert [tuple(r) for r in got] == [crop("a", 0, disc, planes, 3, -2)]
    found = {r.feature: r.value for r in crops.features(crops.assemble(pixels), spark.createDataFrame([(0, c, f"S{c}", 20.0) for c in (1, 2, 3)], PANEL), sigma=1.0, skeleton=False).collect()}
    for name, value in image.mask_geometry(pixels.where("channel = 1")).first().asDict().items():
        assert name == "object_id" or np.isclose(found[name], value, atol=1e-6)
    named = pixels.where("in_mask").selectExpr("object_id", "y", "x", "value", "concat('R0__S', channel) AS channel")
    for r in joins.pair_correlations(named).collect():
        assert np.isclose(found[r.feature], r.r)


def test_odd_crops(spark, disc):
    flat, two, none = np.full(disc.shape, 4.0), disc.copy(), np.zeros(disc.shape, dtype=bool)
    two[8] = False
    rows = [crop("flat", 0, disc, [flat, flat + 1]), crop("two", 0, two, [np.arange(disc.size, dtype=float).reshape(disc.shape), flat]), crop("none", 0, none, [flat, flat]), crop("none", 1, disc, [flat, flat])]
    got = values(spark, rows, [(0, 1, "A", 3.0), (0, 2, "", 1.0), (1, 1, "B", None)], sigma=1.0)
    assert got["flat", "R0__A_mean"] == 4.0 and got["flat", "R0__A_area_T_ratio"] == 1.0 and got["flat", "R0__A_substructures_count"] == 1
    assert got["two", "area"] == two.sum() and got["two", "solidity"] is None and got["two", "R0__A_substructures_count"] == 2
    assert ("none", "area") not in got and ("none", "R0__A_mean") not in got
    assert got["none", "R1__B_T_mean"] == 0.0 and got["none", "R1__B_asymmetry"] == 1.0
    assert not any("_2_" in f or f.endswith("PearsonR") for _, f in got)


def test_correlations_use_pixels_of_both_masks_where_rounds_are_shifted(spark, disc):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, *disc.shape))
    other = np.roll(disc, 2, axis=1)
    got = values(spark, [crop("o", 0, disc, [a, b]), crop("o", 2, other, [b, np.zeros(disc.shape)], top=1, left=-3)], [(0, 1, "A", 9.0), (0, 2, "B", 9.0), (2, 1, "C", 9.0), (2, 2, "Z", 9.0)], sigma=1.0, shape=False, intensity=False)
    pairs = [(a[y, x], b[y - 1, x + 3]) for y, x in np.argwhere(disc) if 0 <= y - 1 < 17 and 0 <= x + 3 < 19 and other[y - 1, x + 3]]
    assert np.isclose(got["o", "R0__A--R2__C_PearsonR"], np.corrcoef(*np.array(pairs).T)[0, 1])
    assert np.isclose(got["o", "R0__A--R0__B_PearsonR"], np.corrcoef(a[disc], b[disc])[0, 1])
    assert got["o", "R0__A--R2__Z_PearsonR"] is None and got["o", "R2__C--R2__Z_PearsonR"] is None


def test_pieces_and_empty_tables(spark, disc):
    two = disc.copy()
    two[8] = False
    df = spark.createDataFrame([crop("a", 0, disc, [disc * 1.0]), crop("b", 0, two, [two * 1.0])], SCHEMA)
    assert {r.object_id: r.pieces for r in crops.pieces(df).collect()} == {"a": 1, "b": 2}
    assert crops.features(df.limit(0), spark.createDataFrame([], PANEL)).count() == 0
    with pytest.raises(ValueError, match="share a name"):
        crops.features(df, spark.createDataFrame([], PANEL), quantiles=(0.5, 0.501))

"""Matching sends no table that grows with the points through the driver."""

import pytest

from wellspring.operators import joins


@pytest.fixture
def no_broadcast(spark):
    """Any broadcast is an error."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def greedy(a, b, radius):
    used, out = set(), set()
    for d, i, j in sorted((((x1 - x2) ** 2 + (y1 - y2) ** 2) ** 0.5, i, j) for _, i, x1, y1 in a for _, j, x2, y2 in b):
        if d <= radius and not {(1, i), (2, j)} & used:
            used |= {(1, i), (2, j)}
            out.add((i, j))
    return out


@pytest.mark.parametrize("n, m", [(30, 12), (12, 30)])
def test_no_step_of_matching_broadcasts(spark, no_broadcast, n, m):
    points = [[("P", i, float(i % 7 * s), float(i % 3)) for i in range(k)] for k, s in ((n, 2), (m, 3))]  # copies and ties
    a, b = (spark.createDataFrame(p, "plate string, id long, x double, y double") for p in points)
    matched, lost = joins.match_one_to_one(a, b, 4.0, ("plate",))
    want = greedy(*points, 4.0)
    assert {(r["id1"], r["id2"]) for r in matched.collect()} == want
    assert {r["id"] for r in lost.collect()} == set(range(n)) - {i for i, _ in want}
    both = joins.merge_matched(a.select("id", "x"), b.select("id", "x"), matched)
    assert {(r["A_id"], r["B_id"]) for r in both.collect()} == want

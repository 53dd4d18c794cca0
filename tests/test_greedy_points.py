"""Matching by places and growing radii takes the pairs that taking them by (distance, id1, id2) takes."""

import random

import pytest

from wellspring.operators import joins


def taken(a, b, radius):
    edges = sorted((((x1 - x2) ** 2 + (y1 - y2) ** 2) ** 0.5, i, j, p) for p, i, x1, y1 in a for q, j, x2, y2 in b if p == q)
    out, used = set(), set()
    for d, i, j, p in edges:
        if d <= radius and not {(p, 1, i), (p, 2, j)} & used:
            used |= {(p, 1, i), (p, 2, j)}
            out.add((p, i, j, round(d, 9)))
    return out


@pytest.mark.parametrize("room", [None, 30])
def test_places_match_as_points_do(spark, monkeypatch, room):
    rng = random.Random(5)
    grid = lambda n, start: [(rng.choice("PQ"), start + 11 * i % n, float(rng.randrange(5)), float(rng.randrange(4))) for i in range(n)]  # noqa: E731  copies and ties
    loose = lambda n, start: [("R", 500 + start + i, rng.random() * 20, rng.random() * 20) for i in range(n)]
    a, b = grid(90, 0) + loose(60, 0), grid(70, 0) + loose(50, 0)
    if room:  # begins with a small radius
        monkeypatch.setattr(joins, "PAIRS", room)
        monkeypatch.setattr(joins, "PER_PLACE", 0)
        monkeypatch.setattr(joins, "range_pairs", (lambda whole: lambda *args, **kw: radii.append(args[2]) or whole(*args, **kw))(joins.range_pairs))
    radii = []
    table = lambda rows: spark.createDataFrame(rows, "plate string, id long, x double, y double")
    got = joins.greedy_points(table(a), table(b), 6.0, keys=("plate",))
    assert {(r["plate"], r["id1"], r["id2"], round(r["distance"], 9)) for r in got.collect()} == taken(a, b, 6.0)
    assert not room or (len(radii) > 1 and radii == sorted(radii) and radii[-1] <= 6.0)


def test_copies_of_a_place_are_matched_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, label: rounds.append(label) or keep(df, label))
    a = spark.createDataFrame([("P", i, float(i % 2) * 9) for i in range(80)], "plate string, id long, x double").selectExpr("*", "0D AS y")
    b = spark.createDataFrame([("P", i, float(i % 2) * 9 + 1) for i in range(60)], "plate string, id long, x double").selectExpr("*", "0D AS y")
    got = joins.greedy_points(a, b, 2.0, keys=("plate",)).collect()
    assert sorted((r["id1"], r["id2"], r["distance"]) for r in got) == [(i, i, 1.0) for i in range(60)]
    assert rounds.count("won") == 1


def test_an_id_of_several_points_is_taken_once(spark):
    table = lambda rows: spark.createDataFrame(rows, "plate string, id long, x double, y double")
    a, b = [("P", 1, 0.0, 0.0), ("P", 1, 5.0, 0.0), ("P", 2, 6.0, 0.0)], [("P", 8, 0.5, 0.0), ("P", 9, 5.25, 0.0)]
    got = joins.greedy_points(table(a), table(b), 9.0, keys=("plate",)).collect()
    assert {(r["id1"], r["id2"]) for r in got} == {(1, 9), (2, 8)}

"""Greedy matching ends when no edge is left, never before."""

import pytest

from wellspring.operators import joins


def test_a_bound_on_rounds_is_no_silent_cut(spark):
    # each edge is longer than the next, so a round takes one edge of the chain
    chain = [(i, i, 20.0 - 2 * i) for i in range(4)] + [(i + 1, i, 19.0 - 2 * i) for i in range(3)]
    pairs = spark.createDataFrame(chain, "id1 long, id2 long, distance double")
    with pytest.raises(RuntimeError):
        joins.greedy_match(pairs, max_rounds=2)
    assert joins.greedy_match(pairs).count() == 4
    assert joins.greedy_match(pairs, max_rounds=4).count() == 4

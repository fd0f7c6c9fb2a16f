"""Components that have not settled are an error, not a result."""

import pytest

from shelfwise.operators import graph

CHAIN = [(i, i + 1) for i in range(40)]


def test_rounds(spark):
    edges = spark.createDataFrame(CHAIN, "a long, b long")
    with pytest.raises(RuntimeError):
        graph.connected_components(edges, most=1).collect()
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(i, 0) for i in range(41)}

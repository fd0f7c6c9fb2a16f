"""Components that have not settled are an error, not a result."""

import pytest

from shelfwise.llm import components

CHAIN = [(i, i + 1) for i in range(40)]


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    edges = spark.createDataFrame(CHAIN, "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(edges, most=1).collect()
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)}

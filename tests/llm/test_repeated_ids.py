"""Rows that repeat an id are queries and candidates each; only the query's own row is left out."""

import math
import random

from shelfwise.llm import knn


def whole(rows, k=10, every=100):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = []
    for at, (q, a) in enumerate(ints):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(ints) if n != at)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_repeated_ids(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(1, 100)] + [(100, [1.0, 2.0, 3.0, 4.0])] * 3 + [(200, [r.gauss(0, 1) for _ in range(4)]) for _ in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df, pivots=8).collect())) == whole(rows)

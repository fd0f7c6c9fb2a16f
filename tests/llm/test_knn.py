import math
import random

from tests.oracle import compare

from shelfwise.llm import knn


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_edges(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(1, 250)] + [(i, [0.5] * 8) for i in range(250, 330)]
    rows += [(0, [0.1] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1100, [1e9] * 8), (1200, [0.0] * 8), (1300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS cell", "3 AS v")
    assert sorted(map(tuple, knn.top_k(df, pivots=8).collect())) == brute(rows)


def test_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(one).collect()] == [(100, 1, 7, 1024 * 1024)]


def test_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(knn, "PIECE", 16)
    monkeypatch.setattr(knn, "QUERIES", 2)
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 3, 0.05), r.gauss(0, 0.05), 1.0]) for i in range(0, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df, pivots=4).collect())) == brute(rows)


def test_query(spark):
    assert compare(spark, knn.op10_topk, knn.OP10_SQL, "/root/testdata/sf0.01") == 50


def test_query_groups_get_what_they_need(spark, monkeypatch):
    """Clustered vectors and many query groups: exact results, and fewer copies than every group times every vector."""
    monkeypatch.setattr(knn, "PIECE", 64)
    monkeypatch.setattr(knn, "QUERIES", 4)
    monkeypatch.setattr(knn, "GROUPS", 11)
    r = random.Random(9)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(1200)] + [(1300, [1e200] * 6), (1301, [-1e200] * 6), (1400, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [x for x in rows if x[0] < 1300]
    small = spark.createDataFrame(fine, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(small, every=10).collect())) == brute(fine, every=10)
    found = knn.routed(small, every=10, pivots=12)
    groups = sum(len(g.bound) for g in found.groups)
    assert groups >= 120 / 4 and len(found.groups) == -(-groups // 11)
    copies = found.data.count()
    assert copies < 0.5 * groups * len(fine)
    assert copies <= sum(int(g.need_cells(found.cells).sum(axis=0) @ found.cells.size) for g in found.groups)
    cut = {(q, n): max(-(2**63), min(2**63 - 1, s)) for q, n, _, s in brute(rows)}
    assert {(q, n): s for q, n, _, s in map(tuple, knn.top_k(df).collect())} == cut

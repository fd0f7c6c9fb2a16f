"""Places without one task, and digests without one row."""

import hashlib

from pyspark.sql import functions as F

from shelfwise.operators import digests, ranks
from shelfwise.sources import sinks


def test_places(spark):
    rows = [(g, i) for g, n in (("a", 900), ("b", 3), (None, 50), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(7).sortWithinPartitions(F.desc("i"))
    whole = {(r.g, r.i): r.place for r in ranks.numbered(df, [F.desc("i"), F.asc_nulls_last("g")]).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or ""))
    assert whole == {r: k for k, r in enumerate(order, 1)}
    within = {(r.g, r.i): r.place for r in ranks.numbered(df, ["i"], ["g"]).collect()}
    assert within == {(g, i): i + 1 for g, i in rows}
    chunked = sinks.chunked(df.filter("g = 'a'"), "g", ["i"], 50).collect()
    assert {(r.i // 50, r.i % 50 + 1) for r in chunked} == {(r.chunk, r.local_id) for r in chunked} and all(r.i == 50 * r.chunk + r.local_id - 1 for r in chunked)
    assert ranks.numbered(df.limit(0), ["i"], ["g"]).collect() == []


def test_digests(spark, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 100)
    rows = [(g, i, None if i == 3 else f"é{i}") for g, n in ((1, 700), (2, 1), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, t string").repartition(6)
    got = {r.g: (r.n, r.digest) for r in digests.ordered_digest(df, ["g"], ["i"], F.col("t")).collect()}
    want = {}
    for g in (1, 2, None):
        own = [t or "" for k, _, t in rows if k == g]
        want[g] = (len(own), hashlib.sha256(("[" + ", ".join(own) + "]").encode()).hexdigest())
    assert got == want
    assert digests.ordered_digest(df.limit(0), ["g"], ["i"], F.col("t")).collect() == []

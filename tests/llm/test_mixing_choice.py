"""Which documents the mix takes: the copies of each length go evenly, those left over in the order of the seeded hash."""

from collections import defaultdict

from pyspark.sql import functions as F

from shelfwise.llm import mixing

from .test_mixing import brute_targets


def test_choice(spark):
    rows = [(i, "w " * (3 + i % 4), "abc"[i % 3]) for i in range(400)] + [(7, "w " * 5, "a"), (7, "w " * 5, "a"), (None, "w " * 5, "b"), (1000, "w " * 700, "c"), (1001, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).distinct().collect()}
    size = lambda t: len((t or "").split())
    totals, groups = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for i, t, s in rows:
        totals[s] += size(t)
        if size(t):
            groups[s][size(t)].append(i)
    targets, want = brute_targets(dict(totals), [5, 2, 1], 3.0), defaultdict(list)
    for k, s in enumerate(sorted(totals), 1):
        lengths = sorted(groups[s])
        copies = mixing.fit_budget(lengths, [len(groups[s][n]) for n in lengths], int(targets[s]), 17 + k, 3)
        for n, c in zip(lengths, copies.tolist(), strict=True):
            order = sorted(groups[s][n], key=lambda i: (hashes[i], i is not None, i or 0))
            for place, i in enumerate(order):
                want[i, s, n].append(c // len(order) + (place < c % len(order)))
    got = defaultdict(list)
    for r in mixing.mix(df).collect():
        if r["size"]:
            got[r.doc_id, r.source, r["size"]].append(r.copies)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}

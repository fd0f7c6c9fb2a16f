import hashlib
import re

import pytest
from tests.oracle import compare

from shelfwise.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - width + 1)):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"w{i}" for i in range(20))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_edges(spark, block_bytes):
    items = [(1, PASSAGE), (2, "Tiny item"), (3, ""), (4, None), (None, "w1 w2"), (10, "É É é"), (2, "tiny item"), (11, " ".join(["aa"] * 13)), (12, PASSAGE)]
    docs = [(1, "x " + PASSAGE.upper() + " y"), (2, None), (3, ""), (4, "tiny, ITEM! " + "z " * 100), (5, "é É é É É é"), (6, "aa " * 40), (6, "aa " * 12), (None, "tiny\x00item"), (8, "tiny itemx"), (9, "q " * 50000 + PASSAGE), (10, " ".join(PASSAGE.split()[4:18]))]
    docs.append((12, "tiny"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_words", "8 AS code", "9 AS items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.scan(frame, bench, block_bytes=block_bytes).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.scan(none, bench).collect() == []
    assert [tuple(r)[:4] for r in d.scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).collect()] == [(1, 2, 0, 0)]


def test_query(spark):
    assert compare(spark, d.op6_decontamination, d.OP6_SQL, "/root/testdata/sf0.01") == 1000


def test_large_benchmark_is_joined(spark):
    """Items of fifty times what is broadcast; one passage stands in a third of the documents, copies of one text in another third."""
    import random

    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 12, 13, 14, 40])))) for i in range(300)]
    items += [(1000 + i, items[7][1]) for i in range(20)] + [(2000, PASSAGE), (None, "v1 v2 v3 v4 v5 v6")]
    docs = [(i, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randrange(60))), rng.choice(items)[1], "end"])) for i in range(100)]
    docs += [(200 + i, f"n{i} {PASSAGE} m{i}") for i in range(80)] + [(400 + i, f"{items[3][1]} {PASSAGE}") for i in range(80)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    assert sorted(map(tuple, d.scan(frame, bench, block_bytes=size // 50).collect()), key=repr) == brute(docs, items)
    assert d.scan(frame.limit(0), bench, block_bytes=10).collect() == []


def test_both_ways_agree(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, d.scan(docs, bench, block_bytes=100).collect())) == sorted(map(tuple, d.scan(docs, bench).collect()))

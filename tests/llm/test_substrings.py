import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import substrings as s

SF = "/root/testdata/sf0.001"


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdeé ") for _ in range(k))
    pool = [word(r.choice([90, 150, 198, 199, 200, 201, 202, 260, 400, 900])) for _ in range(12)]
    docs = []
    for i in range(n):
        t = "".join(r.choice([word(r.randint(0, 150)), r.choice(pool), r.choice(pool)[r.randint(0, 60) :]]) for _ in range(r.randint(0, 6)))
        docs.append((i, t))
    docs += [(n, "x" * 1000), (n + 1, "ab" * 300), (n + 2, "y" * 200), (n + 3, "z" * 199), (n + 4, "z" * 201), (n + 5, docs[3][1]), (n + 6, None), (n + 7, "")]
    return docs


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS key", "2 AS n", "'x' AS ranges")
    return sorted(map(tuple, s.remove_repeated(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_made(spark, seed):
    rows = made(seed)
    assert result(spark, rows) == brute(rows)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(s, "GROUP", 2)
    rows = made(5, 40)
    assert result(spark, rows) == brute(rows)


def test_equal_hashes_of_unlike_windows(spark, monkeypatch):
    """Hashes of three bits: nearly every hash is that of several strings, and their bytes decide."""
    monkeypatch.setattr(s, "GROUP", 2)
    monkeypatch.setattr(s, "HASH_BITS", 3)
    rows = made(6, 40)
    assert result(spark, rows) == brute(rows)


def test_repeated_ids(spark):
    rows = made(4, 20)
    rows += [(3, rows[5][1]), (None, rows[6][1]), (None, "q" * 250), (7, rows[7][1])]
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        s.remove_repeated(spark.createDataFrame([], "doc_id long, text string"), length=20)


def test_long_text(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh \n") for _ in range(300000))
    rows = [(1, text), (2, text[1000:1400]), (3, "k" + text[200:399] + "k")]
    assert result(spark, rows) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, s.op7_substring_dedup(spark, SF).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 1000

import random
import re

import numpy as np
import pytest

from shelfwise.llm import components as steps
from shelfwise.llm import neardup as d
from shelfwise.llm.components import components
from tests.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cid", "'x' AS sid")
    return sorted(map(tuple, d.near_duplicates(df).collect()), key=repr)


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [[r.choice(words) for _ in range(r.choice([3, 6, 8, 12, 40, 200]))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.4:
                w += [r.choice(words) for _ in range(r.randint(1, 2))]
            rows.append(" ".join(w))
    rows += [None, "", " \t\n", "One two", "one TWO", "one two three", "a b c d e", "a b c d e f", "É b c d e", "é b c d e"]
    chain = [f"c{i}" for i in range(100)]
    rows += [" ".join(chain[k : k + 50]) for k in range(0, 50, 4)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_made(spark, seed):
    rows = made(seed)
    assert result(spark, rows) == brute(rows)


def test_last_comparison(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 3)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    rows = made(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, d.near_duplicates(df).collect()), key=repr) == brute(rows)


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (None, "lone words of some kind here"), (7, text + " x"), (8, "y " * 30000), (9, "y " * 30001), (None, None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_estimate():
    r = np.random.default_rng(0)
    for n, j in ((400, 0.75), (4000, 0.5), (30, 0.8)):
        got = []
        for _ in range(40):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            shared = round(2 * n * j / (1 + j))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[:shared]], r.integers(0, 2**64, n - shared, dtype=np.uint64)]))
            ra, rb = (d.registers_of(x, np.zeros(len(x), np.int64), 1) for x in (a, b))
            got.append(d.estimate(ra, rb, np.array([n]), np.array([n]))[0])
        assert abs(np.mean(got) - j) < 0.04


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(steps, "ONE_TASK", one_task)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)] + [(300, 300)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != 300 and any(k in e and e[0] != e[1] for e in edges)}


def test_query(spark):
    assert compare(spark, d.op2_near_duplicates, d.OP2_SQL, "/root/testdata/sf0.01") == 1000

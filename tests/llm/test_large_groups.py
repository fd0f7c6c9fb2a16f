"""Groups of near copies above a bucket's block: every link of the brute force, without all pairs of a group."""

import random

import pytest

from shelfwise.llm import neardup as d
from tests.llm.test_neardup import brute


def cloud(r, words, n=70, most=14, base_words=90):
    base = [r.choice(words) for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(w)
    return out


def families(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    rows = cloud(r, words)
    base = [r.choice(words) for _ in range(100)]
    for _ in range(40):  # parts of one text: pairs that have lost the same
        k, lo = r.randint(45, 100), r.randint(0, 30)
        rows.append(base[lo : lo + k] + [r.choice(words) for _ in range(r.choice([0, 0, 2]))])
    passage = [r.choice(words) for _ in range(40)]
    for _ in range(50):  # one passage in unlike texts, some of which are near copies of each other
        own = [r.choice(words) for _ in range(r.choice([10, 40, 60]))]
        for _ in range(r.choice([1, 1, 1, 3])):
            tail = [r.choice(words) for _ in range(r.randint(0, 4))]
            rows.append(passage + own + tail)
    second = cloud(r, words, 30, 6)
    rows += second + [w + passage[:12] for w in second[:10]]
    r.shuffle(rows)
    return list(enumerate(" ".join(w) for w in rows))


@pytest.mark.parametrize("seed, block", [(1, 6), (2, 20), (3, 1)])
def test_families(spark, monkeypatch, seed, block):
    monkeypatch.setattr(d, "BLOCK", block)
    rows = families(seed)
    got = d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_repeated_ids_meet_their_own_class(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(w) for w in cloud(r, words, 12, 3, 60)] + [" ".join(r.choice(words) for _ in range(50)) for _ in range(12)]
    rows = [(None if i % 3 == 0 else 7, t) for i, t in enumerate(texts)] + [(8, texts[0]), (7, None)]
    got = d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)

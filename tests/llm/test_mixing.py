import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import mixing

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        rest = total - sum(held.values())
        out = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return held | out
        held |= {s: cap * sizes[s] for s in over}


@given(st.lists(st.sampled_from(["", "a b", " x\ty\x0b", "é\xa0é z", "\x0c", "word\r\nword"]), max_size=20))
def test_word_counts(texts):
    assert mixing.word_counts(pa.array(texts, pa.string())).tolist() == [len(regex.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 1500), st.sampled_from([1, 3]))
@settings(deadline=None, max_examples=150)
def test_budget_is_never_passed_and_nearly_met(counts, budget, cap):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    taken = mixing.fit_budget(lengths, n, budget, 1, cap)
    words = (taken * lengths).sum()
    assert ((taken >= 0) & (taken <= n * cap)).all() and words <= budget
    if budget:
        base = n * cap if budget >= cap * (n * lengths).sum() else np.array([c * budget // int((n * lengths).sum()) for c in n.tolist()])
        sums = {int((base * lengths).sum())}
        for size, m in zip(lengths.tolist(), (n * cap - base).tolist(), strict=True):
            sums = {s + size * j for s in sums for j in range(m + 1) if s + size * j <= budget} or sums
        assert words >= max(s for s in sums if s <= budget)  # no choice that adds to the proportional part is nearer


def checked(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    want = brute_targets(sizes, [5, 2, 1], 3.0)
    for s, x in by.items():
        for r in x:
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            assert r.taken in {r["size"] * k for k in range(4)}
        assert want[s] - sum(r.taken for r in x) < max(2, 0.2 * want[s] if len(x) < 20 else 2), s


def test_edges(spark):
    rows = [(1, "a " * 50, "b"), (2, None, None), (3, "", "x"), (4, "a b c", None), (4, "a b c", None), (5, "q", ""), (6, "w " * 7, "a"), (None, "w " * 5, "a")]
    rows += [(i, "w " * (i % 5), "hot") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS k", "3 AS h")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    checked(got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()] == [0]


def test_query(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == 1000
    checked(got)
    for s in {r.source for r in got}:
        x = [r for r in got if r.source == s]
        assert abs(x[0].target - sum(r.taken for r in x)) < 2  # the whole part of the budget, less a word that no choice of documents meets

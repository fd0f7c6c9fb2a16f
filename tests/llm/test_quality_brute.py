"""Every statistic, and the choice of every split, against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import quality

MARK = r"[!-/:-@\[-`{-~]"
WORD_FLAGS = {
    "words_without_letters": lambda w: not re.search(r"[A-Za-z]|[^\x00-\x7F]", w),
    "words_in_capitals": lambda w: bool(re.search(r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$", w)),
    "words_capitalised": lambda w: bool(re.search(r"^[A-Z][^A-Z]*$", w)),
    "words_ending_in_marks": lambda w: bool(re.search(MARK + "$", w)),
    "words_ending_in_two_marks": lambda w: bool(re.search(MARK + "{2}$", w)),
    "marks_inside": lambda w: bool(re.search(rf"[A-Za-z]{MARK}+[A-Za-z]", w)),
}
SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    if not text:
        return dict.fromkeys(quality.FEATURES, 0.0)
    words, lines, n = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n"), len(text)
    many = max(len(words), 1)
    share = lambda test: sum(map(test, text)) / n
    upper, digit, space, beyond = share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in SPACE), share(lambda c: c > "\x7f")
    lower = share(lambda c: "a" <= c <= "z")
    mean = sum(map(len, words)) / many
    out = {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(words)), "chars_per_word": n / many, "distinct_share": len(set(words)) / many, "top_share": max(Counter(words).values(), default=0) / many,
        "upper": upper, "digit": digit, "punctuation": 1 - upper - digit - space - beyond - lower, "space": space, "beyond_ascii": beyond, "log_lines": math.log1p(len(lines)), "log_line_chars": math.log1p(n / len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "short_lines": sum(len(x) < 20 for x in lines) / len(lines),
        "spread_of_word_length": math.sqrt(max(sum(len(w) ** 2 for w in words) / many - mean**2, 0)), "log_longest_word": math.log1p(max(map(len, words), default=0)),
    }
    return out | {k: sum(map(f, words)) / many for k, f in WORD_FLAGS.items()}


@given(st.lists(st.text(alphabet="aZ9 é\n.!-\tB世", max_size=60), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_every_statistic(texts):
    got = quality.features_of(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        want = plain(text)
        assert set(want) == set(quality.FEATURES)
        for name, x in zip(quality.FEATURES, row.tolist(), strict=True):
            assert math.isclose(x, want[name], rel_tol=1e-9, abs_tol=1e-7), (name, text)


def brute_tree(x, y, raw, depth, bins, rate, l2, least):
    """One tree by looking at every edge of every feature for every node."""
    n, d = x.shape
    p = 1 / (1 + np.exp(-raw))
    g, h = p - y, p * (1 - p)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower").tolist())) for j in range(d)]
    inner = 2**depth - 1
    feature, threshold = [0] * inner, [math.inf] * inner
    nodes = {0: list(range(n))}
    for node in range(inner):
        rows = nodes.get(node, [])
        tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-9, 0, math.inf)
        for j in range(d):
            for e in edges[j]:
                a = [i for i in rows if x[i, j] <= e]
                lg, lh = sum(g[i] for i in a), sum(h[i] for i in a)
                if lh >= least and th - lh >= least:
                    gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, e)
        feature[node], threshold[node] = best[1:]
        nodes[2 * node + 1] = [i for i in rows if x[i, best[1]] <= best[2]]
        nodes[2 * node + 2] = [i for i in rows if x[i, best[1]] > best[2]]
    leaves = [nodes.get(inner + k, []) for k in range(inner + 1)]
    return feature, threshold, [-rate * sum(g[i] for i in r) / (sum(h[i] for i in r) + l2) for r in leaves]


def test_every_split():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(160, 4)), 2)
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > -0.5) ^ (r.random(160) < 0.1)).astype(float)
    model = quality.train(x, y, trees=3, depth=3, bins=8)
    raw = np.full(160, model.start)
    share = (y.sum() + 1) / 162
    assert math.isclose(model.start, math.log(share / (1 - share)))
    for t in range(3):
        feature, threshold, leaf = brute_tree(x, y, raw, 3, 8, 0.1, 1.0, 1.0)
        assert model.threshold[t].tolist() == threshold and np.allclose(model.leaf[t], leaf)
        assert [f for f, e in zip(model.feature[t].tolist(), threshold, strict=True) if e < math.inf] == [f for f, e in zip(feature, threshold, strict=True) if e < math.inf]
        for i in range(160):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(x[i, feature[node]] > threshold[node])
            raw[i] += leaf[node - 7]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-raw)))

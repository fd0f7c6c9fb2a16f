import random
import re

import pytest

from shelfwise.llm import licenses as d
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, templates, percent=75):
    out = []
    for doc_id, text in docs:
        w = words(text)
        for i, (name, t) in enumerate(templates):
            tw = words(t)
            k = min(5, len(tw))
            if not k or len(w) < k:
                continue
            own = {tuple(tw[j : j + k]) for j in range(len(tw) - k + 1)}
            s = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            width = min(len(tw) - k + 1, len(s))
            counts = [len(own & set(s[p : p + width])) for p in range(len(s) - width + 1)]
            good = [100 * c >= percent * len(own) for c in counts]
            if any(good):
                out.append((doc_id, name, i, len(own), max(counts), counts.index(max(counts)), sum(a and not b for a, b in zip(good, [False, *good]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 10])
def test_made(spark, block_words):
    r = random.Random(7)
    pool = [f"w{i}" for i in range(30)]
    templates = [*d.TEMPLATES, ("long", " ".join(r.choice(pool) for _ in range(150))), ("none", ""), ("null", None), ("é", "É b é"), ("rep", "a b c d e " * 6)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(0, 5)):
            t = words(r.choice(templates)[1])
            for _ in range(r.randint(0, max(1, len(t) // 15))):
                if t:
                    t[r.randrange(len(t))] = r.choice(pool)
            parts += t[: len(t) - r.choice([0, 0, 0, len(t) // 5])] + [r.choice(pool) for _ in range(r.randint(0, 30))]
        docs.append((i, " ".join(parts)))
    docs += [(50, None), (51, ""), (52, "all rights"), (53, "ALL RIGHTS RESERVED"), (None, "All rights reserved. " * 20000), (53, "ALL RIGHTS RESERVED"), (54, "a b c d e a b c d e a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS template", "2 AS runs")
    assert sorted(map(tuple, d.scan(df, templates, block_words=block_words).collect()), key=repr) == brute(docs, templates)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert d.scan(none).collect() == [] and d.scan(none, [("x", None)]).collect() == []


def test_query(spark):
    assert compare(spark, d.op5_license_scan, d.OP5_SQL, "/root/testdata/sf0.01") > 5


def test_whole_texts(spark):
    """Whole license texts between other words, in other case and lines, with some words changed."""
    import re

    wanted, rows = {}, []
    for i, (_, text) in enumerate(d.TEMPLATES):
        words = text.split()
        if len(words) >= 60:
            for k in range(0, len(words), 40):
                words[k] = "changed"
            rows.append((i, "some file header\n" + "\n ".join(w.upper() for w in words) + "\nand code after it " * 3))
            wanted[i] = i
    got = {(r.doc_id, r.template) for r in d.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) == 5 and all((i, i) in got for i in wanted)
    exact = [(i, re.sub(r"\s+", " ", t)) for i, (_, t) in enumerate(d.TEMPLATES)]
    assert {(i, i) for i, _ in exact} <= {(r.doc_id, r.template) for r in d.scan(spark.createDataFrame(exact, "doc_id long, text string")).collect()}

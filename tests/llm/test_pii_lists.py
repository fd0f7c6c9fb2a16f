"""Documents of thousands of entities and terms, and copies of them."""

import random

from shelfwise.llm import pii

from .test_pii_documents import whole_terms


def test_long_lists(spark):
    rng = random.Random(4)
    people = [(f"user{i}@mail{i % 7}.example.org", f"nick{i}x") for i in range(1500)]
    page = "\n".join(f"{nick} {mail}" for mail, nick in people)
    rows = [(1, page), (2, page), (3, page + "\nand one more line of words")]
    rows += [(100 + i, f"write to {mail} or ask {nick} {rng.choice(['today', 'tomorrow'])}") for i, (mail, nick) in enumerate(people) if i % 10 == 0]
    rows += [(5000 + i, f"plain words {i} nick{i}x") for i in range(0, 300, 7)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS e", "3 AS t", "4 AS terms", "5 AS base")
    want = {r[0]: x for r, x in zip(rows, whole_terms(rows), strict=True)}
    assert {r.doc_id: [(t.s, t.f) for t in r.terms] for r in pii.find(df).collect()} == want
    assert sum(map(len, want.values())) > 4500


def test_support(spark):
    rows = [(i, f"a@b.cd word{i % 2} once{i}") for i in range(5)] + [(9, "x@y.zz alone")] + [(20 + i, "none here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for support in (2, 3, 4):
        got = {r.doc_id: [(t.s, t.f) for t in r.terms] for r in pii.find(df, support=support).collect()}
        assert got == {r[0]: x for r, x in zip(rows, whole_terms(rows, support=support), strict=True)}

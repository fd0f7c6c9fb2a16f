"""Token votes: words are not shuffled by document, and a vocabulary above the broadcast gives the same scores."""

import math
from collections import Counter

from shelfwise.operators import models
from shelfwise.plans import labelling

SMALL = "/root/testdata/sf0.001"
TRAIN = [(1, "x", "a a b"), (2, "y", "b c"), (3, "x", "d"), (4, "y", "a e e e")]
ASKED = [(10, "a b zz zz"), (11, ""), (12, "e e c d"), (13, "b")]


def brute(labels):
    docs, words = Counter(y for _, y, _ in TRAIN), {y: Counter() for _, y, _ in TRAIN}
    for _, y, t in TRAIN:
        words[y].update(t.split(" "))
    vocabulary = len(set().union(*words.values()))
    log = lambda y, w: math.log((words.get(y, {}).get(w, 0) + 1) / (sum(words.get(y, {}).values()) + vocabulary))
    return {(i, y): round(sum(log(y, w) for w in t.split(" ")) + math.log(docs.get(y, 1) / len(TRAIN)), 9) for i, t in ASKED for y in labels}


def test_both_ways(spark, monkeypatch):
    train = spark.createDataFrame([(i, t.split(" ")) for i, _, t in TRAIN], "id long, words array<string>")
    labels = spark.createDataFrame([(i, y) for i, y, _ in TRAIN] + [(99, "x")], "id long, y string")
    rows = spark.createDataFrame([(i, w) for i, t in ASKED for w in t.split(" ")], "id long, token string")
    counted = rows.groupBy("id", "token").count().withColumnRenamed("count", "times")
    for numbers, most in ((4_000_000, 2_000_000), (18, 1)):  # two words broadcast, labels joined
        monkeypatch.setattr(models, "MOST_NUMBERS", numbers)
        monkeypatch.setattr(models, "MOST_ROWS", most)
        for asked in (rows, counted):
            votes = models.token_votes(models.labelled_words(train, labels, "id", "y"), "y", "id")
            got = {(r.id, r.y): round(r.score, 9) for r in models.predict_votes(asked, "id", votes, "y", ["x", "y", "z"]).collect()}
            assert got == brute(["x", "y", "z"])


def test_words_are_no_keys_of_documents(spark):
    """Nothing is dealt out by document and word, or by word, before scores are summed."""
    df = labelling.naive_bayes(spark, SMALL)
    exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("token" in x for x in exchanges)

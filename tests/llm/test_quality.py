import zlib

import numpy as np
import pyarrow as pa

from shelfwise.llm import quality

SF = "/root/testdata/sf0.1"


def test_features():
    texts = ["", "Ab AB, 12 é\nAb", "x" * 100000, " \n\n", "!! ??"]
    x = dict(zip(quality.FEATURES, quality.features_of(pa.array(texts)).T, strict=True))
    assert not quality.features_of(pa.array([""])).any()
    assert np.isclose(x["log_words"][1], np.log1p(5)) and np.isclose(x["distinct_share"][1], 4 / 5) and np.isclose(x["top_share"][1], 2 / 5)
    assert np.isclose(x["upper"][1], 4 / 14) and np.isclose(x["log_chars"][1], np.log1p(14)) and np.isclose(x["log_longest_word"][2], np.log1p(100000))
    assert x["words_without_letters"].tolist() == [0, 1 / 5, 0, 0, 1] and np.isclose(x["repeated_lines"][3], 1 / 3)


def test_trees_walk_as_they_split():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train(x, y, trees=40, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    one = model.score(x[:1])
    assert np.isclose(one, model.score(x)[:1])
    assert quality.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.train(np.zeros((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.5


def test_edges(spark):
    rows = [(i, "good prose of a kind here. " * 5 if i % 2 else "A!! B!! C!!" * 9) for i in range(200)] + [(None, "x"), (900, None), (901, ""), (901, "word " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS quality")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int").selectExpr("*", "'t' AS text")
    model = quality.fit(docs, labels)
    got = [tuple(r) for r in quality.scored(docs, model, ["doc_id", "score"]).collect()]
    assert len(got) == len(rows)
    assert all(0 <= s <= 1 for _, _, s in got) and all((s > 0.5) == (i % 2 == 1) for i, _, s in got if i is not None and i < 200)
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    test = [(got[r.doc_id].predicted, r.quality, got[r.doc_id].score) for r in labels if got[r.doc_id].held_out]
    right = sum(p == q for p, q, _ in test) / len(test)
    low = [p for p, q, _ in test if q == 0]
    print(len(test), right, 1 - sum(low) / len(low))
    assert right > 0.97 and 1 - sum(low) / len(low) > 0.9

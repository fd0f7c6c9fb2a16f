import math
from collections import Counter

import pyarrow as pa

import corpus_pipeline as p
from shelfwise.llm import mixing, quality
from tests.llm import test_decontaminate, test_mixing, test_neardup, test_tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", p.F.lit("kept")).withColumn("size", p.F.lit(1))
    columns, before = docs.columns, rows(docs)
    tables = []
    for i, (_, stage) in enumerate(p.STAGES):
        df = stage(spark, docs, SF)
        if i < 4:
            assert df.columns == columns
            df.write.parquet(path := p.new_path(spark, "test"))
            docs = spark.read.parquet(path)
            tables.append(rows(docs))
        else:
            last = rows(df)
    one, two, three, four = tables
    # quality: the trees of the same labelled documents, walked one by one
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        x = quality.features_of(pa.array([text or ""]))[0]
        total = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert sorted(one) == sorted(r for r in before if score(r[1]) >= 0.3) and 0 < len(one) < len(before)
    kept = {r[0] for r in test_neardup.brute([r[:2] for r in one]) if r[3]}
    assert sorted(two) == sorted(r for r in one if r[0] in kept) and len(two) < len(one)
    bench = rows(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    clean = {r[0] for r in test_decontaminate.brute([r[:2] for r in two], bench) if not r[5]}
    assert sorted(three) == sorted(r for r in two if r[0] in clean) and len(three) < len(two)
    copies = Counter(four)
    assert set(copies) <= set(three) and max(copies.values()) <= 3
    size = {r[0]: int(mixing.word_counts(pa.array([r[1] or ""]))[0]) for r in three}
    totals = {s: sum(size[r[0]] for r in three if r[3] == s) for s in {r[3] for r in three}}
    for s, target in test_mixing.brute_targets(totals, [5, 2, 1], 3.0).items():
        assert abs(target - sum(size[r[0]] * n for r, n in copies.items() if r[3] == s)) < 60
    assert sorted(last, key=lambda r: r[1]) == test_tokens.expected([r[:2] for r in four])


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(80))
    data = [(1, good), (1, good), (None, good + " more"), (2, None), (3, ""), (4, "tiny")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "a", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    left = p.one_of_near_duplicates(spark, docs, SF)
    assert len(rows(left)) == 4 and left.columns == docs.columns
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        stage(spark, docs, SF).collect()
    assert len(rows(p.mixed_sources(spark, docs, SF))) >= 1


def test_run(spark):
    got = rows(p.run(spark, SF))
    assert len(got) > 10 and min(r[1] for r in got) == 0

"""Stages return the caller's columns, whatever they are called; ids that repeat or are missing; long texts; empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from shelfwise.llm import mixing

SF = "/root/testdata/sf0.001"
NAMES = (
    "own score score_ text_ runs_ items_ runs items n_words n_hit n_items items_sha256 contaminated size size_ id_ from_ words_ copies copies_ copy_ from words whole h id at row row_ "
    "n sid regs cid rep kept component_id key place label hub band k slice source_size target read a`b c.d"
).split()


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    named = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES if n != "a`b" and n != "c.d"})
    return named.withColumn("a`b", F.struct(F.lit(1).alias("x y"), F.array(F.lit("z")).alias("q`r"))).withColumn("c.d", F.lit(None).cast("map<string,int>"))


def seen(df):
    return Counter(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("stage", [s for _, s in p.STAGES[:-1]])
def test_columns(spark, stage):
    words = " ".join(f"word{i}" for i in range(90))
    rows = [(1, words, "a"), (1, words, "a"), (2, words + " more", "b"), (None, None, None), (3, "", "a"), (None, "plain words of a short text here", None), (4, "long " * 400_000, "b")]
    docs = documents(spark, rows)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert set(seen(got)) <= set(seen(docs)) and seen(got)
    assert stage(spark, docs.limit(0), SF).collect() == []
    for again in (docs, docs.repartition(5)):
        assert seen(stage(spark, again, SF)) == seen(got)


def test_mix_of_repeated_rows(spark):
    """Ten equal rows of 10 words and one of 4: the stage takes the words that the plan takes."""
    rows = [(1, "w " * 10, "a")] * 10 + [(2, "w " * 4, "b")] + [(3, "w " * 30, "c")]
    docs = documents(spark, rows)
    plan = {r.source: r.taken for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = Counter()
    for r in p.mixed_sources(spark, docs, SF).select("source", "text").collect():
        got[r.source] += len(r.text.split())
    assert {s: got[s] for s in plan} == plan


def test_results_outlive_stages(spark):
    from shelfwise.llm import neardup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = neardup.near_duplicates(docs)
    p.by_quality(spark, docs, SF).count()
    assert held.count() == docs.count()


def test_budgets():
    import numpy as np

    for seed in range(3):
        assert (mixing.fit_budget(np.array([150_000, 200_000]), np.array([1, 1]), 340_000, seed) * [150_000, 200_000]).sum() == 200_000
    lengths = np.array([3, 40_000_001, 70_000_003])
    got = mixing.fit_budget(lengths, np.array([4, 2, 2]), 150_000_010, 1, 2)
    assert 150_000_010 - 3 < (got * lengths).sum() <= 150_000_010

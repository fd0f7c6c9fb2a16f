"""Counted words, pairs and runs of characters against Spark's own stages; texts are counted once for all fits."""

from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.sql import functions as F

from shelfwise.operators import grams, models


def staged(rows):
    runs = "transform(sequence(1, greatest(length(w) + 3 - n, 1)), i -> substr(concat(' ', w, ' '), i, n))"
    all_runs = f"flatten(transform(w1, w -> flatten(transform(sequence(3, 5), n -> {runs}))))"
    for stage in (NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement=f"SELECT *, concat(w1, w2, {all_runs}) AS w FROM __THIS__"), HashingTF(inputCol="w", outputCol="x", numFeatures=1 << 16)):
        rows = stage.transform(rows)
    return rows


def test_counts_of_the_stages(spark):
    texts = [(-1, ""), (-2, "a"), (-3, "a a b"), (-4, "Über Straße 12 x"), (-5, "ab abc abcd abcde abcdefghijklmnopq " * 3)]
    documents = spark.createDataFrame(texts, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    words = RegexTokenizer(inputCol="text", outputCol="w1", pattern="[^a-z0-9]+").transform(documents)
    want = {r.doc_id: r.x for r in staged(words).select("doc_id", "x").collect()}
    got = {r.doc_id: r.x for r in grams.WordGrams(inputCol="text", outputCol="x").transform(documents).select("doc_id", "x").collect()}
    assert got == want and len(got) > 200


def test_few_splits_are_dealt_out(spark):
    assert models.counted_texts(spark.range(4000).coalesce(1).selectExpr("id", "concat('word', id) AS text"), "text").select(F.spark_partition_id()).distinct().count() > 1


def test_texts_are_counted_once_for_the_fits(spark):
    """The fits read a written table: no run of characters is made in them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked_at(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(f"word{i % 7} other{i % 3}", float(i % 2)) for i in range(40)], "text string, y double").withColumn("text", looked_at("text"))
    assert models.tfidf_classifier(rows, "text", "y") is not None
    assert 0 < seen.value <= 80  # to deal rows out, and to count them; four times and more before

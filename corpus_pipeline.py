"""Documents to training files: quality, near duplicates, benchmark passages, source weights, token ids.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir), works on every row of ``docs``, and all but the
last return the columns of ``docs``, whatever they are called, unchanged and in their order. Nulls in any column, empty and
very long texts, repeated rows and ids, and empty tables are documents or tables like others; each stage says what it
makes of them. A stage's working tables stay where its result still reads them; ``run`` deletes them once it has written
the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, mixing, neardup, quality, tokens
from shelfwise.llm._store import broadcast_if, column, keep, new_path, text_batches, unpacked, working

#: Rows whose ids are broadcast to drop documents, at most; more are joined.
BROADCAST_ROWS = 1_000_000
THRESHOLD = 0.3


def _columns(docs: DataFrame) -> list:
    return [column(c) for c in docs.columns]


def _told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents and a column of whole numbers that tells their rows apart: ``doc_id``, or else one of a name that is free."""
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return docs, "doc_id"
    taken, name = {c.lower() for c in docs.columns}, "row"
    while name in taken:
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, does not reject.

    A null text is scored as an empty one. Rows that repeat an id are scored each. Without labelled documents every score
    is 0.5 and all stay.
    """
    text_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored_packed(docs, model, docs.columns).filter(F.col("score") >= THRESHOLD).select(*unpacked(docs.columns))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group; where ids do not tell rows apart, the first row of each group.

    Documents without words (null, empty and white texts) are no one's duplicates and stay.
    """
    text_batches(spark)
    columns = _columns(docs)
    docs, own = _told_apart(docs)
    found = neardup.near_duplicates(docs.select(column(own).alias("doc_id"), "text"))
    gone = broadcast_if(keep(found.filter(~F.col("kept")).select(F.col("doc_id").alias(own)), "pipeline-gone"), BROADCAST_ROWS)
    return docs.join(gone, own, "left_anti").select(*columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``. Those without words are not, whatever their ids."""
    text_batches(spark)
    found = decontaminate.scan_packed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    return found.filter(~F.col("contaminated")).select(*unpacked(docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times.

    Documents without words add none and are not taken; a null source is a source; rows that repeat an id are taken each
    by themselves, so the words taken of a source are those of ``mixing.mix``.
    """
    text_batches(spark)
    columns = docs.columns
    docs, own = _told_apart(docs)
    return mixing.repeat_documents(docs, None if own == "doc_id" else own).select(*(column(c) for c in columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files' own record of each document: ``doc_id, start, n_tokens, ids_crc32``.

    A document without a text has the end id alone. Documents without an id come first, copies of a document one after
    another. Without documents there are no rows.
    """
    text_batches(spark)
    path = new_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality classifier", by_quality),
    ("minhash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed_sources),
    ("token-id output", token_files),
]

#: Trees and tokenizers are not for SQL; tests hold every stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"pipeline-{i + 1}")
        with working(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Lookups: membership of ids, overrides by key and signature, probe differences, answers by place, fallbacks, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_any_id(rows: DataFrame, ids: str, wanted: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows of which any id in the array ``ids`` is among ``wanted`` (or none). Told apart by ``key``, so no row comes twice.

    Ids are exploded once and met by equality; what is joined back is keys alone.
    """
    hits = rows.select(key, F.explode(ids).alias("id_")).join(wanted.toDF("id_"), "id_", "left_semi").select(key).distinct()
    return rows.join(hits, key, "left_anti" if anti else "left_semi")


def point_lookup(rows: DataFrame, id_col: str, ids: str, wanted: str, order: str) -> DataFrame:
    """The first row whose id is ``wanted`` or whose ids hold it: a pushed-down filter and a top-1."""
    own = F.coalesce(F.col(id_col) == wanted, F.lit(False)) | F.coalesce(F.array_contains(ids, wanted), F.lit(False))
    return rows.filter(own).orderBy(order).limit(1)


def overridden(rows: DataFrame, key: str, signature: str, by_key: DataFrame, by_signature: DataFrame, value: str) -> DataFrame:
    """Rows with ``value`` as the override of their key gives it, else that of their signature, else their own.

    Override tables have the key (or signature) and ``override``, one row each; an empty override is none.
    """
    filled = lambda df, k, name: df.select(F.col(k).alias(f"{name}k_"), F.nullif(F.col("override"), F.lit("")).alias(name))
    out = rows.join(filled(by_key, key, "o1_"), F.col(key) == F.col("o1_k_"), "left").join(filled(by_signature, signature, "o2_"), F.col(signature) == F.col("o2_k_"), "left")
    return out.withColumn("overridden", F.coalesce("o1_", "o2_").isNotNull()).withColumn(value, F.coalesce("o1_", "o2_", F.col(value))).drop("o1_", "o1_k_", "o2_", "o2_k_")


def probe_difference(left: DataFrame, right: DataFrame, url: str, status: str) -> DataFrame:
    """``url, side, left_statuses, right_statuses`` where two probes differ: a link of one side only, or other statuses."""
    sets = lambda df, n: df.groupBy(url).agg(F.array_sort(F.collect_set(status)).alias(n))  # noqa: E731  statuses are few
    both = sets(left, "left_statuses").join(sets(right, "right_statuses"), url, "full")
    side = F.when(F.col("right_statuses").isNull(), "left").when(F.col("left_statuses").isNull(), "right").when(F.col("left_statuses") != F.col("right_statuses"), "both")
    return both.withColumn("side", side).filter("side IS NOT NULL").select(url, "side", "left_statuses", "right_statuses")


def answered(asked: DataFrame, answers: DataFrame, chunk: str, local_id: str) -> DataFrame:
    """Rows of a chunk with its answers, by place; a row without an answer keeps nulls."""
    return asked.join(answers, [chunk, local_id], "left")


def preferred_or_all(rows: DataFrame, group: str, wanted: Column) -> DataFrame:
    """The wanted rows of each group, or all of it where it has none. Counts are partial, no group is gathered."""
    marked = rows.withColumn("w_", F.coalesce(wanted, F.lit(False)))
    some = marked.filter("w_").select(group).distinct().withColumn("s_", F.lit(True))
    return marked.join(some, group, "left").filter(F.col("w_") | F.col("s_").isNull()).drop("w_", "s_")


def seeded_sample(rows: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """``size`` rows without replacement, the first by a seeded hash: a top-k, and the same at every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)


def labelled(rows: DataFrame, dimension: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with the label of their key in a dimension, or the key itself."""
    named = dimension.select(F.col(key).alias("k_"), F.nullif(F.col(label), F.lit("")).alias("l_"))
    return rows.join(named, F.col(key) == F.col("k_"), "left").withColumn(label, F.coalesce("l_", F.col(key).cast("string"))).drop("k_", "l_")


def counted(rows: DataFrame, value: str) -> DataFrame:
    """``value, n`` of values that are not empty, most first; of equal counts the smaller value."""
    return rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)


def ordered(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of an order with their ``place`` from 1: a top-k, numbered after it."""
    from pyspark.sql import Window

    first = rows.orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of ``most`` rows


def facet(rows: DataFrame, column: str, order: Sequence[str], head: str = "All") -> DataFrame:
    """``place, value``: ``head``, then the values of a fixed order that are there. Counts of distinct values come first, so rows are read once."""
    places = [(0, head), *((i, v) for i, v in enumerate(order, 1))]
    known = rows.sparkSession.createDataFrame(places, "place int, value string")
    there = rows.select(F.col(column).cast("string").alias("value")).distinct()
    return known.filter("place = 0").unionByName(known.filter("place > 0").join(there, "value", "left_semi").select("place", "value"))

"""Keyed merges of records in an explicit order. An empty value is null, '' or []; 0 is a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import text_key


def filled(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull() & (F.size(c) > 0) if kind.startswith("array") else c.isNotNull()


def first_non_empty(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], last: bool = False) -> DataFrame:
    """For each key and column the first (or last) value in ``order`` that is not empty. Partial aggregates: no row is gathered."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(*(pick(c, F.when(filled(df, c), F.col(order))).alias(c) for c in columns))


def entity_key(ids: Column, one: Column, name: Column) -> Column:
    """Several ids as their sorted list, one id, or the key of the name."""
    own = F.array_sort(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(own) > 1, F.concat(F.lit("asins:"), F.array_join(own, ","))).when(one.isNotNull() & (one != ""), F.concat(F.lit("asin:"), one)).when(F.size(own) == 1, F.concat(F.lit("asin:"), F.element_at(own, 1))).otherwise(F.concat(F.lit("name:"), text_key(name)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One whole row a key: the first in order, or the last."""
    by = [(F.desc(c) if last else F.asc(c)) if isinstance(c, str) else c for c in order]
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("rn_ = 1").drop("rn_")


def merge_offers(df: DataFrame, key: str, store: str, order: str, columns: Sequence[str], source: str) -> DataFrame:
    """Offers of a key and store: the last value of each column that is not empty, sources in order of their first use."""
    values = first_non_empty(df, [key, store], order, columns, last=True)
    uses = df.groupBy(key, store, source).agg(F.min(order).alias("o"))
    sources = uses.groupBy(key, store).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", source))), lambda x: x[source]).alias("sources"))
    return values.join(sources, [key, store])


def primary_offer(offers: DataFrame, key: str, store: str, order: str, default: Column, columns: Sequence[str]) -> DataFrame:
    """The offer of the default store, else the first one, of each key."""
    best = F.struct(F.when(default, 0).otherwise(1), F.col(order))
    return offers.groupBy(key).agg(F.min_by(store, best).alias(store), *(F.min_by(c, best).alias(c) for c in columns))


def upgraded_brand(rows: Column) -> Column:
    """Folds an ordered array of ``struct<brand, brand_source>``: a source brand beats a derived one, and a longer source
    brand that starts with the one held beats it."""
    start = F.struct(F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("brand_source"))

    def step(held: Column, new: Column) -> Column:
        empty = held["brand"].isNull()
        from_source = new["brand_source"].eqNullSafe(F.lit("source")) & new["brand"].isNotNull()
        has_source = held["brand_source"].eqNullSafe(F.lit("source"))
        longer = F.startswith(text_key(new["brand"]), F.concat(text_key(held["brand"]), F.lit(" ")))
        take = (empty & new["brand"].isNotNull()) | (from_source & (~has_source | longer))
        return F.when(take, F.struct(new["brand"].alias("brand"), new["brand_source"].alias("brand_source"))).otherwise(held)

    return F.aggregate(rows, start, step)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` in place of those of their keys; the last form of a key in ``new`` must be unique."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def in_order(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The distinct values of a key in the order in which they came first, as an array: few values a key, whatever its rows."""
    first = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o_"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_", value))), lambda x: x[value]).alias("v_"))

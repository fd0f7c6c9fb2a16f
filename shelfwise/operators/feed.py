"""The feed: conjunctive filters, sort modes, limits, shelves and personalised scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.pricing import first_price
from shelfwise.functions.text import blank_to_null, text_key


def csv_values(text: str) -> list[str]:
    return [v.strip() for v in text.split(",") if v.strip()]


def clamp(value: object, default: int, most: int) -> int:
    """A limit between 1 and ``most``; what is no number is the default."""
    try:
        n = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = default
    return max(1, min(n, most))


def filter_feed(df: DataFrame, *, q: str = "", category: str = "", subcategory: str = "", brand: str = "", retailer: str = "", tag: str = "", source: str = "", store_id: str = "", min_discount: object = 0) -> DataFrame:
    """Rows that meet every condition given; lists are comma-separated. Tests are two-valued: null never passes one.

    ``q`` is found in the key of name, brand, category, asin and tags; a row without stores passes any ``store_id``.
    """
    import re

    conditions: list[Column] = []
    key = re.sub("[^a-z0-9]+", " ", q.lower()).strip()
    if key:
        hay = text_key(F.concat_ws(" ", *(blank_to_null(c) for c in ("name", "brand", "category", "asin")), F.array_join("tags", " ")))
        conditions.append(F.contains(hay, F.lit(key)))
    for column, wanted in (("category", category), ("subcategory", subcategory), ("brand", brand), ("retailer", retailer)):
        if csv_values(wanted):
            conditions.append(F.lower(F.coalesce(column, F.lit(""))).isin([v.lower() for v in csv_values(wanted)]))
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    if csv_values(tag):
        conditions.append(F.arrays_overlap(lower("tags"), F.array(*(F.lit(v.lower()) for v in csv_values(tag)))))
    if csv_values(source):
        conditions.append(F.arrays_overlap(F.concat(lower("sources"), lower("source_labels")), F.array(*(F.lit(v.lower()) for v in csv_values(source)))))
    try:
        least = float(min_discount or 0)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        least = 0
    if least:
        conditions.append(F.coalesce("discount_percent", F.lit(0)) >= least)
    if csv_values(store_id):
        own = F.coalesce("available_store_ids", F.array().cast("array<string>"))
        conditions.append((F.size(own) == 0) | F.arrays_overlap(own, F.array(*(F.lit(v) for v in csv_values(store_id)))))
    for c in conditions:
        df = df.filter(F.coalesce(c, F.lit(False)))
    return df


def order_of(mode: str, tie: Sequence[str]) -> list[Column]:
    """Sort keys of a mode, made total by ``tie``: discount, price-asc, source-count, or display."""
    name, percent = text_key("name").asc(), F.coalesce("discount_percent", F.lit(0)).desc()
    prime, basis = (F.when(blank_to_null(c).isNotNull(), 0).otherwise(1) for c in ("prime_price", "basis_price"))
    modes = {
        "discount": [percent, name], "price-asc": [F.asc_nulls_last(first_price(F.coalesce(blank_to_null("prime_price"), blank_to_null("current_price")))), name],
        "source-count": [F.coalesce("source_count", F.lit(0)).desc(), percent, name],
    }
    shown = F.when(F.coalesce("discount_percent", F.lit(0)) != 0, F.col("discount_percent")).otherwise(F.lit(-1))
    display = [shown.desc(), prime.asc(), basis.asc(), F.coalesce("source_count", F.lit(0)).desc(), F.coalesce("category_confidence", F.lit(0.0)).desc(), name]
    return [*modes.get(mode, display), *(F.col(t) for t in tie)]


def feed(df: DataFrame, mode: str, limit: int, tie: Sequence[str], **filters) -> DataFrame:
    """The first rows of a filtered feed: a top-k, not a full sort."""
    return filter_feed(df, **filters).orderBy(*order_of(mode, tie)).limit(limit)


def deal_score() -> Column:
    """Score of a row without a profile; ``floor(x + 0.5)`` rounds halves up."""
    percent = F.coalesce("discount_percent", F.lit(0))
    none = (percent == 0) & blank_to_null("basis_price").isNull()
    return percent * 4 + F.when(blank_to_null("prime_price").isNotNull(), 18).otherwise(0) + F.when(blank_to_null("basis_price").isNotNull(), 10).otherwise(0) - F.when(none, 18).otherwise(0) + F.greatest(F.lit(0), F.coalesce("source_count", F.lit(0)) - 1) * 10 + F.floor(F.coalesce("category_confidence", F.lit(0.0)) * 12 + 0.5)


def query_score(q: str) -> Column:
    if not q:
        return F.lit(0)
    name, brand = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("brand", F.lit("")))
    return F.when(F.startswith(name, F.lit(q)), 140).when(F.contains(name, F.lit(q)), 100).when(F.startswith(brand, F.lit(q)), 75).when(F.contains(brand, F.lit(q)), 55).otherwise(10)


def affinity(products: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``kind, value, n``: categories, brands and tags of the products in ``keys``."""
    own = products.join(keys, key, "left_semi")
    kinds = F.array(F.struct(F.lit("category").alias("kind"), F.array("category").alias("v")), F.struct(F.lit("brand").alias("kind"), F.array("brand").alias("v")), F.struct(F.lit("tag").alias("kind"), F.col("tags").alias("v")))
    return own.select(F.explode(kinds).alias("x")).select("x.kind", F.explode("x.v").alias("value")).filter("value IS NOT NULL AND value <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))


def personal_score(products: DataFrame, liked: DataFrame, disliked: DataFrame, key: str, q: str = "") -> DataFrame:
    """Adds ``score``: deal, query and preference parts. ``liked`` and ``disliked`` have a column ``key`` each."""
    weights = {"category": (16, -20), "brand": (16, -22), "tag": (8, -10)}
    plus = affinity(products, liked, key).select("kind", "value", F.col("n").alias("up"), F.lit(0).alias("down"))
    minus = affinity(products, disliked, key).select("kind", "value", F.lit(0).alias("up"), F.col("n").alias("down"))
    by = {k: plus.unionByName(minus).filter(F.col("kind") == k).groupBy("value").agg((F.sum("up") * w[0] + F.sum("down") * w[1]).alias("w")) for k, w in weights.items()}
    own = products
    for kind in ("category", "brand"):
        own = own.join(by[kind].withColumnsRenamed({"value": kind, "w": f"w_{kind}"}), kind, "left")
    tags = products.select(key, F.explode("tags").alias("value")).join(by["tag"], "value").groupBy(key).agg(F.sum("w").alias("w_tag"))
    own = own.join(tags, key, "left").join(liked.select(key).distinct().withColumn("l_", F.lit(24)), key, "left").join(disliked.select(key).distinct().withColumn("d_", F.lit(-90)), key, "left")
    parts = [F.coalesce(c, F.lit(0)) for c in ("w_category", "w_brand", "w_tag", "l_", "d_")]
    total = deal_score() + query_score(q)
    for p in parts:
        total = total + p
    return own.withColumn("score", total).drop("w_category", "w_brand", "w_tag", "l_", "d_")

"""Landed API payloads as flat records, counts and ids of search results, fallbacks, stored state, configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null
from shelfwise.working import new_path

#: The fields of a search result that may hold its count, and the parts of an image that may hold its link.
COUNT_FIELDS = ("availableTotalResultCount", "totalResultCount", "approximateTotalResultCount", "totalResultCountPreVE", "searchResultsCount", "numberOfResults")
IMAGE_FIELDS = ("url", "src", "small", "medium", "large")
PRODUCT_LINK = "https://www.wholefoodsmarket.com/grocery/product/"


def money(x: Column) -> Column:
    return F.format_string("$%.2f", x.try_cast("double"))


def api_items(rows: DataFrame, body: str) -> DataFrame:
    """Flat records of API items, one JSON text a row; items without an id, and texts that are no JSON, go."""
    at = lambda path: F.get_json_object(body, "$." + path)
    price = lambda name: F.when(at(f"offerDetails.price.{name}").isNotNull(), money(at(f"offerDetails.price.{name}")))
    image = F.coalesce(*(blank_to_null(at(f"productImages[0].{f}")) for f in IMAGE_FIELDS), F.when(~F.startswith(at("productImages[0]"), F.lit("{")), blank_to_null(at("productImages[0]"))))
    out = rows.select(
        blank_to_null(at("asin")).alias("asin"), at("brandName").alias("brand"), at("name").alias("name"), image.alias("image"), price("priceAmount").alias("current_price"),
        price("basisPriceAmount").alias("basis_price"), price("primeBenefit.priceAmount").alias("prime_price"), blank_to_null(at("offerDetails.price.savings.percentSavings")).alias("discount"),
        at("availability").alias("availability"),
    )
    return out.filter("asin IS NOT NULL").withColumn("url", F.concat(F.lit(PRODUCT_LINK), "asin"))


def result_ids(body: str) -> Column:
    """Ids of a search result's items in order; an item without one is left out."""
    found = F.from_json(F.get_json_object(body, "$.mainResultSet.searchResults"), "array<struct<asin:string>>")
    return F.filter(F.transform(F.coalesce(found, F.from_json(F.lit("[]"), "array<struct<asin:string>>")), lambda x: x["asin"]), lambda x: F.coalesce(x != "", F.lit(False)))


def result_count(body: str) -> Column:
    """The first count above zero; texts count where they are whole numbers."""
    numbers = [F.get_json_object(body, f"$.mainResultSet.{f}").try_cast("long") for f in COUNT_FIELDS]
    return F.coalesce(*(F.when(n > 0, n) for n in numbers))


def json_or(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """Records of a JSON file, an object or an array of them; the default where the file is missing, or holds nothing of that shape."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    rows = rows.dropna("all")
    return rows if default is None else or_else(rows, default)


def or_else(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows, or those of the other source where there are none: a look at one row."""
    return other if rows.isEmpty() else rows


def configured(spark: SparkSession, text: str, schema: str, built_in: Sequence[tuple]) -> DataFrame:
    """Rows of a configuration text; the built-in ones where it is empty, no JSON, or no list of any length."""
    try:
        found = json.loads(text or "null")
    except json.JSONDecodeError:
        found = None
    if not isinstance(found, list) or not found:
        return spark.createDataFrame(list(built_in), schema)
    return spark.createDataFrame([(json.dumps(x),) for x in found], "x string").select(F.from_json("x", schema).alias("x")).select("x.*")


def configured_rows(rows: DataFrame, key: str, body: str, schema: str, built_in: Sequence[tuple]) -> DataFrame:
    """``key`` and the entries of each row's configuration text, or the built-in ones where that is null, no JSON, or no list of any length."""
    found = F.from_json(F.col(body), f"array<struct<{schema}>>")
    names = [x.split()[0] for x in schema.split(", ")]
    given = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, t, strict=True))) for t in built_in)).cast(f"array<struct<{schema}>>")
    own = F.when(F.startswith(F.ltrim(body), F.lit("[")) & (F.size(found) > 0), found).otherwise(given)
    return rows.select(key, F.explode(own).alias("x")).select(key, "x.*")


def first_stored(keys: DataFrame, stores: Sequence[DataFrame], key: str, value: str, default: str) -> DataFrame:
    """The value of each key in the first store that has one, or the default. A store has one row a key."""
    out, names = keys, []
    for i, s in enumerate(stores):
        names.append(f"v{i}_")
        out = out.join(s.select(key, F.col(value).alias(names[-1])), key, "left")
    return out.select(key, F.coalesce(*names, F.lit(default)).alias(value))


def cached_catalog(spark: SparkSession, path: str | None, build: Callable[[], DataFrame], schema: str) -> DataFrame:
    """A catalog as it was written under ``path``; where it is missing or empty it is built, written and read back.

    Without a path it is written to the session's shared folder.
    """
    if path is not None:
        try:
            stored = spark.read.schema(schema).parquet(path)
            if not stored.isEmpty():
                return stored
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    to = path or new_path(spark, "catalog")
    build().write.mode("overwrite").parquet(to)
    return spark.read.schema(schema).parquet(to)


def shape_checked(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """Records of payloads that are JSON arrays; any other payload gives none."""
    lists = rows.filter(F.startswith(F.ltrim(body), F.lit("[")))
    return lists.select(F.explode(F.from_json(body, f"array<struct<{schema}>>")).alias("x")).select("x.*")

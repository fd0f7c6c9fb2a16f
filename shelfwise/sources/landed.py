"""Readers of landed JSON and HTML: typed scans with defaults, embedded JSON, tiles, object graphs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import read_array

OFFER = T.StructType([T.StructField(n, T.IntegerType() if n == "discount_percent" else T.ArrayType(T.StringType()) if n == "sources" else T.StringType()) for n in ("store_id", "current_price", "basis_price", "prime_price", "discount", "discount_percent", "unit_price", "url", "sources")])
_TEXTS = "asin name raw_name brand source_brand brand_source variation category subcategory image url retail_source_url unit_price current_price basis_price prime_price sale_price discount emoji expires retailer source_store_id source_store_name".split()
_LISTS = "asins sources source_labels source_categories tags available_store_ids category_signals".split()
#: The record of a product in every feed and in the merged catalog; what a feed lacks is null.
PRODUCT = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), *(T.StructField(n, T.ArrayType(T.StringType())) for n in _LISTS), T.StructField("discount_percent", T.IntegerType()), T.StructField("source_count", T.IntegerType()), T.StructField("category_confidence", T.DoubleType()), T.StructField("rank", T.DoubleType()), T.StructField("store_offers", T.ArrayType(OFFER))])


def read_feed(spark: SparkSession, path: str, source: str, retailer: str = "Whole Foods") -> DataFrame:
    """A JSON array of product records with one schema; a missing file gives no rows, '' becomes null.

    ``categories``, where a feed has them, are its source categories. ``ord`` is the order of the rows: by file, and
    within a file as they stand in it. A file is read by as many tasks as it has splits (``arrays.array_records``).
    """
    landed = T.StructType([*PRODUCT.fields, T.StructField("categories", T.ArrayType(T.StringType()))])
    try:
        rows = read_array(spark, path, landed)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], landed).withColumns({"file_": F.lit(""), "number_": F.lit(0)})
    rows = rows.withColumn("ord", F.concat_ws("|", "file_", F.lpad(F.col("number_").cast("string"), 20, "0")))
    rows = rows.withColumn("source_categories", F.coalesce("source_categories", "categories"))
    texts = [F.nullif(F.col(n), F.lit("")).alias(n) for n in _TEXTS if n != "retailer"]
    out = rows.select(*texts, F.coalesce(F.nullif(F.col("retailer"), F.lit("")), F.lit(retailer)).alias("retailer"), *_LISTS[1:2], *(c for c in _LISTS if c != "sources"), "discount_percent", "source_count", "category_confidence", "rank", "store_offers", "ord")
    return out.withColumn("sources", F.array(F.lit(source)))


def search_feed(rows: DataFrame) -> DataFrame:
    """Rows whose brand is a department name lose it to their source categories."""
    named = F.lower(F.trim("brand")) == "fresh produce"
    categories = F.when(named, F.array_union(F.coalesce("source_categories", F.expr("CAST(array() AS array<string>)")), F.array(F.col("brand")))).otherwise(F.col("source_categories"))
    return rows.withColumn("source_categories", categories).withColumn("brand", F.when(~F.coalesce(named, F.lit(False)), F.col("brand")))


def flyer_order(rows: DataFrame) -> DataFrame:
    """Flyer rows by rank, none last as 9999; the sale price where there is no current one."""
    return rows.withColumn("current_price", F.coalesce("current_price", "sale_price")).orderBy(F.coalesce("rank", F.lit(9999.0)), "ord")


def embedded_json(html: Column) -> Column:
    """The JSON text of a page's data script."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


class _Tiles(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self._in: list[str] = []
        self._text: list[str] = []
        self._link = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "a":
            self._link, self._text = dict(attrs).get("href") or "", []
            self._in.append(tag)

    def handle_data(self, data: str) -> None:
        if self._in:
            self._text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self._in:
            self._in.pop()
            self.found.append((self._link, " ".join("".join(self._text).split())))


def tiles(html: str | None) -> list[tuple[str, str]]:
    """Links of a page with their text, in order; broken markup is read as far as it goes."""
    parser = _Tiles()
    parser.feed(html or "")
    return parser.found


def read_tiles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, href, label`` of every link of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, h, t) for k, x in zip(b[key], b[html], strict=True) for i, (h, t) in enumerate(tiles(x))]
            yield pd.DataFrame(rows, columns=[key, "pos", "href", "label"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, href string, label string")


def graph_offers(objects: DataFrame) -> DataFrame:
    """Products of a normalised object graph (``id, obj`` with pointers): product to item to seller to offer, three joins.

    ``obj``: struct of name, price, list and ``ref`` (id of the next object). Kept where the list price is above the price.
    """
    p, i, s, o = (objects.select(F.col("id").alias(f"{n}_id"), F.col("obj").alias(n)) for n in "piso")
    chain = p.filter("startswith(p_id, 'Product')").join(i, F.col("p.ref") == F.col("i_id")).join(s, F.col("i.ref") == F.col("s_id")).join(o, F.col("s.ref") == F.col("o_id"))
    return chain.filter("o.list > o.price").select(F.col("p_id").alias("asin"), F.col("p.name").alias("name"), F.col("o.price").alias("price"), F.col("o.list").alias("list"))

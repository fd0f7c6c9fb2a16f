"""The whole merged record of an entity: what comes of its rows one after another, without gathering them.

What a row changes depends on rows before it only through a few facts: the first value of a field, the row at which a source
first named the brand, the last row that cleared it, and the offers that were primary one after another. Each is a minimum, a
maximum or a short array of distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.functions.dialect import SPARK
from shelfwise.functions.names import display_name
from shelfwise.functions.pricing import other_suffix, unit_suffix
from shelfwise.functions.text import text_key
from shelfwise.operators.merge import filled, first_non_empty, in_order

#: What the primary offer says of a record, and the category that a fresh row has.
OFFERED = ("current_price", "basis_price", "prime_price", "discount", "discount_percent", "unit_price", "url")
FRESH = "fresh produce"


def _first(rows: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    return rows.filter(filled(rows, column)).groupBy(key).agg(F.min_by(column, order).alias(name))


def _brands(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key, b``: ``struct<brand, source_brand, brand_source, taken>``; ``taken`` has the rows at which a source's brand took the place of another, and the brand.

    Until a source names it, the brand is the first one after the last row that cleared it; from then on only longer names of
    sources count, and repeats of a name change nothing, so these are folded over a key's distinct ones.
    """
    own = rows.filter(filled(rows, "brand")).select(key, order, "brand", F.nullif("source_brand", F.lit("")).alias("source_brand"), F.coalesce(F.nullif("brand_source", F.lit("")), F.lit("derived")).alias("brand_source"))
    own = own.withColumn("source_brand", F.when(F.col("brand_source") == "source", F.coalesce("source_brand", "brand")))
    first = rows.groupBy(key).agg(F.min(order).alias("first_"))
    start = own.filter("brand_source = 'source'").groupBy(key).agg(F.min(order).alias("start_"))
    cleared = rows.filter("fresh_").join(first, key).filter(F.col(order) > F.col("first_")).select(key, F.col(order).alias("cleared_"))
    last = cleared.join(start, key, "left").filter("start_ IS NULL OR cleared_ < start_").groupBy(key).agg(F.max("cleared_").alias("last_"))
    bounds = first.join(start, key, "left").join(last, key, "left")
    other = own.join(bounds, key).filter((F.col("last_").isNull() | (F.col(order) > F.col("last_"))) & (F.col("start_").isNull() | (F.col(order) < F.col("start_"))))
    derived = other.groupBy(key).agg(F.min_by(F.struct("brand", "brand_source"), order).alias("derived_"))
    named = own.filter("brand_source = 'source'").groupBy(key, "brand", "source_brand").agg(F.min(order).alias("o_"))
    listed = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o_", "brand", "source_brand"))).alias("names_"))  # a key's distinct names
    listed = listed.join(derived, key, "left")
    none = F.array().cast(f"array<struct<o_: {rows.schema[order].dataType.simpleString()}, brand: string>>")
    place = lambda n: F.array(F.struct(n["o_"].alias("o_"), n["brand"].alias("brand")))
    one = lambda n, taken: F.struct(n["brand"].alias("brand"), n["source_brand"].alias("source_brand"), taken.alias("taken"))
    goes_on = lambda held, n: F.startswith(text_key(n["source_brand"]), F.concat(text_key(held["source_brand"]), F.lit(" ")))
    head = F.get("names_", F.lit(0))
    # where nothing stood before, a row fills the brand in; where a derived one stood, it takes its place
    began = one(head, F.when(F.col("derived_").isNotNull(), place(head)).otherwise(none))
    folded = F.aggregate(F.slice("names_", 2, F.size("names_")), began, lambda held, n: F.when(goes_on(held, n), one(n, F.concat(held["taken"], place(n)))).otherwise(held))
    both = rows.select(key).distinct().join(listed.select(key, folded.alias("s_")), key, "left").join(derived, key, "left")
    s, t = F.col("s_"), F.col("derived_")
    made = lambda brand, source_brand, source, taken: F.struct(brand.alias("brand"), source_brand.alias("source_brand"), source.alias("brand_source"), taken.alias("taken"))
    by_source = made(s["brand"], s["source_brand"], F.lit("source"), s["taken"])
    return both.select(key, F.when(s.isNotNull(), by_source).otherwise(made(t["brand"], F.lit(None).cast("string"), t["brand_source"], none)).alias("b"))


def _offers(rows: DataFrame, key: str, order: str, defaults: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``key, store_offers`` (an array, stores in the order of their first row), and ``key`` with what the primary offers said.

    An offer's field is its last value that is not empty. The primary offer is that of the first of ``defaults`` that is there,
    else of the store that came first; a field that it leaves empty is what the primary offer before it said at the time.
    """
    some = rows.filter(filled(rows, "store_id")).withColumn("store_id", F.col("store_id").cast("string")).withColumn("discount_percent", F.coalesce("discount_percent", F.lit(0)))
    first = some.groupBy(key, "store_id").agg(F.min(order).alias("o_"))
    values = first_non_empty(some, [key, "store_id"], order, OFFERED, last=True)
    sources = some.filter(filled(some, "source")).groupBy(key, "store_id", "source").agg(F.min(order).alias("o_")).groupBy(key, "store_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_", "source"))), lambda x: x["source"]).alias("sources"))
    offers = values.join(first, [key, "store_id"]).join(sources, [key, "store_id"], "left")
    one = F.struct("o_", "store_id", *OFFERED, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    listed = offers.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[c].alias(c) for c in ("store_id", *OFFERED, "sources")))).alias("store_offers"))
    rank = reduce(lambda c, i: c.when(F.col("store_id") == defaults[i], i), range(1, len(defaults)), F.when(F.col("store_id") == defaults[0], 0)).otherwise(len(defaults)) if defaults else F.lit(0)
    ahead = Window.partitionBy(key).orderBy("o_").rowsBetween(Window.unboundedPreceding, -1)
    chosen = first.withColumn("rank_", rank).withColumn("best_", F.min("rank_").over(ahead)).filter("best_ IS NULL OR rank_ < best_")
    chosen = chosen.withColumn("until_", F.lead("o_").over(Window.partitionBy(key).orderBy("o_"))).select(key, "store_id", F.col("o_").alias("from_"), "until_")
    spoken = some.join(chosen, [key, "store_id"]).filter(F.col("until_").isNull() | (F.col(order) < F.col("until_")))
    said = first_non_empty(spoken, [key, "from_"], order, OFFERED, last=True)
    return listed, said.groupBy(key).agg(*(F.max_by(c, F.when(filled(said, c), F.col("from_"))).alias(c) for c in OFFERED))


def merged_records(
    rows: DataFrame, key: str, order: str, scalars: Sequence[str] = (), defaults: Sequence[str] = (), shown: Callable[[Column, Column], Column] = lambda name, brand: display_name(name)
) -> DataFrame:
    """One record a ``key`` of rows that come in ``order``, which is unique within a key.

    Rows have ``name, raw_name, brand, source_brand, brand_source, source_categories`` (array), ``source, store_id, retailer``, ``OFFERED`` and
    ``scalars``; what a row has besides a null, '' or [] counts, 0 too. Of a row without a brand, ``brand_source`` is not looked at,
    of one with a brand it is ``derived`` by default; ``source_brand`` is that of rows of a source alone, by default the brand. A record has

    * of ``scalars``, names and prices the first value;
    * the brand that a source names over others, and a longer one that goes on from it over that; each time one takes the place of
      another, the name is ``shown`` again (of the raw name, if there has been one, else of that row's name);
    * the first categories, united with those of every later row that has ``FRESH`` among them, which also clears a brand that no
      source named (the first row does neither);
    * sources and stores in order, ``store_offers``, and over the prices so far what the primary offer says;
    * for records of several rows, a prime price with the unit of the regular one; the retailer's name; tags.

    Empty tables give no records. Memory is bounded by a key's distinct brands, sources and stores, not by its rows.
    """
    fresh = F.coalesce(F.exists("source_categories", lambda c: text_key(c) == FRESH), F.lit(False))
    rows = rows.withColumn("fresh_", fresh)
    base = first_non_empty(rows, [key], order, [*dict.fromkeys([*scalars, *OFFERED, "name", "raw_name", "retailer", "source_categories"])])
    counts = rows.groupBy(key).agg(F.count("*").alias("n_"), F.min(order).alias("first_"), F.min(F.when(filled(rows, "raw_name"), F.col(order))).alias("raw_from_"))
    out = base.join(counts, key).join(_brands(rows, key, order), key)
    # the name as it was shown last: of the raw name so far, or of the row that the brand is of, where it has one
    taken = out.select(key, "raw_name", "raw_from_", F.explode("b.taken").alias("t_")).select(key, "raw_name", "raw_from_", F.col("t_.o_").alias(order), F.col("t_.brand").alias("brand_"))
    called = F.coalesce(F.when(F.col("raw_from_") <= F.col(order), F.col("raw_name")), F.nullif("name_", F.lit("")))
    taken = taken.join(rows.select(key, order, F.col("name").alias("name_")), [key, order]).withColumn("called_", called).filter("called_ IS NOT NULL")
    again = taken.groupBy(key).agg(F.max_by(F.struct("called_", "brand_"), order).alias("again_"))
    out = out.join(again, key, "left").withColumn("name", F.coalesce(F.when(F.col("again_").isNotNull(), shown(F.col("again_.called_"), F.col("again_.brand_"))), F.col("name")))
    out = out.withColumns({c: F.col("b")[c] for c in ("brand", "source_brand", "brand_source")})
    later = rows.filter("fresh_").join(rows.groupBy(key).agg(F.min(order).alias("first_")), key).filter(F.col(order) > F.col("first_"))
    united = later.select(key, F.explode("source_categories").alias("c_")).groupBy(key).agg(F.collect_set("c_").alias("fresh_categories_"))
    out = out.join(united, key, "left")
    both = F.array_sort(F.array_union(F.coalesce("source_categories", F.array().cast("array<string>")), F.col("fresh_categories_")))
    out = out.withColumn("source_categories", F.when(F.col("fresh_categories_").isNotNull(), both).otherwise(F.col("source_categories")))
    for column, name in (("source", "sources"), ("store_id", "available_store_ids")):
        out = out.join(in_order(rows.filter(filled(rows, column)), key, column, order).withColumnRenamed("v_", name), key, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"sources": F.coalesce("sources", empty), "available_store_ids": F.coalesce(F.col("available_store_ids").cast("array<string>"), F.array(*map(F.lit, defaults)).cast("array<string>"))})
    listed, said = _offers(rows, key, order, defaults)
    out = out.join(listed, key, "left").join(said.select(key, F.struct(*OFFERED).alias("said_")), key, "left")
    out = out.withColumns({c: F.coalesce(F.col("said_")[c], F.col(c)) for c in OFFERED})
    harmonised = F.expr(other_suffix(SPARK, "prime_price", unit_suffix("basis_price")))
    priced = (F.col("n_") > 1) & (F.col("basis_price") != "") & (F.col("prime_price") != "")
    out = out.withColumn("prime_price", F.when(priced, harmonised).otherwise(F.col("prime_price")))
    out = out.withColumn("source_count", F.size("sources").cast("long")).withColumn("retailer", text.retailer(F.col("retailer"), F.col("url"), F.col("sources")))
    category = F.col("category") if "category" in scalars else F.lit(None).cast("string")
    out = out.withColumn("tags", text.tags(F.col("name"), F.col("brand"), category, F.col("sources"), F.col("source_count"), F.col("prime_price")))
    named = ["name", "raw_name", "brand", "source_brand", "brand_source", "source_categories", "sources", "source_count", "available_store_ids", "retailer", *OFFERED, "store_offers", "tags"]
    return out.select(key, *(s for s in scalars if s not in named), *named)

"""A client's state: default payloads, a profile made valid, order of shelves, active filters, local patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null

#: Schemas of the empty state.
DEFAULTS = {
    "gold_labels": "version string, updated_at string, labels array<struct<key:string,category:string,subcategory:string>>",
    "fixes": "brand_overrides_by_key map<string,string>, brand_overrides_by_signature map<string,string>, subcategory_overrides_by_key map<string,string>, subcategory_overrides_by_signature map<string,string>",
    "profile": "selected_store_ids array<string>, liked array<string>, disliked array<string>, saved array<string>, filters struct<category:string,subcategory:string,min_discount:string>",
}


#: Filters that let everything through.
EMPTY_FILTERS = {"category": "", "subcategory": "", "min_discount": "0"}


def default_payload(spark: SparkSession, name: str) -> DataFrame:
    """The shape of an empty state, without rows."""
    return spark.createDataFrame([], DEFAULTS[name])


def normal_profile(body: Column) -> Column:
    """A stored profile made valid: ``struct`` of ``DEFAULTS['profile']``. What is missing, or not of its kind, is as in an empty profile;
    several chosen stores are none."""
    p = F.from_json(body, DEFAULTS["profile"])
    none = F.array().cast("array<string>")
    filters = F.struct(*(F.coalesce(p["filters"][k], F.lit(v)).alias(k) for k, v in EMPTY_FILTERS.items()))
    return F.struct(selected_stores(p["selected_store_ids"]).alias("selected_store_ids"), *(F.coalesce(p[k], none).alias(k) for k in ("liked", "disliked", "saved")), filters.alias("filters"))


def selected_stores(ids: Column) -> Column:
    """One store that is chosen; none, or several, are no choice."""
    own = F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(own) == 1, own).otherwise(F.array().cast("array<string>"))


def active_filters(query: Column, category: Column, subcategory: Column, min_discount: Column) -> Column:
    filled = [blank_to_null(x).isNotNull() for x in (query, category, subcategory)]
    return filled[0] | filled[1] | filled[2] | (F.coalesce(min_discount.try_cast("double"), F.lit(0.0)) != 0)


def working_order(saved: Column, shown: Column) -> Column:
    """Saved shelves that are shown, then the others that are."""
    kept = F.filter(F.coalesce(saved, F.array().cast("array<string>")), lambda x: F.array_contains(shown, x))
    return F.concat(kept, F.array_except(shown, kept))


def moved(order: Column, item: Column, up: Column) -> Column:
    """The array with ``item`` and its neighbour in the other's place; as it is at either end, and without the item."""
    at = F.array_position(order, item)  # from 1, 0 without
    to = F.when(up, at - 1).otherwise(at + 1)
    fits = (at > 0) & (to >= 1) & (to <= F.size(order))
    swap = F.transform(order, lambda x, i: F.when(i + 1 == at, F.get(order, (to - 1).cast("int"))).when(i + 1 == to, item).otherwise(x))
    return F.when(fits, swap).otherwise(order)


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Rows with the category and subcategory of their patch, and status ``gold`` where there is one; one patch a key."""
    own = patches.select(F.col(key).alias("k_"), F.col("category").alias("c_"), F.col("subcategory").alias("s_"))
    out = rows.join(own, F.col(key) == F.col("k_"), "left")
    return out.withColumns({"status": F.when(F.col("k_").isNotNull(), "gold").otherwise(F.col("status")), "category": F.coalesce("c_", "category"), "subcategory": F.coalesce("s_", "subcategory")}).drop("k_", "c_", "s_")

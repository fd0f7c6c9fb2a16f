"""Links as column expressions: query strings, a page's number, promotions, absolute links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where feeds are asked for.
SEARCH_API, PRODUCTS_API = "https://www.wholefoodsmarket.com/api/wwos/rsi/search?", "https://www.wholefoodsmarket.com/api/wwos/products?"
FLYER, PROMOTION = "https://www.wholefoodsmarket.com/sales-flyer?store-id=", "https://www.wholefoodsmarket.com/promotion/"


def encoded(x: Column) -> Column:
    """A query's name or value: blanks as plus signs, a tilde as it is, an asterisk as its code."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_string(values: Mapping[str, Column | str]) -> Column:
    """``name=value`` of every pair, in order; null values are empty."""
    of = lambda v: F.coalesce((F.lit(v) if isinstance(v, str) else v).cast("string"), F.lit(""))
    return F.concat_ws("&", *(F.concat(encoded(F.lit(k)), F.lit("="), encoded(of(v))) for k, v in values.items()))


def search_link(lister: Column, sort: Column, offset: Column, size: Column, filters: Column, category: str = "") -> Column:
    """The search at an offset; ``filters`` is an array, the first the one of all deals."""
    return F.concat(F.lit(SEARCH_API), query_string({"text": "", "old": lister, "offset": offset, "size": size, "sort": sort, "programType": "GROCERY", "filters": F.array_join(filters, ","), "categories": category}))


def products_link(lister: Column, ids: Column) -> Column:
    return F.concat(F.lit(PRODUCTS_API), query_string({"offerListingDiscriminator": lister, "programType": "GROCERY", "asins": F.array_join(ids, ",")}))


def page_link(url: Column, page: Column) -> Column:
    """The link with ``page`` set: in the place of the first one that it has, else at the end. Other pairs keep their order, pairs without
    a name are left out, and a fragment stays at the end."""
    fragment, bare = F.regexp_extract(url, "(#.*)$", 1), F.regexp_replace(url, "#.*$", "")
    head, query = F.substring_index(bare, "?", 1), F.when(F.contains(bare, F.lit("?")), F.regexp_extract(bare, r"\?(.*)$", 1)).otherwise("")
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("=")))
    name = lambda p: F.url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.url_decode(F.regexp_extract(p, "=(.*)$", 1))).otherwise("")
    names = F.transform(pairs, name)
    at = F.array_position(names, "page")
    number = F.concat(F.lit("page="), page.cast("string"))
    kept = F.filter(pairs, lambda p, i: (name(p) != "page") | (i + 1 == at))
    # pairs of one name stand together, where the first of them does
    grouped = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.array_position(names, name(p)).alias("first"), i.alias("i"), F.when(name(p) == "page", number).otherwise(F.concat(encoded(name(p)), F.lit("="), encoded(value(p)))).alias("text"))))
    texts = F.transform(grouped, lambda x: x["text"])
    return F.concat(head, F.lit("?"), F.array_join(F.when(at > 0, texts).otherwise(F.array_append(texts, number)), "&"), fragment)


def flyer_link(store: Column) -> Column:
    return F.concat(F.lit(FLYER), store.cast("string"))


def promotion_link(promotion: Column, store: Column) -> Column:
    """Null without a promotion."""
    return F.when(promotion != "", F.concat(F.lit(PROMOTION), promotion, F.lit("?store-id="), store.cast("string")))


def absolute_link(href: Column, site: str) -> Column:
    """Secure and absolute; null where it is neither a link nor a path."""
    own = F.trim(href)
    return F.when(own.rlike("^https?://"), F.regexp_replace(own, "^http:", "https:")).when(F.startswith(own, F.lit("/")), F.concat(F.lit(site), own))

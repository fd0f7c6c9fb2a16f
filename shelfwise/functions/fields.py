"""Single fields of a record: ids in links and texts, display texts, signatures, durations, JSON without empty fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_to_null, text_key

#: An id in a text, an id in a product link, and the mark at the end of a tile's text.
ID_IN_TEXT = r"\b(B[0-9A-Z]{9})\b"
ID_IN_LINK = r"(?i)/grocery/product/([A-Z0-9]{10})"
PRIME_TEXT = r"Join Prime to buy this item at\s+(\$[\d.,]+(?:/\w+)?)"
DEFAULT_RETAILER = "Whole Foods"
DEFAULT_CATEGORY = "Pantry"


def id_of_link(link: Column) -> Column:
    """The id in a product link in capitals; null without one."""
    return F.upper(F.nullif(F.regexp_extract(link, ID_IN_LINK, 1), F.lit("")))


def ids_of_text(text: Column) -> Column:
    """The distinct ids in a text, in order; a null text has none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ID_IN_TEXT), F.lit(1))))


def prime_price_text(text: Column) -> Column:
    """The price that a sentence on Prime names, else the trimmed text; empty as null."""
    found = F.nullif(F.regexp_extract(text, PRIME_TEXT, 1), F.lit(""))
    return F.coalesce(found, F.nullif(F.trim(text), F.lit("")))


def tidy(text: Column) -> Column:
    """White space as one blank, trimmed, without a star at the end; empty as null."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.nullif(F.trim(F.regexp_replace(one, r"\s+\*$", "")), F.lit(""))


def shortened(text: Column, most: int, mark: str = "...<truncated>") -> Column:
    """The first ``most`` characters and a mark, where there are more; null as ''."""
    own = F.coalesce(text, F.lit(""))
    return F.when(F.length(own) <= most, own).otherwise(F.concat(F.left(own, F.lit(most)), F.lit(mark)))


def escaped(text: Column) -> Column:
    """Text for HTML; null as ''."""
    out = F.coalesce(text, F.lit(""))
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def duration(seconds: Column) -> Column:
    """``1h 02m``, ``3m 04s`` or ``5s``; below zero counts as zero."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), two(rest), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


def _is_empty(kind: T.DataType, x: Column) -> Column:
    if isinstance(kind, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    return x.isNull()


def compact_json(schema: T.StructType, names: list[str]) -> Column:
    """The named fields as JSON without those that are null, '', [] or {}; JSON itself leaves nulls out."""
    kinds = {f.name: f.dataType for f in schema}
    return F.to_json(F.struct(*(F.when(~_is_empty(kinds[n], F.col(n)), F.col(n)).alias(n) for n in names)))


def product_id(asin: Column, url: Column, name: Column) -> Column:
    """The first of id, link and name that is not empty."""
    return F.coalesce(blank_to_null(asin), blank_to_null(url), blank_to_null(name))


def brand_signature(retailer: Column, brand: Column, raw_name: Column, name: Column, key=text_key) -> Column:
    """``brand:retailer:brand``, or by name where there is no brand. ``key`` levels each part (a page levels by lower case only)."""
    shop = key(F.coalesce(blank_to_null(retailer), F.lit(DEFAULT_RETAILER)))
    own = F.coalesce(key(brand), F.lit(""))
    named = F.coalesce(key(F.coalesce(blank_to_null(raw_name), blank_to_null(name))), F.lit(""))
    return F.when(own != "", F.concat_ws(":", F.lit("brand"), shop, own)).otherwise(F.concat_ws(":", F.lit("name"), shop, named))


def subcategory_signature(retailer: Column, brand: Column, subcategory: Column, category: Column) -> Column:
    shop = text_key(F.coalesce(blank_to_null(retailer), F.lit(DEFAULT_RETAILER)))
    own, sub = text_key(brand), text_key(F.coalesce(blank_to_null(subcategory), blank_to_null(category), F.lit(DEFAULT_CATEGORY)))
    return F.when(own != "", F.concat_ws(":", F.lit("subcategory"), shop, own, sub)).otherwise(F.concat_ws(":", F.lit("subcategory"), shop, sub))


def has_deal(*fields: Column) -> Column:
    """Whether any of the fields is not empty."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(f != "", F.lit(False))
    return out


def retry_delay(retry_after: Column, attempt: Column, base: float) -> Column:
    """Seconds to wait: what the server asks for, ``base`` at least, or else ``base`` doubled with each attempt."""
    asked = retry_after.try_cast("double")
    return F.when(asked.isNotNull(), F.greatest(asked, F.lit(base))).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempt))


def first_score(*scores: Column) -> Column:
    """The first score that there is, to four places."""
    return F.round(F.coalesce(*(s.try_cast("double") for s in scores)), 4)

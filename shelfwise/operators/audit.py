"""Catalog audit: reasons, buckets and findings as expressions over one scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null, compact_key

#: Lower ends of the confidence buckets and their names.
BUCKETS = ((0.9, "0.90-1.00"), (0.75, "0.75-0.89"), (0.55, "0.55-0.74"), (0.35, "0.35-0.54"))
#: Brands that name nothing.
GENERIC_BRANDS = ("fresh produce", "produce", "unknown", "none", "select")

#: Rules by category on the words of a name, the first that fits; the bucket of failed rows comes before them.
FAILED = ("Other", "Failed fallback bucket.")
SUSPICIOUS = (
    ("Produce", "gummy|gummies|soda|coffee|tea|shampoo|serum|capsule|tablet|supplement|extract|shot|water|juice|spray", "Produce label with packaged/drink/supplement/personal-care words."),
    ("Pantry", "shampoo|conditioner|serum|cream|spray|capsule|tablet|collagen|magnesium|probiotic|vitamin|extract|oil", "Pantry label with likely wellness or personal-care words."),
    ("Beverages", "shampoo|conditioner|serum|cream|spray|capsule|tablet|essential oil", "Beverage label with non-drink words."),
    ("Dairy & Eggs", "pizza|pasta|snack|bar|vegan cheese|dairy free", "Dairy label with possible prepared/frozen/snack/dairy-alternative ambiguity."),
    ("Alcohol", "hummus|snack|salami|seltzer water|water", "Alcohol label with likely non-alcohol product words."),
)
#: What marks a promotion of several products, and an item of a fresh counter.
GROUPED = (" and ", ", ", " or ", "mix and match", "select ")
FRESH_COUNTER = (
    "apples", "asparagus", "avocados", "strawberries", "lemons", "oranges", "mangoes", "kiwis", "dates", "salmon", "shrimp", "ham", "lamb", "biscuits", "croissants", "cookies", "cake",
    "quiche", "sliced-in-house", "fresh ", "fillets", "/lb",
)


def suspicious_reason(category: Column, text: Column, failed: tuple[str, str] = FAILED, rules=SUSPICIOUS) -> Column:
    """Why a label is doubtful; ``text`` is a key of single words. Null if it is not."""
    out = F.when(category == failed[0], failed[1])
    for name, words, why in rules:
        out = out.when((category == name) & text.rlike(rf"\b({words})\b"), why)
    return out


def holds_any(name: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts is in a name, in lower case; a null name holds none."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def confidence_bucket(c: Column) -> Column:
    out = None
    for least, name in BUCKETS:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise("0.00-0.34")


def brand_reason(brand: Column, source_brand: Column) -> Column:
    """Missing, generic, or apart from the source's brand with neither holding the other; null if fine."""
    a, b = compact_key(brand), compact_key(source_brand)
    apart = (F.coalesce(source_brand, F.lit("")) != "") & ~F.contains(a, b) & ~F.contains(b, a)
    return F.when(F.coalesce(brand, F.lit("")) == "", "Missing brand.").when(F.lower(brand).isin(*GENERIC_BRANDS), "Suspicious generic brand.").when(apart, "Brand differs from source_brand.")


def data_reasons(image: Column, url: Column, price: Column, discount: Column, percent: Column) -> Column:
    """All of six findings, joined."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    p = F.coalesce(percent, F.lit(0))
    found = F.array(
        F.when(~some(image), "Missing image"), F.when(~some(url), "Missing product URL"), F.when(~some(price), "Missing sale/current price"), F.when(~some(discount), "Missing discount text"),
        F.when(p >= 80, "Very high discount percent"), F.when((p == 0) & some(discount), "Discount text did not parse into percent"),
    )
    return F.array_join(F.array_compact(found), "; ")


def missing_fields(*names: str) -> Column:
    """Names of the empty fields, comma-joined; '' if none is."""
    return F.array_join(F.array_compact(F.array(*(F.when(blank_to_null(F.col(n).cast("string")).isNull(), n) for n in names))), ",")


def share(part: Column, total: Column) -> Column:
    """A share as text with one decimal; of nothing 0.0%."""
    return F.when(total == 0, "0.0%").otherwise(F.concat((part * 100 / total).cast("decimal(6,1)").cast("string"), F.lit("%")))

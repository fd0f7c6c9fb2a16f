"""Text keys, phrase tests and small classifiers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The emoji ladder, first match wins; a term after ``!`` must not occur.
EMOJI = (
    (("avocado",), "🥑"), (("milk", "creamer"), "🥛"), (("chicken",), "🍗"), (("beef", "lamb", "ham"), "🥩"), (("salmon", "fish"), "🐟"), (("shrimp",), "🍤"),
    (("strawberry", "strawberries"), "🍓"), (("apple",), "🍎"), (("bread",), "🍞"), (("croissant",), "🥐"), (("cheese",), "🧀"), (("lemon",), "🍋"), (("orange",), "🍊"),
    (("mango",), "🥭"), (("kiwi",), "🥝"), (("broccoli",), "🥦"), (("egg",), "🥚"), (("dates",), "🌴"), (("quiche",), "🥧"), (("bacon",), "🥓"), (("potato", "!sweet"), "🥔"),
    (("potato",), "🍠"), (("pancake",), "🥞"), (("juice",), "🧃"), (("rice",), "🍚"), (("cake",), "🍰"), (("chocolate",), "🍫"), (("blueberry", "blueberries"), "🫐"), (("popcorn",), "🍿"), (("corn",), "🌽"),
)
NO_EMOJI = "🛒"

#: Tags and the substrings that give them.
TAGS = (
    ("organic", ("organic",)), ("vegan", ("vegan",)), ("vegetarian", ("vegetarian",)), ("gluten-free", ("gluten free", "gluten-free")), ("keto", ("keto",)),
    ("paleo", ("paleo",)), ("non-gmo", ("non-gmo", "non gmo")), ("dairy-free", ("dairy free", "dairy-free")), ("high-protein", ("protein",)),
)

#: What the fuzzy form of a name leaves out, in this order.
FUZZY = (("&", " and "), ("–", " "), ("-", " "), ("/", " "), (",", " "), (".", " "), (" oz ", " "), (" ounce ", " "), (" ounces ", " "), (" lb ", " "), (" ea ", " "), (" ct ", " "), (" pk ", " "))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(_col(x), F.lit(""))


def text_key(x: Column | str) -> Column:
    """Lower case, other runs than ASCII letters and digits as one space, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]+", " "))


def compact_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]+", "")


def brand_key(x: Column | str) -> Column:
    """As ``text_key`` with apostrophes taken out first."""
    return text_key(F.regexp_replace(F.coalesce(_col(x), F.lit("")), "[’']", ""))


def slug(x: Column | str) -> Column:
    return F.replace(text_key(x), F.lit(" "), F.lit("-"))


def fuzzy_key(x: Column | str) -> Column:
    out = F.trim(F.lower(F.coalesce(_col(x), F.lit(""))))
    for old, new in FUZZY:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def variants(phrase: str) -> list[str]:
    """A phrase's key, its two words turned round, and its last word in the plural."""
    import re

    words = re.sub("[^a-z0-9]+", " ", phrase.lower()).split()
    if not words:
        return []
    last = words[-1]
    many = {last + ("es" if last.endswith(("s", "x", "z", "ch", "sh")) else "s")}
    if len(last) > 1 and last[-1] in "yo":
        many.add(last[:-1] + "ies" if last[-1] == "y" else last + "es")
    found = [" ".join(words)] + [" ".join(reversed(words))] * (len(words) == 2) + [" ".join([*words[:-1], m]) for m in sorted(many)]
    return list(dict.fromkeys(found))


def has_phrase(haystack: Column | str, phrase: str) -> Column:
    """Whole-word match of a phrase or a variant of it in a text key."""
    padded = F.concat(F.lit(" "), _col(haystack), F.lit(" "))
    tests = [F.contains(padded, F.lit(f" {v} ")) for v in variants(phrase)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def has_any(text: Column | str, terms: Sequence[str]) -> Column:
    """Raw substring test: 'tea' is in 'steak'."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(_col(text), F.lit(t))
    return F.coalesce(out, F.lit(False))


def has_word(text: Column | str, term: str) -> Column:
    return F.contains(F.concat(F.lit(" "), text_key(text), F.lit(" ")), F.lit(f" {term} "))


def emoji(name: Column | str) -> Column:
    level = F.lower(_col(name))
    out = None
    for terms, sign in EMOJI:
        test = has_any(level, [t for t in terms if t[0] != "!"])
        for t in terms:
            if t[0] == "!":
                test = test & ~F.contains(level, F.lit(t[1:]))
        out = F.when(test, sign) if out is None else out.when(test, sign)
    return out.otherwise(NO_EMOJI)


def tags(name, brand, category, sources: Column, source_count: Column, prime: Column) -> Column:
    """Sorted distinct tags of a record."""
    level = F.lower(F.concat_ws(" ", blank_to_null(name), blank_to_null(brand), blank_to_null(category)))
    found = [F.when(has_any(level, words), tag) for tag, words in TAGS]
    found.append(F.when(source_count > 1, "multi-source deal").when((F.size(sources) == 1) & (F.element_at(sources, 1) == "Flyer"), "flyer-only deal"))
    found.append(F.when(prime.isNotNull() & (prime != ""), "prime deal"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def retailer(value: Column, url: Column, sources: Column) -> Column:
    """Alias of the name, else the site, else the sources; the first retailer if nothing tells."""
    key = text_key(value)
    link, source = F.lower(F.coalesce(url, F.lit(""))), text_key(F.array_join(F.coalesce(sources, F.array().cast("array<string>")), " "))
    named = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(key.isin("whole foods", "whole foods market", "wfm"), "Whole Foods").when(key == "target", "Target").when(key.isin("h mart", "hmart"), "H Mart")
        .when((named != "") & (key != "unknown"), named)
        .when(F.contains(link, F.lit("wholefoodsmarket.com")) | has_any(source, ["flyer", "all deals", "search deals"]), "Whole Foods")
        .when(F.contains(link, F.lit("target.com")) | F.contains(source, F.lit("target deals")), "Target")
        .when(F.contains(link, F.lit("hmart")) | F.contains(source, F.lit("h mart deals")), "H Mart")
        .otherwise("Whole Foods")
    )


def source_label(x: Column | str) -> Column:
    name = F.trim(_col(x))
    return F.when(name == "Search Deals", "Search").when(name == "Target Deals", "Target").when(name == "H Mart Deals", "H Mart").otherwise(name)


#: What the text that rules look at has other words for, in this order.
REWRITES = (("fl oz", " fluid ounce"), ("oz cans", " cans"), ("sparkling water beverage", "sparkling water"), ("fruit spread preserves", "fruit spread"))


def haystack(name: Column | str, variation: Column | str, url: Column | str) -> Column:
    """The text that rules look at: name, variation and link, without the brand; empty parts leave no blank."""
    out = text_key(F.concat_ws(" ", *(blank_to_null(c) for c in (name, variation, url))))
    for old, new in REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out

"""Display names, and brands taken from names, as column expressions over arrays of words.

The vocabulary is a parameter. A name's leading run of words is counted as the place of the first word that does not fit,
spellings of a brand are one pattern, made for each row, that takes them off with the words that join them, and shorter
and shorter runs are an array of which the first that leaves enough is taken.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_key

#: Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
#: Words that mark the part of a name after a comma or dash as a claim.
CLAIMS = (
    "non-gmo", "gluten-free", "gluten free", "dairy-free", "pork-free", "no nitrates", "no antibiotics", "fully cooked", "natural ingredients", "for immune", "for stress", "gentle on",
    "energy", "focus", "mental clarity", "support", "clinically tested", "servings", "tablets", "capsules", "raised with",
)
#: Words that join a brand's words, and rests of a name that say nothing.
CONNECTORS = ("&", "and", "of", "by", "the", "foods", "food", "company", "co", "superfood")
EMPTY_RESTS = ("beer", "wine", "coffee", "items", "item", "products", "product", "brands", "brand", "snacks")

#: A word with its marks, a size in brackets at the end, and a rest of a name that is a size.
_WORD = r"^([^A-Za-z0-9]*)([A-Za-z0-9’'&+/-]+)([^A-Za-z0-9]*)$"
_SIZE_IN_BRACKETS = r"(?i)\s*\((?:\d+\s*servings?|pack of \d+|[0-9.]+\s*(?:oz|fl oz|lb|g|kg).*)\)\s*$"
_SIZE_REST = r"^\d+(?: \d+)?\s*(?:oz|fl oz|lb|lbs|count|ct|pack)\b.*$"
#: Words looked at in capitals and with a capital; the least that a rest of a name must say.
MOST_CAPITALS, MOST_CAPITALISED = 6, 5
LEAST_WORDS, LEAST_LENGTH, LEAST_KEY, LEAST_BRAND = 2, 14, 12, 3
_MARKS = r"[ ,.:;()\[\]{}]"
_BETWEEN = "[ ,:\u2013\u2014-]*"


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))


def _pieces(core: Column) -> Column:
    """Parts between apostrophes, slashes and dashes with a capital each; one letter after an apostrophe stays small."""
    cut = F.split(F.lower(core), "(?=[’'/-])|(?<=[’'/-])")
    after = lambda p, i: (i > 0) & F.get(cut, i - 1).isin("’", "'") & (F.length(p) == 1)
    return F.array_join(F.transform(cut, lambda p, i: F.when(after(p, i), p).otherwise(_capital(p))), "")


def title_case(x: Column) -> Column:
    """Words with digits in capitals, capitals of up to four letters as they are, small words small but first."""
    words = F.split(F.trim(x), r"\s+")

    def one(w: Column, i: Column) -> Column:
        part = lambda n: F.regexp_extract(w, _WORD, n)
        core = part(2)
        shown = (
            F.when(core.rlike("[0-9]"), F.upper(core)).when((core == F.upper(core)) & core.rlike("[A-Z]") & (F.length(core) <= 4), core)
            .when(F.lower(core).isin(*SMALL_WORDS) & (i > 0), F.lower(core)).otherwise(_pieces(core))
        )
        return F.when(core == "", w).otherwise(F.concat(part(1), shown, part(3)))

    return F.array_join(F.transform(words, one), " ")


def display_name(x: Column) -> Column:
    """A name without marks, claims after bars, dashes and commas where it is long or they claim, and sizes in brackets."""
    strip = lambda c: F.regexp_replace(c, "^[ ,]+|[ ,]+$", "")
    claims = lambda c: F.lower(c).rlike("|".join(map(re.escape, CLAIMS)))
    c = strip(F.regexp_replace(x, r"\s+", " "))
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=\w)\+(?=\w)", " + "), r"^[®™©\s]+", "")
    c = strip(F.regexp_replace(c, r"\|.*$", ""))
    long_or_claim = (F.length(c) > 55) | claims(c)
    c = strip(F.when(long_or_claim & F.contains(c, F.lit(" – ")), F.regexp_replace(c, " – .*$", "")).when(long_or_claim & F.contains(c, F.lit(" - ")), F.regexp_replace(c, " - .*$", "")).otherwise(c))
    rest = F.regexp_extract(c, "^[^,]*,(.*)$", 1)
    c = F.when((rest != "") & ((F.length(c) > 60) | claims(rest)), F.trim(F.regexp_extract(c, "^([^,]*),", 1))).otherwise(c)
    c = F.regexp_replace(c, _SIZE_IN_BRACKETS, "")
    return title_case(F.regexp_replace(c, "^[ ,;–—-]+|[ ,;–—-]+$", ""))


#: Spellings of a vocabulary that are broadcast, at most; more are joined.
BROADCAST_SPELLINGS = 200_000


def key_of(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


@dataclass(frozen=True)
class Vocabulary:
    """Words that a catalog's brands are judged by. ``families``: a brand's name and its other spellings; of two families with one
    spelling the first counts."""

    generic: frozenset[str] = frozenset()
    descriptors: frozenset[str] = frozenset()
    stops: frozenset[str] = frozenset()
    families: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def spellings(self) -> Column:
        """``struct<key, name, all>`` of every spelling, the longest first; ``all``: those of its family, by length."""
        own = [(key_of(s), name, sorted({name, *every}, key=len, reverse=True)) for name, every in self.families.items() for s in {name, *every} if key_of(s)]
        if not own:
            return F.expr("CAST(array() AS array<struct<key:string,name:string,all:array<string>>>)")
        rows = sorted(own, key=lambda x: (-len(x[0]), x[0]))
        return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.array(*(F.lit(s) for s in every)).alias("all")) for k, n, every in rows))

    def family(self, text: Column, spelt: Column | None = None) -> Column:
        """The family (a spelling's struct) that a text is, or starts with, by the longest spelling. ``spelt``: the spellings that
        can be meant, the longest first; without it all of them are in the expression."""
        key = F.concat(text_key(text), F.lit(" "))
        return F.get(F.filter(self.spellings() if spelt is None else spelt, lambda s: F.startswith(key, F.concat(s["key"], F.lit(" ")))), F.lit(0))

    def with_spellings(self, df, name: str, to: str):
        """``df`` with the spellings that a name starts with, the longest first, as an array ``to``.

        Starts of a name's key are made of its words and meet spellings by equality, once for each distinct key: the plan is the
        same for ten families and for ten thousand, which come as a table.
        """
        own: dict[str, tuple] = {}
        for family, every in self.families.items():
            for s in (family, *every):
                if key_of(s):
                    own.setdefault(key_of(s), (family, sorted({family, *every}, key=len, reverse=True)))
        kind = "array<struct<less: int, key: string, name: string, all: array<string>>>"
        if not own:
            return df.withColumn(to, F.expr(f"CAST(array() AS {kind})"))
        table = df.sparkSession.createDataFrame([(k, *v) for k, v in own.items()], "key string, name string, all array<string>")
        words = F.split("k_", " ")
        most = max(len(k.split()) for k in own)
        starts = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
        keys = df.select(text_key(name).alias("k_")).distinct().select("k_", F.explode(starts).alias("key"))
        met = keys.join(F.broadcast(table) if len(own) <= BROADCAST_SPELLINGS else table, "key")
        found = met.groupBy("k_").agg(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("less"), "key", "name", "all"))).alias(to))  # one for each start of a key
        return df.withColumn("k_", text_key(name)).join(found, "k_", "left").drop("k_").withColumn(to, F.coalesce(to, F.expr(f"CAST(array() AS {kind})")))


def _among(x: Column, values: frozenset[str] | tuple[str, ...]) -> Column:
    return x.isin(*sorted(values)) if values else F.lit(False)


def _leading(words: Column, fits, most: int) -> Column:
    """How many of the first ``most`` words fit, up to the first that does not."""
    bad = F.array_position(F.transform(F.slice(words, 1, most), lambda w: ~fits(w)), F.lit(True))
    return F.when(bad > 0, bad - 1).otherwise(F.least(F.size(words), F.lit(most))).cast("int")


def _joins(word: Column) -> Column:
    return F.lower(word).isin(*CONNECTORS)


def is_generic(text: Column, vocabulary: Vocabulary) -> Column:
    """Whether the words that join nothing are all generic, or all but one of three and more."""
    words = F.filter(F.transform(F.split(text, r"\s+"), lambda w: text_key(w)), lambda k: (k != "") & ~k.isin(*CONNECTORS))
    other = F.size(F.filter(words, lambda k: ~_among(k, vocabulary.generic)))
    return (other == 0) | ((F.size(words) >= 3) & (other <= 1))


def trimmed(words: Column, vocabulary: Vocabulary, spelt: Column | None = None) -> Column:
    """Words up to the first, but the very first, that describes or holds a digit; the family's name if they are of one."""
    ends = F.transform(words, lambda w, i: (i > 0) & (_among(text_key(w), vocabulary.descriptors) | w.rlike("[0-9]")))
    cut = F.array_position(ends, F.lit(True))
    text = F.array_join(F.when(cut > 0, F.slice(words, F.lit(1), (cut - 1).cast("int"))).otherwise(words), " ")
    return F.coalesce(vocabulary.family(text, spelt)["name"], text)


def strip_brand(name: Column, brand: Column, vocabulary: Vocabulary, spelt: Column | None = None) -> Column:
    """A name without the brand before it, in any of its spellings and however often, and without words that join them.

    The whole name stays where what is left is a size, an empty word, or too little to say anything.
    """
    own = F.lit(None) if spelt is None else F.get(F.filter(spelt, lambda s: s["name"] == brand), F.lit(0))["all"]
    every = F.coalesce(own, vocabulary.family(brand, spelt)["all"], F.array().cast("array<string>"))
    spelt = F.array_join(F.transform(F.array_sort(F.array_union(F.array(brand), every), lambda a, b: F.length(b) - F.length(a)), lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "|")
    joining = "|".join(re.escape(c) for c in sorted(CONNECTORS, key=len, reverse=True))
    joined = rf"(?:(?:{joining}){_MARKS}*(?=\s|$){_BETWEEN})*"
    pattern = F.concat(F.lit("(?i)^(?:(?:"), spelt, F.lit(rf")(?![\p{{L}}\p{{N}}]){_BETWEEN}{joined})+"))
    rest = F.regexp_replace(name, pattern, F.lit(""))
    key = text_key(rest)
    little = (F.size(F.split(key, " ")) < LEAST_WORDS) & (F.length(rest) < LEAST_LENGTH)
    keep_name = (rest == "") | key.isin(*EMPTY_RESTS) | key.rlike(_SIZE_REST) | little
    return F.when(keep_name | (brand == ""), name).otherwise(rest)


def with_brand(df, name: str, vocabulary: Vocabulary, brand: str = "brand", rest: str = "name_without_brand"):
    """Adds the brand found in a name, and the name without it; a null or blank name has none.

    A run of capitals at the start is a brand unless it is generic, else a known family is, else the longest run of
    capitalised words that leaves a name of two words or twelve characters, if that is not generic.
    """
    words = F.filter(F.transform(F.split(F.trim(F.coalesce(F.col(name), F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, f"^{_MARKS}+|{_MARKS}+$", "")), lambda w: w != "")
    out = vocabulary.with_spellings(df, name, "s_").withColumn("w_", words)
    spelt = F.col("s_")
    capitals = _leading(F.col("w_"), lambda w: (w.rlike("[A-Z]") & ~w.rlike("[a-z]")) | _joins(w), MOST_CAPITALS)
    named = _leading(F.col("w_"), lambda w: (~_among(F.lower(w), vocabulary.stops) & ~w.rlike("[0-9]") & w.rlike("[A-Z]")) | _joins(w), MOST_CAPITALISED)
    out = out.withColumns({"c_": trimmed(F.slice("w_", F.lit(1), capitals), vocabulary, spelt), "n_": named, "f_": vocabulary.family(F.col(name), spelt)["name"]})
    # runs from the longest to one word, with what each of them leaves
    runs = F.when(F.col("n_") > 0, F.transform(F.sequence(F.col("n_"), F.lit(1)), lambda n: trimmed(F.slice("w_", F.lit(1), n), vocabulary, spelt)))
    out = out.withColumn("r_", F.transform(runs, lambda b: F.struct(b.alias("brand"), strip_brand(F.col(name), b, vocabulary, spelt).alias("rest"))))
    says = lambda r: (r["rest"] != F.col(name)) & ((F.size(F.split(text_key(r["rest"]), " ")) >= LEAST_WORDS) | (F.length(text_key(r["rest"])) > LEAST_KEY))
    out = out.withColumn("r_", F.get(F.filter("r_", says), F.lit(0))["brand"])
    good = ~_among(text_key("r_"), vocabulary.stops) & ~is_generic(F.col("r_"), vocabulary) & (F.length("r_") >= LEAST_BRAND)
    found = F.when((F.col("c_") != "") & ~is_generic(F.col("c_"), vocabulary), F.col("c_")).when(F.col("f_").isNotNull(), F.col("f_")).when(good, F.col("r_"))
    out = out.withColumn(brand, found)
    return out.withColumn(rest, F.when(F.col(brand).isNull(), F.col(name)).otherwise(strip_brand(F.col(name), F.col(brand), vocabulary, spelt))).drop("w_", "c_", "n_", "f_", "r_", "s_")

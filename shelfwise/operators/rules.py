"""Rule tables: scored profiles and first-match cascades, as generated column expressions.

A rule table is a parameter. Each rule is tested once a row inside one projection; nothing is exploded or joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import has_any, has_phrase

#: What a phrase of each kind adds to a category's score.
WEIGHTS = {"strong": 12, "medium": 6, "weak": 2, "exclude": -10}


def profile_score(haystack: Column | str, profile: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(0)
    for kind, weight in WEIGHTS.items():
        for phrase in profile.get(kind, ()):
            out = out + F.when(has_phrase(haystack, phrase), weight).otherwise(0)
    return out


def ranked(scores: Mapping[str, Column]) -> Column:
    """``array<struct<s, name>>``, score descending, then name: ``-s`` sorts first."""
    return F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(name).alias("name")) for name, s in scores.items())))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator of one row: what refers to it several times does not repeat its expression."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_category_details(df: DataFrame, haystack: str, profiles: Mapping[str, Mapping[str, Sequence[str]]], hints: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Adds ``category`` and ``confidence``; every profile is scored once a row."""
    scored = once(df, "order_", ranked({c: profile_score(haystack, p) for c, p in profiles.items()}))
    return once(scored, "details_", category_details(haystack, F.col("order_"), hints)).select("*", "details_.category", "details_.confidence").drop("order_", "details_")


def category_details(haystack: str, order: Column, hints: Sequence[tuple[str, Sequence[str], Sequence[str]]], fallback: str = "Pantry") -> Column:
    """``struct<category, confidence>``: a direct hint (.93), else the best score with a confidence from score and margin.

    ``order``: categories by score, as ``ranked`` gives them.
    """
    best, second = -order[0]["s"], -order[1]["s"]
    confidence = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.3), 0.35 + best / 40.0 + F.greatest(F.lit(0), best - second) / 30.0)), 2)
    made = lambda c, v: F.struct(c.alias("category"), v.alias("confidence"))
    out = F.when(F.col(haystack) == "", made(F.lit(fallback), F.lit(0.2)))
    for category, include, exclude in hints:
        test, bad = F.lit(False), F.lit(False)
        for p in include:
            test = test | has_phrase(haystack, p)
        for p in exclude:
            bad = bad | has_phrase(haystack, p)
        out = out.when(test & ~bad, made(F.lit(category), F.lit(0.93)))
    return out.when(best <= 0, made(F.lit(fallback), F.lit(0.25))).otherwise(made(order[0]["name"], confidence))


def first_rule(text: str, rules: Sequence[tuple[Sequence[str], str, str, float]]) -> Column:
    """``struct<rule, category, subcategory, confidence>`` of the first rule one of whose terms is a substring; null without one."""
    out = None
    for i, (terms, category, subcategory, confidence) in enumerate(rules):
        value = F.struct(F.lit(i).alias("rule"), F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.lit(confidence).alias("confidence"))
        out = F.when(has_any(text, terms), value) if out is None else out.when(has_any(text, terms), value)
    return out


def subcategory_score(haystack: Column | str, phrases: Sequence[str], penalty: tuple[Sequence[str], int] | None = None) -> Column:
    """4 for each phrase of several words, 2 for each word, less a penalty once if any of its phrases is there."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.when(has_phrase(haystack, p), 4 if " " in p.strip() else 2).otherwise(0)
    if penalty:
        bad = F.lit(False)
        for p in penalty[0]:
            bad = bad | has_phrase(haystack, p)
        out = out - F.when(bad, penalty[1]).otherwise(0)
    return out


def best_subcategory(haystack: Column | str, profile: Mapping[str, Sequence[str]], penalties: Mapping[str, tuple[Sequence[str], int]] | None = None) -> Column:
    """The subcategory of the highest score above 0, of equal ones the first by name; null without one."""
    order = ranked({s: subcategory_score(haystack, p, (penalties or {}).get(s)) for s, p in profile.items()})
    return F.when(order[0]["s"] < 0, order[0]["name"])


def guarded(category: Column, text: Column | str, blockers: Sequence[str], terms: Sequence[str], from_source: Column, replacement: str = "Pantry") -> Column:
    """A fresh category stands only where the text names something fresh as a word and no blocker as a substring; a source that
    says fresh gives the category unless a blocker is there."""
    blocked = has_any(text, blockers)
    named = F.lit(False)
    for t in terms:
        named = named | has_phrase(text, t)
    return F.when(F.coalesce(from_source, F.lit(False)) & ~blocked, F.lit("Produce")).when((category == "Produce") & (blocked | ~named), F.lit(replacement)).otherwise(category)

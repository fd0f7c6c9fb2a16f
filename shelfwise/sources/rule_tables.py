"""Rule tables as data: first-match rules and scored profiles, read from any file that Spark reads.

A rule table becomes an expression with a branch for each rule, so its size is bounded, and checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.rules import WEIGHTS

MOST_RULES, MOST_PHRASES = 2_000, 20_000


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()  # of checked size
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no rule table")
    return rows


def first_match_rules(table: DataFrame) -> Sequence[tuple[Sequence[str], str, str, float]]:
    """``ord, terms, category, subcategory, confidence`` as the rules of ``rules.first_rule``, in their order.

    ``terms`` is an array, or a text of terms with bars between them. Rules without a term or a category are left out.
    """
    kind = dict(table.dtypes)["terms"]
    terms = F.split("terms", r"\|") if kind == "string" else F.col("terms")
    low = F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: t.isNotNull() & (F.trim(t) != ""))
    rows = table.select(F.col("ord").cast("long").alias("ord"), low.alias("terms"), "category", "subcategory", F.col("confidence").cast("double").alias("confidence"))
    found = _bounded(rows.filter("size(terms) > 0 AND category IS NOT NULL").orderBy("ord", "category", "subcategory"), MOST_RULES)
    return [(tuple(r["terms"]), r["category"], r["subcategory"], r["confidence"]) for r in found]


def profiles(table: DataFrame) -> Mapping[str, Mapping[str, Sequence[str]]]:
    """``category, kind, phrase`` as the profiles of ``rules.profile_score``; a kind that has no weight is an error."""
    rows = _bounded(table.select("category", F.lower("kind").alias("kind"), "phrase").filter("category IS NOT NULL AND trim(phrase) <> ''").distinct().orderBy("category", "kind", "phrase"), MOST_PHRASES)
    out: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        if r["kind"] not in WEIGHTS:
            raise ValueError(f"unknown kind {r['kind']!r}")
        out.setdefault(r["category"], {}).setdefault(r["kind"], []).append(r["phrase"])
    return out

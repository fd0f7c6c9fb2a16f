"""First-match cascades of many rules: the rules are data, and the plan is the same for ten rules or a thousand.

All terms of a table are found in one pass over a text, by one automaton for each Python worker, which gives the numbers of the
terms that a row holds. Which rule fires is decided from those numbers by array functions: only rules of which some term
was found are looked at, in their order.

A rule is a row: ``ord`` (its place within its block), ``block`` (null: the main cascade), ``calls`` (a block that is run in this
place, else null), ``category, subcategory, confidence, reason``, and ``terms``, an array of ``struct<grp, field, whole, term>``.
A rule fires if each of its groups ``grp >= 0`` has a term in its field, and none of its terms of ``grp < 0``, exclusions, is
there. ``whole`` asks for whole words. A rule without groups fires unless it is excluded.

A rule whose outcome is no pair of the taxonomy ends its block without one: the rows go on behind the place that called
the block, or get none if that was the main cascade. A called block needs the groups and exclusions of its place as well.
"""

from __future__ import annotations

from array import array
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules and terms that are taken for a rule table, at most; more are an error.
MOST_RULES, MOST_TERMS = 20_000, 200_000
SCHEMA = "ord long, block string, calls string, category string, subcategory string, confidence double, reason string, terms array<struct<grp: int, field: string, whole: boolean, term: string>>"
_RULE = "struct<groups: array<array<int>>, none: array<int>, valid: boolean, after: int, block: string, ord: bigint, category: string, subcategory: string, confidence: double, reason: string>"


@dataclass
class RuleSet:
    """A table's rules in the order in which they are tried, and its terms: ``(field, whole, term)`` by number."""

    rules: list[dict] = field(default_factory=list)
    terms: dict[tuple[str, bool, str], int] = field(default_factory=dict)

    def number(self, t) -> int:
        return self.terms.setdefault((t["field"], bool(t["whole"]), t["term"]), len(self.terms))


def read_rules(table: DataFrame, pairs: DataFrame | None = None) -> RuleSet:
    """Rules of a table (``SCHEMA``), checked; ``pairs`` (``category, subcategory``) says which outcomes exist, without it all do.

    Terms that are null or empty are left out. Rules of one ``ord`` in a block, calls of unknown blocks, blocks that call
    themselves, and tables of more than ``MOST_RULES`` rules or ``MOST_TERMS`` terms are errors.
    """
    rows = [r.asDict(recursive=True) for r in table.select(*(x.split()[0] for x in SCHEMA.split(", terms")[0].split(", ")), "terms").limit(MOST_RULES + 1).collect()]  # of checked size
    if len(rows) > MOST_RULES or sum(len(r["terms"] or ()) for r in rows) > MOST_TERMS:
        raise ValueError("too large for a rule table")
    valid = None
    if pairs is not None:
        known = pairs.select("category", "subcategory").distinct().limit(MOST_RULES + 1).collect()  # of checked size
        valid = {(r["category"], r["subcategory"]) for r in known}
    return ordered_rules(rows, valid)


def ordered_rules(rows: Sequence[Mapping], valid: set | None = None) -> RuleSet:
    blocks: dict[str | None, list[Mapping]] = {None: []}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r)
    for name, block in blocks.items():
        block.sort(key=lambda r: r["ord"])
        if len({r["ord"] for r in block}) < len(block):
            raise ValueError(f"two rules in one place of block {name!r}")
    out = RuleSet()

    def add(block: str | None, groups: list, none: list, above: tuple) -> None:
        if block in above:
            raise ValueError(f"block {block!r} calls itself")
        mine = []
        for r in blocks[block]:
            own: dict[int, list[int]] = {}
            for t in r["terms"] or ():
                if t["term"]:
                    own.setdefault(max(t["grp"], -1), []).append(out.number(t))
            has_groups = {t["grp"] for t in r["terms"] or () if t["grp"] >= 0}
            all_groups = groups + [own.get(g, []) for g in sorted(has_groups)]
            all_none = none + own.get(-1, [])
            if r.get("calls") is not None:
                if r["calls"] not in blocks:
                    raise ValueError(f"no block {r['calls']!r}")
                add(r["calls"], all_groups, all_none, (*above, block))
                continue
            mine.append(rule := {k: r[k] for k in ("block", "ord", "category", "subcategory", "confidence", "reason")})
            rule |= {"groups": all_groups, "none": all_none, "valid": valid is None or (r["category"], r["subcategory"]) in valid}
            out.rules.append(rule)
        for rule in mine:
            rule["after"] = len(out.rules)

    add(None, [], [], ())
    return out


def _finder(terms: Mapping[tuple[bool, str], int]):
    """Numbers of the terms in each text of a batch: one pass over the text, whatever the number of terms. Texts are taken out of the
    batch one by one, and numbers put into arrays, so a worker holds no more than the batch, one text and the numbers."""
    made: list = []

    def numbers(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            found: dict[str, list[tuple[bool, int, int]]] = {}
            for (whole, term), i in terms.items():
                found.setdefault(term, []).append((whole, i, len(term)))
            automaton = ahocorasick.Automaton()
            for term, kinds in found.items():
                automaton.add_word(term, kinds)
            automaton.make_automaton()
            made.append(automaton)
        word = lambda text, at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

        def of(text: str | None) -> list[int]:
            out = set()
            for end, kinds in made[0].iter(text) if text else ():
                for whole, i, n in kinds:
                    start = end - n + 1
                    if not whole or (word(text, start - 1) != word(text, start) and word(text, end) != word(text, end + 1)):
                        out.add(i)
            return sorted(out)

        found_, ends = array("i"), array("i", [0])
        for text in texts:
            found_.extend(of(text.as_py()))
            ends.append(len(found_))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found_, pa.int32()))

    return numbers


def _terms_in(rules: RuleSet, fields: Mapping[str, Column | str]) -> Column:
    """``array<int>``: the numbers of the terms that the row's fields hold."""
    unknown = {f for f, _, _ in rules.terms} - set(fields)
    if unknown:
        raise ValueError(f"rules look at unknown fields {sorted(unknown)}")
    parts = []
    for name, value in fields.items():
        own = {(whole, term): i for (f, whole, term), i in rules.terms.items() if f == name}
        if own:
            parts.append(F.arrow_udf(_finder(own), "array<int>")(value))
    return F.concat(*parts) if parts else F.array().cast("array<int>")


def with_rule(df: DataFrame, rules: RuleSet, fields: Mapping[str, Column | str], name: str = "rule") -> DataFrame:
    """Adds ``struct<block, ord, category, subcategory, confidence, reason>`` of the rule that decides each row, null without one.

    Texts are compared as they are: give them in lower case if the terms are. A null text holds no term. The rules come as one
    row beside the data; their number is bounded by ``read_rules``. ``df`` may have columns of any names but ``name``.
    """
    spark = df.sparkSession
    first: list[list[int]] = [[] for _ in rules.terms]
    always = []
    for i, r in enumerate(rules.rules):
        if r["groups"]:
            for t in set(min(r["groups"], key=len)):
                first[t].append(i)
        else:
            always.append(i)
    made = [{k: r[k] for k in ("groups", "none", "valid", "after", "block", "ord", "category", "subcategory", "confidence", "reason")} for r in rules.rules]
    one = spark.createDataFrame([(made, first, always)], f"rules_ array<{_RULE}>, of_term_ array<array<int>>, always_ array<int>")
    held = df.select(F.struct("*").alias("own_"), _terms_in(rules, fields).alias("held_")).crossJoin(F.broadcast(one))  # one row
    some = "array_sort(array_distinct(concat(always_, flatten(transform(held_, t -> of_term_[t])))))"
    fires = "forall(rules_[i].groups, g -> arrays_overlap(g, held_)) AND NOT arrays_overlap(rules_[i].none, held_)"
    # from one firing rule to the next: the first valid one decides, an invalid one skips the rest of its block
    step = "CASE WHEN s.at >= 0 OR i < s.start THEN s WHEN rules_[i].valid THEN named_struct('at', i, 'start', i) ELSE named_struct('at', -1, 'start', rules_[i].after) END"
    at = F.expr(f"aggregate(filter({some}, i -> {fires}), named_struct('at', -1, 'start', 0), (s, i) -> {step}).at")
    decided = held.withColumn("at_", at)
    rule = F.when(F.col("at_") >= 0, F.expr("rules_[at_]"))
    outcome = F.struct(*(rule[k].alias(k) for k in ("block", "ord", "category", "subcategory", "confidence", "reason")))
    return decided.select("own_.*", F.when(F.col("at_") >= 0, outcome).alias(name))

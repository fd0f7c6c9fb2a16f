"""Cascades by hand and against a plain loop: order, exclusion, groups, whole words, called blocks, outcomes that do not exist."""

import random
import re

import pytest

from shelfwise.operators import rule_table as rt


def rule(ord, block, category, *terms, calls=None, **more):
    """Terms as ``group:text``, ``group:=whole word`` or ``group@field:text``."""
    made = []
    for t in terms:
        head, _, term = t.partition(":")
        grp, _, field = head.partition("@")
        made.append({"grp": int(grp), "field": field or "text", "whole": term.startswith("="), "term": term.removeprefix("=")})
    return {"ord": ord, "block": block, "calls": calls, "category": category, "subcategory": more.get("sub", "s"), "confidence": more.get("confidence", 0.99), "reason": f"{block or 'main'} {ord}", "terms": made}


def plain(rows, fields, valid=None, block=None):
    """The deciding rule's reason: rules of a block in their order, one after another."""

    def has(t):
        text = fields.get(t["field"]) or ""
        return bool(t["term"]) and (re.search(rf"\b{re.escape(t['term'])}\b", text) is not None if t["whole"] else t["term"] in text)

    for r in sorted((r for r in rows if r["block"] == block), key=lambda r: r["ord"]):
        groups = {}
        for t in r["terms"]:
            groups.setdefault(max(t["grp"], -1), []).append(has(t))
        if any(groups.pop(-1, [])) or not all(any(g) for g in groups.values()):
            continue
        if r["calls"] is not None:
            if found := plain(rows, fields, valid, r["calls"]):
                return found
            continue
        return r["reason"] if valid is None or (r["category"], r["subcategory"]) in valid else None
    return None


FOOD = [
    rule(10, None, "Produce", "0@source:fresh produce", "-1:juice", "-1:chips", sub="Fruits"),
    rule(20, None, "Beauty", "0:shampoo", "0:leave-in"), rule(21, None, "Beauty", "0:=curl", "0:=curls", "1:cream", "1:hair"),
    rule(30, None, "Household", "0:incense", "-1:spray", "-1:oil"),
    rule(40, None, "x", calls="packaged"),
    rule(50, None, "Alcohol", "0:=wine", "0:=beer", "0:=gin", calls="alcohol"),
    rule(60, None, "Beverages", "0:water"), rule(70, None, "Nowhere", "0:=rice"), rule(80, None, "Pantry", "0:rice", sub="Rice & Grains"),
    rule(1, "packaged", "Beverages", "0:green tea", "-1:iced tea", sub="Tea"), rule(2, "packaged", "Nowhere", "0:granola"), rule(3, "packaged", "Snacks", "0:chips"), rule(4, "packaged", "Beverages", "0:juice"),
    rule(1, "alcohol", "Alcohol", "0:non-alcoholic"), rule(2, "alcohol", "Alcohol", "0:=wine", sub="Wine"), rule(3, "alcohol", "Alcohol"),
]
VALID = {(r["category"], r["subcategory"]) for r in FOOD} - {("Nowhere", "s")}
CASES = [
    ("shampoo with tea", "", "main 20"), ("curls cream", "", "main 21"), ("curly cream", "", None), ("curl alone", "", None), ("incense sticks", "", "main 30"), ("incense oil", "", None),
    ("green tea", "", "packaged 1"), ("green tea iced tea", "", None), ("peach", "Fresh produce".lower(), "main 10"), ("peach juice", "fresh produce", "packaged 4"),
    ("granola", "", None), ("granola chips", "", None), ("granola rice", "", None), ("granola in water", "", "main 60"),  # an invalid outcome ends the block, the cascade goes on behind it
    ("rice", "", None), ("riced cauliflower", "", "main 80"), ("rice water", "", "main 60"),
    ("non-alcoholic beer", "", "alcohol 1"), ("red wine", "", "alcohol 2"), ("ginger beer", "", "alcohol 3"), ("ginger water", "", "main 60"), ("swine", "", None), ("wine chips", "", "packaged 3"), ("", "", None), (None, None, None),
]


def decided(spark, rows, cases, valid=None, **options):
    rules = rt.ordered_rules([dict(r) for r in rows], valid)
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], "i int, text string, rule_ string")
    got = rt.with_rule(df, rules, {"text": "text", "source": "rule_"}, "found").collect()
    return [r.found.reason if r.found else None for r in sorted(got)]


def test_by_hand(spark):
    cases = [(t, s) for t, s, _ in CASES]
    assert decided(spark, FOOD, cases, VALID) == [want for *_, want in CASES]
    assert [plain(FOOD, {"text": t, "source": s}, VALID) for t, s in cases] == [want for *_, want in CASES]


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "abc", "b", "c d", "cd", "e", "de", "bcd", "é", "x-y", "x"]
    rows = []
    for block in [None, "p", "q"]:
        for ord in range(70):
            terms = [f"{rng.choice([0, 0, 1, 2, -1])}:{'=' * rng.randrange(2)}{rng.choice(words)}" for _ in range(rng.randrange(5))] or ["0:zz"]
            rows.append(rule(ord, block, rng.choice("ABC"), *terms))
    rows += [rule(1000, None, "x", calls="q"), rule(-5, None, "x", "0:=ab", "-1:e", calls="p"), rule(535, "p", "x", calls="q")]
    cases = [("".join(rng.choice(["ab", "c", "d", " ", " ", "e", "é", "-", "x", "y", "_"]) for _ in range(rng.randrange(12))), None) for _ in range(400)]
    valid = {("A", "s"), ("B", "s")}
    assert decided(spark, rows, cases, valid) == [plain(rows, {"text": t}, valid) for t, _ in cases]


def test_plan_does_not_grow(spark):
    """A thousand rules have the plan of ten."""
    df = spark.createDataFrame([("a",)], "text string")
    size = lambda n: len(rt.with_rule(df, rt.ordered_rules([rule(i, None, "A", f"0:word{i}") for i in range(n)]), {"text": "text"})._jdf.queryExecution().optimizedPlan().toString())
    assert size(1000) < 1.5 * size(10)
    assert decided(spark, [rule(i, None, "A", f"0:=word{i}") for i in range(1000)], [("word999 word77", None)]) == ["main 77"]


def test_tables_that_are_errors(spark):
    for rows in ([rule(1, None, "A", "0:a"), rule(1, None, "B", "0:b")], [rule(1, None, "A", calls="none")], [rule(1, None, "A", calls="p"), rule(1, "p", "A", calls="p")]):
        with pytest.raises(ValueError):
            rt.ordered_rules(rows)
    with pytest.raises(ValueError):
        decided(spark, [rule(1, None, "A", "0@other:a")], [("a", "b")])


def test_read_rules(spark):
    """From a table, with terms that are null or empty, and pairs of the taxonomy as rows."""
    rows = [(2, None, None, "A", "s", 0.9, "second", [(0, "text", False, "a")]), (1, None, None, "B", "s", 0.9, "first", [(0, "text", False, "b"), (0, "text", False, None), (0, "text", True, "")]), (3, None, None, "A", "t", 0.9, "none", None)]
    found = rt.read_rules(spark.createDataFrame(rows, rt.SCHEMA), spark.createDataFrame([("A", "s"), ("B", "s")], "category string, subcategory string"))
    assert [r["reason"] for r in found.rules] == ["first", "second", "none"] and [r["valid"] for r in found.rules] == [True, True, False]
    assert len(found.terms) == 2
    empty = rt.read_rules(spark.createDataFrame([], rt.SCHEMA))
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.rule for r in rt.with_rule(df, empty, {"text": "text"}).collect()] == [None, None]


def test_a_batch_is_not_held_twice():
    """Numbers of terms come from an Arrow batch as an Arrow array: no series of texts or of lists is made."""
    import pyarrow as pa

    got = rt._finder({(False, "ab"): 0, (True, "cd"): 1})(pa.array(["ab cd", None, "", "cde", "ab"]))
    assert got.type == pa.list_(pa.int32()) and got.to_pylist() == [[0, 1], [], [], [], [0]]

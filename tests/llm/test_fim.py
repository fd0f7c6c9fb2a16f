"""Samples against plain Python, texts that hold delimiters and marks, and the rows that the docstring speaks of."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import fim
from tests.oracle import compare


def plain(doc_id, text, seed=7, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+", marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


TEXTS = [
    None, "", "one line", "one\n", "\n", "\n\n\n", "a\nb\nc", "a\r\nb c\x85\nd", "é\n𝄞𝄞\n", "\x1e\n\x1b\nx\x1bs\x1bm\x1e\x1e\n$0 \\1 $\n", "<P> is a mark\nb\n", "has <M>\n", "<\nS>\n<P\n<", "> P>\n<S\n",
    "x" * 300_000, "line of text\n" * 30_000, " \t\n ", "\0\n\0", "a\n" * 3 + "b",
]


def rows_of(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a repeated id\n2\n3\n4"), (None, "no id\nat all\n")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "n", "form", "marked", "digest", "lo", "hi", "prefix", "output")})


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 0}, {"spm": 100}, {"unit": r"[^ ]* |[^ ]+"}, {"marks": ("[P]", "{S}", "(M)")}])
def test_samples(spark, options):
    rows, df = rows_of(spark, TEXTS)
    got = fim.fill_in_middle(df, **options).withColumn("back", fim.restored(F.col("output"), F.col("form"), options.get("marks", fim.MARKS))).collect()
    want = sorted(((i, *plain(i, t, **options), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_many_ids_reach_every_form(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\n").alias("text"))
    got = fim.fill_in_middle(df, rate=80).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain(i, "a\nb\nc\nd\n", rate=80)) for i in range(400))
    assert {r.form for r in got} == {"plain", "psm", "spm"} and {r.prefix_chars for r in got} == {None, 0, 2, 4, 6, 8}


def test_marks_that_cannot_be_told_apart(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("<P", "x<", "m")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)


def test_empty(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_and_no_shuffle(spark):
    df = fim.op12_fill_in_middle(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    assert compare(spark, fim.op12_fill_in_middle, fim.OP12_SQL, f"/root/testdata/{sf}") >= 200

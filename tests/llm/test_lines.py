import random

import pytest

from shelfwise.llm import lines
from shelfwise.working import new_path
from tests.oracle import compare

BLANK = " \t\n\x0b\x0c\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == (b[:i] + b[i + 1 :] if len(a) == len(b) else b) for i in range(len(a))) or a == b


def brute(rows, min_chars=12):
    """Texts of one document for each (doc_id, text); a version that is not the documents' own order would need the hash."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for d in docs:
        for pos, line in enumerate(d[1].split("\n")):
            if line.strip(BLANK):
                seen.setdefault(line, (len(seen), d, pos))
    long_lines = [x for x in seen if len(x) >= min_chars]
    gone = {x for x in long_lines for y in long_lines if seen[y][0] < seen[x][0] and within_one(x, y)}
    for d in docs:
        ls = d[1].split("\n")
        out[d] = "\n".join(x for p, x in enumerate(ls) if not x.strip(BLANK) or (x not in gone and seen[x][1:] == (d, p)))
    return sorted(((i, None if t is None else out[(i, t)]) for i, t in rows), key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS pos", "2 AS version", "3 AS h")
    return sorted(map(tuple, lines.dedup_lines(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ") for _ in range(r.choice([11, 12, 13, 14, 20, 37, 64]))) for _ in range(14)]

    def edited():
        s = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i = r.randrange(len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abé ") + s[i:], s[:i] + r.choice("abé") + s[i + 1 :]])
        return s

    rows = [(i, "\n".join(edited() for _ in range(r.randint(1, 6)))) for i in range(50)]
    assert result(spark, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    rows = [(1, "same line of text\n\n  \nx\nx"), (2, None), (3, ""), (4, "same line of text"), (5, "same line of texts\r"), (6, "same line of texts"), (7, "x"), (7, "x"), (None, "no id line here"), (8, "no id line here\n"), (9, "k" * 20000), (10, "k" * 19999 + "j"), (11, "z" * 3000 + "\n" + "z" * 3001)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_query(spark):
    assert compare(spark, lines.op3_line_dedup, lines.OP3_SQL, "/root/testdata/sf0.01") == 1000


@pytest.mark.parametrize("fine", [1, 3])
def test_long_lines(spark, monkeypatch, fine):
    """Pieces are cut again and again; a line of a million characters takes no square of its length."""
    monkeypatch.setattr(lines, "FINE", fine)
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = [(0, base)] + [(i + 1, base[:p] + c + base[p + n :]) for i, (p, c, n) in enumerate([(0, "", 1), (699, "", 1), (350, "x", 1), (87, "y", 0), (700, "z", 0), (88, "", 2), (10, "qq", 0)])]
    assert result(spark, rows) == brute(rows)


def test_very_long_line(spark):
    line = "0123456789 abcdef" * 120_000
    rows = [(1, line), (2, line[:1_000_000] + "x" + line[1_000_001:]), (3, line + "y"), (4, line[:-2]), (5, "x" * 2_040_000)]
    got = {i: t for i, t in result(spark, rows)}
    assert [got[i] == "" for i in range(1, 6)] == [False, True, True, False, False]


def test_nulls_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([(1, None), (2, "a\nb"), (3, "")], "doc_id long, text string")
        df.write.mode("overwrite").parquet(path := new_path(spark, "test") + "/documents.parquet")
        got = lines.op3_line_dedup(spark, path.removesuffix("/documents.parquet"))
        assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "dropped").collect())) == [(1, 0, 0, ""), (2, 2, 0, ""), (3, 1, 0, "")]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")

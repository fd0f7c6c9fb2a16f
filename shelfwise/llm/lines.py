"""Line dedup by a deletion-neighbourhood join, in DataFrame and SQL functions only.

Two lines are within one edit (a character put in, taken out or changed) if and only if deleting one character of the
longer, or of both if they are equally long, gives the same string. Emitting every such variant of every line would
square the cost of long lines, so neighbourhoods go from coarse to fine: a variant that leaves out a half, then an
eighth, then an eighth of that, is shared by all pairs whose edit lies in it, and only lines that share one emit the next
finer ones, until a piece has ``FINE`` characters at most; pieces are counted from both ends, for the line's own length and
for one more, so that no pair within the bound is lost. The finest variants leave out one character. A line of L characters
so emits about 16 log L variants and ``FINE`` finest ones for each piece that it shares. Lines that share a variant at one place are within one edit of each other, all of them,
so the earliest of them is found by a minimum per variant and no pairs within a group are made. The pair that is left
is compared character by character, but for the place that the variant leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keep

#: Lines that are broadcast to pick their texts, at most; more are joined.
BROADCAST_ROWS = 500_000
#: Characters of a piece in which single ones are left out, at most; longer pieces are cut again.
FINE = 64
_CUT = "CAST({t} * M DIV {q} AS int)"


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that are not blank with their document, place, and two hashes of the line, ``a`` and ``b``."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.filter(r"line RLIKE '[^\\x20\\x09-\\x0D]'").withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(7), "line"))


def _coarse(rows: DataFrame, pieces: int) -> DataFrame:
    """Keys of each line without one of ``pieces`` parts, as a line of its own length ``M`` and as one shorter than ``M``."""
    longer = rows.withColumn("M", F.explode(F.array(F.length("line"), F.length("line") + 1)))
    numbered = longer.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    cut = numbered.withColumn("lo", F.expr(_CUT.format(t="t", q=pieces))).withColumn("hi", F.expr(_CUT.format(t="(t + 1)", q=pieces)))
    return cut.withColumn("key", F.expr("xxhash64(t, M, left(line, lo), right(line, M - hi))"))


def _finer(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys of lines without one of the eight parts of each piece that they share."""
    cut = hits.join(texts.select("a", "b", "line"), ["a", "b"]).withColumnsRenamed({"lo": "from", "hi": "to"}).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cut = cut.withColumn("lo", F.expr("`from` + CAST(t * (to - `from`) DIV 8 AS int)")).withColumn("hi", F.expr("`from` + CAST((t + 1) * (to - `from`) DIV 8 AS int)"))
    return cut.selectExpr("a", "b", "xxhash64(lo, hi, M, left(line, lo), right(line, M - hi)) AS key", "M", "lo", "hi")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that two different lines have: minima and maxima of numbers, summed in each task before the shuffle."""
    sides = keys.groupBy("key").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    return sides.filter("a0 <> a1 OR b0 <> b1").select("key")


def _close_pairs(texts: DataFrame) -> DataFrame:
    """``h, witness`` of lines ``a, b, line, first``: earlier lines within one edit, the earliest for each variant."""
    pieces = _coarse(texts, 8).select("a", "b", "key", "M", "t", "lo", "hi")
    hits = keep(pieces.join(_shared(pieces), "key").drop("key", "t"), "line-pieces")
    fine, wide = hits.filter(f"hi - lo <= {FINE}"), hits.filter(f"hi - lo > {FINE}")
    while not wide.isEmpty():  # a round cuts the longest piece by eight
        finer = keep(_finer(wide, texts), "line-finer")
        hits = keep(finer.join(_shared(finer), "key").drop("key"), "line-pieces")
        fine, wide = fine.unionByName(hits.filter(f"hi - lo <= {FINE}")), hits.filter(f"hi - lo > {FINE}")
    hits = fine
    wide = hits.join(texts, ["a", "b"]).withColumn("st", F.struct("first", F.struct("a", "b").alias("h")))
    places = F.explode(F.expr("sequence(lo, hi - 1)"))
    whole = wide.filter("length(line) = M").withColumn("i", places)
    longer = keep(whole.selectExpr("xxhash64(left(line, i), right(line, M - i - 1)) AS v", "M", "i", "st"), "line-variants")
    lesser = wide.filter("length(line) = M - 1").withColumn("i", places)
    shorter = keep(lesser.selectExpr("xxhash64(left(line, i), right(line, M - i - 1)) AS v", "M", "i", "st"), "line-whole")
    at = ["v", "M", "i"]
    first_longer, first_shorter = (x.groupBy(*at).agg(F.min("st").alias("w")) for x in (longer, shorter))
    sides = [longer.join(first_longer, at), longer.join(first_shorter, at), shorter.join(first_longer, at)]
    told = sides[0].unionByName(sides[1]).unionByName(sides[2]).filter("w.first < st.first AND w.h <> st.h")
    pairs = told.groupBy(F.col("st.h").alias("h"), F.col("w.h").alias("witness")).agg(F.min(F.struct("M", "i")).alias("at"))
    known = texts.select(F.struct("a", "b").alias("h"), "line")
    both = pairs.join(known, "h").join(known.selectExpr("h AS witness", "line AS other"), "witness")
    # without the character at one place, where there is one, both are the same string: linear, whatever their length
    same = "left(line, at.i) = left(other, at.i) AND right(line, at.M - at.i - 1) = right(other, at.M - at.i - 1)"
    return both.filter(same).select("h.a", "h.b")


def dropped_lines(docs: DataFrame, *, min_chars: int = 12) -> DataFrame:
    """``doc_id, version, pos`` of every line that goes. ``version`` is a hash of the document's text, ``pos`` counts from 0.

    Lines are in the order of ``doc_id`` (no id first), version and place. A line goes if an equal one, or one within one
    edit, came before it first, whether or not that one goes too; lines of under ``min_chars`` characters need an equal
    one. Blank lines stay. Rows that repeat an id and its text count as one document. A null text has no lines, an empty
    one a blank line; an empty table gives no rows; further columns are not looked at.
    """
    lines = keep(_lines(docs).select("doc_id", "version", "pos", "a", "b"), "line-places")
    first = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "version", "pos")).alias("first"), F.count("*").alias("n"))
    first = keep(first, "line-firsts")
    long_lines = _lines(docs).filter(F.length("line") >= min_chars).select("a", "b", "line")
    halves = keep(_coarse(long_lines, 2).select("a", "b", "key"), "line-halves")
    some = keep(halves.join(keep(_shared(halves), "line-shared"), "key").select("a", "b").distinct(), "line-some")
    picked = long_lines.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, ["a", "b"], "left_semi")
    texts = keep(picked.groupBy("a", "b").agg(F.min("line").alias("line")).join(first.select("a", "b", "first"), ["a", "b"]), "line-texts")
    near = _close_pairs(texts).distinct().withColumn("near", F.lit(True))
    told = first.join(near, ["a", "b"], "left").filter("near OR n > 1").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = lines.join(keep(told, "line-told"), ["a", "b"])
    return found.filter("near OR first < struct(doc_id, version, pos)").select("doc_id", "version", "pos").distinct()


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` without the lines that go; documents that lose nothing are as they were.

    A null text stays null and an empty one empty; lines without a character beyond white space stay. Rows that repeat an id are
    documents each; rows that repeat id and text are one document, and lose the same lines. Lines of any length take part
    whole. Lines of fewer than ``min_chars`` characters go only where they are equal to an earlier one: one edit makes another
    word of them. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
    """
    gone = keep(dropped_lines(docs, **options).groupBy("doc_id", "version").agg(F.collect_list("pos").alias("gone")), "line-gone")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    both = own.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.version = g.version"), "left")
    rest = "transform(array_except(sequence(0, size(split(text, '\\n', -1)) - 1), gone), i -> element_at(split(text, '\\n', -1), i + 1))"
    return both.selectExpr("d.doc_id", f"CASE WHEN gone IS NULL THEN text ELSE array_join({rest}, '\\n') END AS text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped``: the numbers of the lines that go, comma-joined, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = dropped_lines(docs).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    own = docs.select("doc_id", F.xxhash64("text").alias("version"), F.expr("CAST(IF(text IS NULL, 0, size(split(text, '\\n', -1))) AS LONG)").alias("n_lines"))
    both = own.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.version = g.version"), "left")
    return both.selectExpr("d.doc_id", "n_lines", "CAST(IF(gone IS NULL, 0, size(gone)) AS LONG) AS n_dropped", "coalesce(array_join(gone, ','), '') AS dropped")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, min(doc_id * 1000000 + pos) AS first FROM full_lines GROUP BY line),
long_lines AS (SELECT *, length(line) AS n FROM firsts WHERE length(line) >= 12),
keyed AS (
  SELECT line, first, n, m, 0 AS side, left(line, m // 2) AS part FROM (SELECT *, n AS m FROM long_lines UNION ALL SELECT *, n + 1 AS m FROM long_lines)
  UNION ALL
  SELECT line, first, n, m, 1 AS side, right(line, m - m // 2) AS part FROM (SELECT *, n AS m FROM long_lines UNION ALL SELECT *, n + 1 AS m FROM long_lines)),
pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, a.first AS fa, b.first AS fb FROM keyed a JOIN keyed b
  ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.n >= b.n AND a.line <> b.line AND a.n = a.m),
close AS (
  SELECT DISTINCT a, b, fa, fb FROM pairs, unnest(range(1, na + 1)) AS u(i)
  WHERE left(a, i - 1) = left(b, i - 1) AND right(a, na - i) = right(b, na - i) AND nb >= na - 1),
gone AS (SELECT a AS line FROM close WHERE fb < fa UNION SELECT b FROM close WHERE fa < fb),
drops AS (
  SELECT l.doc_id, l.pos FROM full_lines l JOIN firsts f ON l.line = f.line LEFT JOIN gone g ON g.line = l.line
  WHERE g.line IS NOT NULL OR f.first < l.doc_id * 1000000 + l.pos),
by_doc AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS dropped FROM drops GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped
FROM documents d LEFT JOIN by_doc b USING (doc_id)
"""

r"""Fill-in-the-middle samples, by escaped marker injection; SQL functions only.

A delimiter is escaped in the text and then put after every unit by one regular expression. Its count is the number of
units, and ``substring_index`` takes the units up to a rank, or from one, without a list of them. The parts lose their
delimiters, are unescaped, and are put in the order of the sample's form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import column

#: Lines, each with its end.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
#: The delimiter, the sign that escapes, and what stands after it for the sign and for the delimiter.
_MARK, _SIGN, _OF_SIGN, _OF_MARK = "\x1e", "\x1b", "s", "m"


def escaped(text: Column) -> Column:
    """The text without the delimiter."""
    return F.replace(F.replace(text, F.lit(_SIGN), F.lit(_SIGN + _OF_SIGN)), F.lit(_MARK), F.lit(_SIGN + _OF_MARK))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_SIGN + _OF_MARK), F.lit(_MARK)), F.lit(_SIGN + _OF_SIGN), F.lit(_SIGN))


def _ranked(marked: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Units lo (exclusive) to hi of the n of a marked text. ``substring_index`` gives nothing for rank 0 and all for -(n + 1)."""
    ending = F.call_function("substring_index", marked, F.lit(_MARK), -(n - lo + 1).cast("int"))
    return unescaped(F.replace(F.call_function("substring_index", ending, F.lit(_MARK), (hi - lo).cast("int")), F.lit(_MARK), F.lit("")))


def _number(digest: Column, place: int) -> Column:
    """The place-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, marks: tuple[str, str, str] = MARKS, id_column: str = "doc_id"
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every whole text, beside nothing else of ``docs``.

    ``unit`` is a regular expression of Java whose matches, left to right, make up the text without gaps. Of every hundred
    samples, ``rate`` are rearranged, and ``spm`` of a hundred of these put the suffix first; the choices come from the
    SHA-256 of ``seed:id``, so that reruns agree and rows that repeat an id are cut by the same numbers. A text that is null
    is empty; an empty text, and one that holds any of the marks, is ``plain``: it is the output, its part lengths are null.
    Marks differ, and none has any mark's first character after its own, so that parts and marks cannot make up another mark.
    A null id counts as an empty one. Delimiter and sign may be in texts. Very long texts are one row like others: every step
    is linear in them. An empty table gives none. Other columns are not read, whatever their names.
    """
    if len(set(marks)) < 3 or not all(marks) or any(m[0] in other[1:] for m in marks for other in marks):
        raise ValueError(f"marks that cannot be told apart: {marks}")
    pre, suf, mid = (F.lit(m) for m in marks)
    text = F.coalesce(column("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_column).cast("string"), F.lit(""))), 256)
    rows = docs.select(column(id_column).alias("id"), text.alias("text"), digest.alias("digest"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), F.lit(f"(?:{unit})"), F.lit("$0" + _MARK)))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(_MARK), F.lit("")))).cast("long"))
    first, second = (_number(F.col("digest"), i) % (F.col("n") + 1) for i in (1, 2))
    held = F.greatest(*(F.instr("text", m) for m in marks)) > 0
    form = F.when((F.col("text") == "") | held | (_number(F.col("digest"), 3) % 100 >= rate), "plain").when(_number(F.col("digest"), 4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"lo": F.least(first, second), "hi": F.greatest(first, second), "form": form})
    cut = F.col("form") != "plain"
    parts = {"prefix": (F.lit(0), F.col("lo")), "middle": (F.col("lo"), F.col("hi")), "suffix": (F.col("hi"), F.col("n"))}
    rows = rows.withColumns({name: F.when(cut, _ranked(F.col("marked"), F.col("n"), lo, hi)) for name, (lo, hi) in parts.items()})
    psm = F.concat(pre, "prefix", suf, "suffix", mid, "middle")
    spm_ = F.concat(suf, "suffix", pre, "prefix", mid, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return rows.select("id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. In a rearranged output each mark stands once, as its text held none."""
    pre, suf, mid = marks
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    prefix = F.when(form == "psm", before(after(output, pre), suf)).otherwise(before(after(output, pre), mid))
    suffix = F.when(form == "psm", before(after(output, suf), mid)).otherwise(before(after(output, suf), pre))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(output, mid), suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the samples of all ``documents`` and of the texts rebuilt from them."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256(concat('7:', doc_id)) AS h FROM documents),
numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(units[greatest(a, b) + 1:], '') AS suf
  FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

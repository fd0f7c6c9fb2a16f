"""Large JSON arrays, read by many tasks: records are put together from lines, wherever a file is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, record``: the text of every object in the arrays below ``path``, numbered from 1 in its file.

    Arrays have each object begin on a line of its own, indented or not, as writers with an indent or one object a line put
    them: a text in JSON has no line ends, so the lines that begin with the least indented brace begin objects. Lines are
    read in splits; the number of objects that begin before a split is a running sum over one row a split, so an object
    that two splits share is whole. An array on a single line is one split by nature, and parsed as a whole.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("split"))
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"^\s+", "")
    indent, opens = F.length("value") - F.length(body), F.startswith(body, F.lit("{"))
    least = lines.filter(opens).groupBy("file").agg(F.min(indent).alias("least"))  # one row a file
    marked = lines.join(least, "file").withColumn("begins", (opens & (indent == F.col("least"))).cast("int"))
    counts = marked.groupBy("file", "split").agg(F.sum("begins").alias("n"))
    before = counts.select("file", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("begins").over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("inside", inside).join(before, ["file", "split"]).withColumn("number", F.col("inside") + F.col("before")).filter("number > 0")
    own = numbered.groupBy("file", "number").agg(F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("x"))  # the lines of one object
    text = F.array_join(F.transform("x", lambda v: v["value"]), "\n")
    apart = own.select(F.col("name").alias("file"), F.col("number"), F.regexp_extract(text, r"(?s)^(.*\})", 1).alias("record"))
    flat = lines.join(least, "file", "left_anti").filter(F.startswith(body, F.lit("[")))
    one = flat.select(F.col("name").alias("file"), F.posexplode(F.from_json("value", "array<string>")).alias("i", "record"))
    return apart.unionByName(one.select("file", (F.col("i") + 1).cast("long").alias("number"), "record"))


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of arrays with one schema, with ``file_`` and ``number_``; what is no object of it has nulls."""
    rows = array_records(spark, path).select("file", "number", F.from_json("record", schema).alias("x"))
    return rows.select("x.*", F.col("file").alias("file_"), F.col("number").alias("number_"))

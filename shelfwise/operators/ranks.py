"""Places in an order, of any number of rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.working import keep


def numbered(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds the place from 1 of each row in ``order``, within its group ``by`` or in the whole.

    Rows are cut into ranges of (group, order), so that a large group is many ranges; they are numbered within a range, and a
    range begins where those of its group before it end: one row for each group and range is summed. ``order`` is total, or
    rows that tie are numbered in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *by, *order)
    cut = keep(cut.withColumn("range_", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*by, "range_").agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"{c}_b_") for c in by), F.col("range_").alias("range_b_"), F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("before_"))
    same = F.col("range_") == F.col("range_b_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b_"))
    place = F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order)).cast("long")
    out = cut.withColumn(name, place).join(before, same)
    return out.withColumn(name, F.col(name) + F.col("before_")).drop("range_", "range_b_", "before_", *(f"{c}_b_" for c in by))

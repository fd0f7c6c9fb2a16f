"""An audit that goes on from the one before: results of products that are still there stay, what is missing is audited."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.labels import keyed
from shelfwise.sources import sinks
from shelfwise.working import keep


def _values(rows: DataFrame, row_id: str, fields: Sequence[str], ids: str | None) -> DataFrame:
    return keyed(rows, fields, typed=False, ids=ids).select(row_id, "key").distinct()


def carried_on(products: DataFrame, before: DataFrame, audit: Callable[[DataFrame], DataFrame], fields: Sequence[str], ids: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Rows of an audit of ``products``: those of ``before`` that stay, as they are, and what ``audit`` says of products without a result.

    Both tables are known by the values of ``fields`` and of the array ``ids``, whatever field a value stands in, and have a
    ``row_id`` of their own. A row of ``before`` (its ``error`` is null if it is a result) stays if a product shares a value with
    it, and goes otherwise. A product is audited if it shares none with a result, so one whose audit failed is audited again.
    ``audit`` gives the columns of ``before`` but ``origin``, which is ``retained`` or ``new``. Values meet by equality: one join
    for either side.
    """
    now = keep(_values(products, row_id, fields, ids), "audit-values")
    old = keep(_values(before, row_id, fields, ids).join(before.select(row_id, F.col("error").isNull().alias("done")), row_id), "audit-before")
    stays = old.join(now.select("key").distinct(), "key", "left_semi").select(row_id).distinct()
    retained = before.join(stays, row_id, "left_semi").withColumn("origin", F.lit("retained"))
    covered = now.join(old.filter("done").select("key").distinct(), "key", "left_semi").select(row_id).distinct()
    new = audit(products.join(covered, row_id, "left_anti")).withColumn("origin", F.lit("new"))
    return retained.select(*before.columns, "origin").unionByName(new.select(*before.columns, "origin"))


def run_audit(spark: SparkSession, path: str, products: DataFrame, audit: Callable[[DataFrame], DataFrame], schema: str, fields: Sequence[str], ids: str | None = None, row_id: str = "row_id") -> dict[str, int]:
    """Carries the table under ``path`` on, as one new version, and says how many rows are what.

    The first run audits all. Results of the run before are read from the last complete version, so a run that is lost at
    any point is made again from the same state.
    """
    before = sinks.read_table(spark, path) if sinks.versions(spark, path) else spark.createDataFrame([], schema)
    columns = [c for c in before.columns if c != "origin"]
    sinks.replace_table(carried_on(products, before.select(*columns), audit, fields, ids, row_id), path)
    count = F.count_if
    is_new, failed = F.col("origin") == "new", F.col("error").isNotNull()
    row = sinks.read_table(spark, path).agg(count(~is_new & ~failed).alias("retained"), count(is_new & ~failed).alias("refreshed"), count(failed).alias("failures"), count(~failed).alias("reported")).first()
    return row.asDict()

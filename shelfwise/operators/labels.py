"""Label lookups by prioritised keys, coverage, and the classification cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, fields: Sequence[str], typed: bool = True, ids: str | None = None) -> DataFrame:
    """One row for each key that is not empty, with its priority: the place of its field in ``fields``.

    Typed keys carry their field's name; others are values, whatever field they stand in. ``ids``: an array of further
    values, which come last (of untyped keys only).
    """
    name = lambda f: F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) if typed else F.col(f).cast("string")
    parts = F.array(*(F.struct(F.lit(i).alias("priority"), name(f).alias("key"), F.col(f).cast("string").alias("v")) for i, f in enumerate(fields)))
    if ids is not None:
        more = F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), lambda x: F.struct(F.lit(len(fields)).alias("priority"), x.alias("key"), x.alias("v")))
        parts = F.concat(parts, more)
    found = df.withColumn("x_", F.explode(parts)).filter("x_.v IS NOT NULL AND x_.v <> ''")
    return found.withColumn("priority", F.col("x_.priority")).withColumn("key", F.col("x_.key")).drop("x_")


def identity_match(rows: DataFrame, row_id: str, others: DataFrame, other_id: str, fields: Sequence[str], ids: str) -> DataFrame:
    """``row_id, other_id`` of the row that any value of ``fields`` or ``ids`` is shared with, the first value first; of rows that
    share one value the last by ``other_id``. Rows without a match are left out."""
    build = keyed(others, fields, typed=False, ids=ids).groupBy("key").agg(F.max(other_id).alias(other_id))
    probe = keyed(rows, fields, typed=False, ids=ids).groupBy(row_id, "key").agg(F.min("priority").alias("priority"))
    return probe.join(build, "key").groupBy(row_id).agg(F.min_by(other_id, F.struct("priority", "key")).alias(other_id))


def lookup(rows: DataFrame, row_id: str, row_fields: Sequence[str], labels: DataFrame, label_fields: Sequence[str], label_order: str, values: Sequence[str], typed: bool = True) -> DataFrame:
    """``row_id`` with ``values`` of the label that matches on the first field; of labels of one key the last in order wins.

    An OR of equalities over fields would be a nested loop; exploded keys make it one join on equality.
    """
    pick = F.struct(*values)
    build = keyed(labels, label_fields, typed).groupBy("key").agg(F.max_by(pick, label_order).alias("label"))
    probe = keyed(rows.select(row_id, *row_fields), row_fields, typed).select(row_id, "key", "priority")
    return probe.join(build, "key").groupBy(row_id).agg(F.min_by("label", "priority").alias("label")).select(row_id, *(F.col(f"label.{v}").alias(v) for v in values))


def covered(rows: DataFrame, row_id: str, row_fields: Sequence[str], labels: DataFrame, label_fields: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows with (semi) or without (anti) a label on any field."""
    have = keyed(rows.select(row_id, *row_fields), row_fields).join(keyed(labels, label_fields).select("key").distinct(), "key", "left_semi").select(row_id).distinct()
    return rows.join(have, row_id, how)


def cascade(stages: Sequence[tuple[str, Column, Sequence[Column]]], default: tuple[str, Sequence[Column]], names: Sequence[str]) -> Column:
    """The values of the first stage whose condition holds, and its name: ``struct<stage, names...>``."""
    made = lambda name, values: F.struct(F.lit(name).alias("stage"), *(v.alias(n) for v, n in zip(values, names, strict=True)))
    out = None
    for name, condition, values in stages:
        test = F.coalesce(condition, F.lit(False))
        out = F.when(test, made(name, values)) if out is None else out.when(test, made(name, values))
    return out.otherwise(made(*default))


def fingerprint(columns: Sequence[str]) -> Column:
    """A stable digest of some columns: nulls count as empty, and the separator cannot be part of a value's end."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def typed_index(labels: DataFrame, fields: Sequence[str], order: str, values: Sequence[str], whole: Column | None = None) -> DataFrame:
    """``key, values`` of the last label by ``order`` of every ``field:value`` key. ``whole``: which labels say enough to be looked up."""
    rows = labels if whole is None else labels.filter(F.coalesce(whole, F.lit(False)))
    own = keyed(rows, fields).groupBy("key").agg(F.max_by(F.struct(order, *(v for v in values if v != order)), order).alias("x"))
    return own.select("key", *(F.col(f"x.{v}").alias(v) for v in values))

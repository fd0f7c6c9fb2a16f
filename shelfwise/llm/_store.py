"""Working tables of this package's operators, and sizes that depend on the session."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from shelfwise.working import keep, new_path, shared_dir, working

__all__ = ["OWN", "broadcast_if", "column", "keep", "narrow", "new_path", "opened", "packed", "packed_with", "partitions_for", "shared_dir", "text_batches", "unpacked", "working"]

#: Where ``packed`` puts the caller's columns.
OWN = "own"


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, unless the session has set them: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own default
        spark.conf.set(name, rows)


def narrow(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table as one partition if it has few rows: what groups or joins it then needs no shuffle."""
    return df.coalesce(1) if df.count() <= rows else df


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast where it has at most ``most`` rows and joined otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def column(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The caller's columns as one struct ``own``, so that no name of theirs can clash; ``text`` beside it if it is not among them."""
    own = F.struct(*(column(c).alias(c) for c in carried)).alias(OWN)
    return docs.select(own) if "text" in carried else docs.select(own, "text")


def packed_with(df: DataFrame, **more: DataType) -> StructType:
    """The schema of ``own`` and further columns."""
    return StructType([df.schema[OWN], *(StructField(k, v) for k, v in more.items())])


def unpacked(carried: Sequence[str]) -> list[Column]:
    return [F.col(OWN).getField(c).alias(c) for c in carried]


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``own`` and ``text``."""
    for b in batches:
        own = b.column(0)
        text = b.column(1) if b.num_columns > 1 else pc.struct_field(own, [own.type.get_field_index("text")])
        yield pa.RecordBatch.from_arrays([own, text], names=[OWN, "text"])

"""Writers: overwrite, keyed upsert of a table's files, and prompt chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.merge import upsert
from shelfwise.operators.ranks import numbered
from shelfwise.working import delete


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, ascending: those whose write was committed. A folder that is not there has none; any other fault is raised."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n, p in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upsert_table(df: DataFrame, path: str, keys: Sequence[str], held: int = 2) -> None:
    """Rows of ``df`` in place of those of their keys under ``path``.

    Each call writes a new folder ``v<number>``, which counts once Spark's committer has marked it as complete: whatever
    call is lost, at whatever point, the highest complete version is the table, and nothing of it has been touched. A
    broken version is written over by the next call. The ``held`` last versions stay, so a reader of the one before is
    not cut off. One writer at a time.
    """
    there = versions(df.sparkSession, path)
    old = df.sparkSession.read.parquet(f"{path}/v{there[-1]}") if there else df.limit(0)
    replace_table(upsert(old, df, keys), path, held)


def replace_table(df: DataFrame, path: str, held: int = 2) -> None:
    """``df`` as the next version of the table under ``path``; see ``upsert_table``. ``df`` may read the version before."""
    spark, there = df.sparkSession, versions(df.sparkSession, path)
    number = there[-1] + 1 if there else 0
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v{number}")
    for before in there[: max(0, len(there) + 1 - held)]:
        delete(spark, f"{path}/v{before}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(f"no complete version under {path}")
    return spark.read.parquet(f"{path}/v{there[-1]}")


def chunked(df: DataFrame, group: str, order: Sequence[str], size: int) -> DataFrame:
    """Adds ``chunk`` (from 0) and ``local_id`` (from 1) within each group, however large; see ``ranks.numbered``."""
    return numbered(df, order, [group], "n_").withColumn("chunk", F.floor((F.col("n_") - 1) / size)).withColumn("local_id", ((F.col("n_") - 1) % size + 1).cast("int")).drop("n_")


def checkpoint(df: DataFrame, path: str, run: int) -> None:
    """The rows that a run has added, in a folder of their own: a run that is repeated writes over its own rows only."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def resumed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all runs that were written whole, with their ``run``; none where nothing has been written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [str(p.toString()) for p in found if p.getName().startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], f"{schema}, run int")
    return spark.read.schema(f"{schema}, run int").option("basePath", path).parquet(*whole)

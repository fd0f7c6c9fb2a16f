"""Working tables: lineage is cut by writing Parquet where every executor can read it.

Each run has a folder of its own below ``spark.checkpoint.dir``. Tables written outside ``working`` stay until the driver's JVM
ends, because results that are not computed yet read them; inside ``working`` they go when the block ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_RUN = uuid.uuid4().hex
_MADE: set[str] = set()
_FOLDER: ContextVar[str] = ContextVar("shelfwise_working_folder", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may have none: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them can read")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="shelfwise-"))
        _deleted_at_end(spark, _OWN[0])
    return _OWN[0]


def _deleted_at_end(spark: SparkSession, path: str) -> None:
    """The folder is made, and deleted when the driver's JVM ends in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else has, in the folder of the current block or else of this process."""
    folder = f"{shared_dir(spark)}/shelfwise/{_FOLDER.get() or _RUN}"
    if not _FOLDER.get() and folder not in _MADE:
        _deleted_at_end(spark, folder)
        _MADE.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns a reader of the written table: later stages restart from it, not from the input."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """A folder for the tables that are written in the block; deleted at its end, so what reads them is written before."""
    name = uuid.uuid4().hex
    token = _FOLDER.set(name)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        delete(spark, f"{shared_dir(spark)}/shelfwise/{name}")

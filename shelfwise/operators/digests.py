"""Digests of ordered sets of any size: a SHA-256 over the whole text, which no task and no row holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a set that are hashed at a time, about.
CHUNK = 1 << 20


def _pieces(keys: int, between: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, number, schema = None, [], 0, 0, None

        def closed() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip((*key, number, between.join(held), len(held)), [*(f.type for f in schema)][:keys] + [pa.int64(), pa.string(), pa.int64()], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*schema.names[:keys], "number_", "piece_", "rows_"])

        for batch in batches:
            schema = batch.schema
            for *new, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (new != key or size >= CHUNK):
                    yield closed()
                    number, held, size = number + 1, [], 0
                key = new
                held.append(text or "")
                size += len(held[-1])
        if held:
            yield closed()

    return run


def _hashed(keys: int, opening: str, between: str, closing: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, types = None, None, 0, None

        def closed() -> pa.RecordBatch:
            digest.update(closing.encode())
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types, strict=True)), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=[*names, "n", "digest"])

        for batch in batches:
            types, names = [f.type for f in batch.schema][:keys], batch.schema.names[:keys]
            for *new, piece, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key or digest is None:
                    if digest:
                        yield closed()
                    key, n, digest = new, 0, hashlib.sha256((opening + piece).encode())
                else:
                    digest.update((between + piece).encode())
                n += rows
        if digest:
            yield closed()

    return run


def ordered_digest(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, opening: str = "[", between: str = ", ", closing: str = "]") -> DataFrame:
    """``by, n, digest``: the SHA-256 of each set's texts in order, joined as a JSON array is (a null text is empty).

    Sets are sorted and joined by many tasks, in pieces of ``CHUNK`` characters; only the hashing of a set's pieces, one after
    another, is one task's work, as a digest of the whole has to be. Sets without rows have none.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = rows.select(*by, *(c for c in order if c not in by), text.alias("text_"))
    cut = chosen.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    kinds = [f for f in chosen.schema if f.name in by]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    pieces = cut.select(*by, "text_").mapInArrow(_pieces(len(by), between), f"{names}, number_ long, piece_ string, rows_ long")
    # ranges are in order and so are a range's pieces
    placed = pieces.withColumn("range_", F.spark_partition_id())
    dealt = placed.repartition(parts, *by).sortWithinPartitions(*by, "range_", "number_").select(*by, "piece_", "rows_")
    return dealt.mapInArrow(_hashed(len(by), opening, between, closing), f"{names}, n long, digest string")

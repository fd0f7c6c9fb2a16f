"""Removal of every byte that a repeated string of ``length`` bytes covers.

Windows of ``length`` bytes are told apart by a content-defined anchor in each: equal windows have equal anchors at equal
places, so only occurrences of one anchor need to be compared. Runs of windows that share an anchor and are repeated whole
are found by counting a hash of their bytes. For the other occurrences of an anchor, the strings that start at it are
sorted; this is the suffix array of the windows that start there. A Burrows-Wheeler step then puts the byte before each in
front: within an interval of strings that agree so far, a stable partition by that byte gives the intervals of strings
longer by one and their order, and the least common prefix between new neighbours is that of the range between their old
places. So all intervals are extended together, one byte a level, breadth first; those with one string are dropped, and a
level's windows are repeated where the prefix that neighbours share reaches ``length``, where extension stops. Anchors with
more occurrences than a task can sort have their windows counted by hash instead, and equal hashes are held against the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import _joined, anchors, gram_hashes
from ._store import keep, partitions_for
from ._words import raw_bytes, slices, texts_of

#: Occurrences of one anchor that are sorted together; the windows of more are counted by hash, which needs no group.
GROUP = 4096
#: Bits of the hash by which the windows of larger groups are counted before their bytes are compared.
HASH_BITS = 64
#: Bytes of text that a worker hashes at once, about; it holds some eighty times as much for a moment.
PIECE_BYTES = 3 << 19
#: Occurrences in one batch of sorting, about.
BATCH = 16384
#: Ids that are broadcast to pick documents, at most; more are joined.
BROADCAST_ROWS = 1_000_000


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, "text", PIECE_BYTES):
                data, offsets = raw_bytes(texts_of(piece.column("text")))
                r = anchors(data, offsets, length)
                place = r["lo"] << 16 | (r["hi"] - r["lo"]) << 8 | (r["at"] - r["lo"])
                key = piece.column("key").to_numpy(zero_copy_only=False)[r["row"]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(r["gram"].view(np.int64)), pa.array(r["all"].view(np.int64))], names=["key", "place", "gram", "whole"])

    return run


def _contexts(length: int):
    """The bytes of each wanted run of windows: from its first start to the end of its last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, "text", PIECE_BYTES):
                out: list[tuple] = []
                for key, text, wanted in zip(piece.column("key").to_pylist(), piece.column("text"), piece.column("wanted").to_pylist(), strict=True):
                    data = text.as_buffer()
                    for w in wanted:
                        lo, more, at = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                        out.append((w["gram"], w["contexts"], key, lo, at, w["n"], data[lo : lo + more + length].to_pybytes()))
                for i in range(0, len(out), 8192):
                    columns = list(zip(*out[i : i + 8192], strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "contexts", "key", "lo", "at", "n", "bytes"])

    return run


def repeated(group: np.ndarray, texts: list[bytes], at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of every window that occurs in two contexts of its group; at: the anchor's place in each."""
    n, none = len(texts), np.zeros(0, np.int64)
    if not n:
        return none, none
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    right_n, left_n = np.minimum(sizes - at, length), at
    j = np.arange(length)
    inside = j[None, :] < right_n[:, None]
    right = np.where(inside, data[np.minimum((starts + at)[:, None] + j[None, :], len(data) - 1)], 0)
    deepest = int(left_n.max())
    j = np.arange(max(deepest, 1))
    left = np.where(j[None, :] < left_n[:, None], data[np.maximum((starts + at)[:, None] - 1 - j[None, :], 0)], 0)
    keys = [t[a : a + length] for t, a in zip(texts, at.tolist(), strict=True)]
    groups = group.tolist()
    order = np.array(sorted(range(n), key=lambda i: (groups[i], keys[i])), dtype=np.int64)
    a, b = order[:-1], order[1:]
    same = right[a] == right[b]
    shared = np.where(same.all(axis=1), length, same.argmin(axis=1))
    shared = np.concatenate([[0], np.minimum(shared, np.minimum(right_n[a], right_n[b]))])  # with the neighbour before, from the anchor on
    new = np.concatenate([[True], group[a] != group[b]])  # starts an interval
    found: list[tuple[np.ndarray, int]] = []
    for depth in range(deepest + 1):
        alone = new & np.append(new[1:], True)
        if alone.any():
            order, shared, new = order[~alone], shared[~alone], new[~alone]
        if not len(order):
            break
        hit = ~new & (shared + depth >= length)
        both = hit | np.append(hit[1:], False)
        if both.any():
            found.append((order[both], depth))
        # put the byte before in front; contexts that have none left go
        has = left_n[order] > depth
        byte = left[order, min(depth, left.shape[1] - 1)].astype(np.int64)
        key = np.cumsum(new) * 256 + byte
        old = np.flatnonzero(has)
        old = old[np.argsort(key[old], kind="stable")]
        if not len(old):
            break
        key = key[old]
        new_next = np.concatenate([[True], key[1:] != key[:-1]])
        least = shared[old].copy()
        far = np.flatnonzero(~new_next[1:] & (old[1:] != old[:-1] + 1)) + 1  # the least over the old places between
        if len(far):
            # from the old place after the left neighbour to that of the right one; the pad ends the last range
            ends = np.stack([old[far - 1] + 1, old[far] + 1], axis=1).ravel()
            least[far] = np.minimum.reduceat(np.append(shared, 0), ends)[::2]
        order, shared, new = order[old], least, new_next
    if not found:
        return none, none
    which = np.concatenate([w for w, _ in found])
    depth = np.repeat([d for _, d in found], [len(w) for w, _ in found])
    return which, at[which] - depth


def _expander(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
            group, at, lo, n, key = (column[c].to_numpy(zero_copy_only=False) for c in ("gram", "at", "lo", "n", "key"))
            which, start = repeated(group, column["bytes"].to_pylist(), at.astype(np.int64), length)
            own = n[which] < 2  # the others are repeated whole
            key, at_ = key[which][own], (lo[which] + start)[own]
            by = np.lexsort((at_, key))
            key, at_ = key[by], at_[by]
            cut = np.concatenate([[True], (key[1:] != key[:-1]) | (at_[1:] > at_[:-1] + 1)]) if len(key) else np.zeros(0, bool)
            ends = np.append(np.flatnonzero(cut)[1:], len(key)) - 1
            return pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(at_[cut]), pa.array(at_[ends.astype(np.int64)] if len(key) else at_)], names=["key", "lo", "hi"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                rows = pa.Table.from_batches(held)
                gram = rows.column("gram").to_numpy()
                last = int(np.searchsorted(gram, gram[-1], side="left"))  # the last group may go on
                if last:
                    yield solved(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def _window_hashes(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(["gram", "key", "lo", "at", "n", "bytes"]).to_pylist()
            for r in rows:
                data = np.frombuffer(r["bytes"], dtype=np.uint8)
                s = np.arange(len(data) - length + 1)
                _, h128 = gram_hashes(data)
                h = (_joined(h128[s], h128[s + length - 128]) >> np.uint64(64 - bits)).view(np.int64)
                full = lambda v, k: pa.array(np.full(len(s), v, dtype=k))
                own = pa.array([r["bytes"][i : i + length] for i in s.tolist()], pa.binary())
                columns = [full(r["gram"], np.int64), pa.array((r["at"] - s).astype(np.int32)), pa.array(h), full(r["key"], np.int64), pa.array(r["lo"] + s), full(r["n"], np.int64), own]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "depth", "h", "key", "lo", "n", "window"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for key, text, ranges in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            data, kept, at, removed, spans = (text or "").encode(), hashlib.sha256(), 0, 0, 0
            end = -1
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                if lo > end:
                    spans += 1
                    kept.update(data[max(at, 0) : lo])
                    removed -= lo
                    end = hi
                    removed += hi
                elif hi > end:
                    removed += hi - end
                    end = hi
                at = end
            kept.update(data[max(at, 0) :])
            out.append((key, removed, spans, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n_removed", "n_spans", "digest"])


def _picked(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is among ``keys``."""
    ids = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return base.select("key", "text").join(ids, "key")


def repeated_ranges(base: DataFrame, length: int) -> DataFrame:
    """``key, ranges`` (lo, hi: first and end byte) of documents ``key, text`` with bytes in repeated windows; keys tell texts apart."""
    found = keep(base.mapInArrow(_anchor_rows(length), "key long, place long, gram long, whole long"), "sub-anchors")
    counts = keep(found.groupBy("gram", "whole").agg(F.count("*").alias("n")), "sub-counts")
    groups = counts.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 AND least = 1").drop("least")
    told = counts.join(keep(groups, "sub-groups"), "gram", "left").filter("n > 1 OR contexts IS NOT NULL")
    told = keep(told, "sub-told")
    hits = found.join(told, ["gram", "whole"])
    hits = keep(hits.selectExpr("key", "place", "IF(contexts IS NULL, NULL, gram) AS gram", "IF(contexts IS NULL, NULL, whole) AS whole", "n", "contexts"), "sub-hits")
    some = hits.filter("contexts IS NOT NULL").groupBy("gram", "whole").agg(F.min(F.struct("key", "place")).alias("x"), F.max("n").alias("n"), F.max("contexts").alias("contexts"))
    wanted = keep(some.groupBy("x.key").agg(F.collect_list(F.struct("gram", "contexts", "x.place", "n")).alias("wanted")), "sub-wanted")
    contexts = _picked(base, wanted.select("key")).join(wanted, "key").mapInArrow(_contexts(length), "gram long, contexts long, key long, lo long, at int, n long, bytes binary")
    contexts = keep(contexts, "sub-contexts")
    dealt = contexts.filter(F.col("contexts") <= GROUP).repartition(partitions_for(base.sparkSession), "gram").sortWithinPartitions("gram")
    ranges = dealt.mapInArrow(_expander(length), "key long, lo long, hi long")
    large = contexts.filter(F.col("contexts") > GROUP).mapInArrow(_window_hashes(length, HASH_BITS), "gram long, depth int, h long, key long, lo long, n long, window binary")
    large = keep(large, "sub-windows")
    # windows of one hash are one string if the least of them is the largest; those of a hash that two strings share are counted by their bytes
    at = ["gram", "depth", "h"]
    sums = large.groupBy(*at).agg(F.count("*").alias("times"), F.min("window").alias("least"), F.max("window").alias("most")).filter("times > 1")
    twice = keep(sums.selectExpr(*at, "least = most AS one"), "sub-twice")
    open_ = large.filter("n < 2")
    ranges = ranges.unionByName(open_.join(twice.filter("one"), at).selectExpr("key", "lo", "lo AS hi"))
    mixed = large.join(twice.filter("NOT one").select(*at), at).groupBy(*at, "window").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    ranges = ranges.unionByName(open_.join(mixed, [*at, "window"]).selectExpr("key", "lo", "lo AS hi"))
    whole = hits.filter("n > 1").selectExpr("key", "place >> 16 AS lo", "(place >> 16) + (place >> 8 & 255) AS hi").distinct()
    spans = ranges.unionByName(whole).selectExpr("key", "lo", f"hi + {length} AS hi")
    return keep(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "sub-ranges")


def remove_repeated(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document.

    Texts are UTF-8 bytes (null: empty) and matches never cross documents. Rows that repeat an id or have none are
    documents each: where ids do not tell rows apart, a hash of id and text does, and rows that share both are treated
    alike. Texts of under ``length`` bytes keep everything. An empty table gives no rows. ``length``: 128 to 256.
    """
    if not 128 <= length <= 256:
        raise ValueError("length must be 128 to 256")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, ids = own.agg(F.count("*"), F.countDistinct("doc_id")).first()
    base = own.withColumn("key", F.col("doc_id") if rows == ids else F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(base, length)
    texts = _picked(base, ranges.select("key"))
    if rows != ids:  # copies of a row count as occurrences of their own, but are cut once
        texts = texts.dropDuplicates(["key"])
    cut = keep(texts.join(ranges, "key").mapInArrow(_cut, "key long, n_removed long, n_spans long, digest string"), "sub-cut")
    out = base.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")).join(cut, "key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))

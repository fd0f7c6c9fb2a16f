"""Token-ID output in a Simple-8b file format.

Rows of the format (Parquet as the container, so that Spark's committer makes each shard appear whole or not at all):
``shard, chunk`` place of the row, ``before`` ids of the shard before it, ``n_ids``, ``doc_ids`` and ``n_tokens`` of its
documents, ``words`` the 64-bit little-endian Simple-8b words, ``blocks`` the first word of every block of ``BLOCK`` ids
(little-endian int32), ``escape_at`` and ``escape_value`` the ids of 60 bits or more, which stand as 0 in the words.
A word has a selector in its upper four bits and that selector's number of equally wide ids below.
A block starts at a word, and ids that its last word has room for beyond the block's end are padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, partitions_for
from ._words import raw_bytes, release, slices, texts_of, words_of

BLOCK = 1024
#: Fixed values of Simple-8b: ids in a word and bits of an id by selector (0 and 1 are not used).
COUNTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
LARGEST = (1 << 60) - 1

_STOP, _LETTER, _SPACE = (np.isin(np.arange(256), list(x)) for x in (b".,", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"\t\n\x0b\x0c\r "))

SCHEMA = "shard int, chunk long, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, words binary, blocks binary, escape_at array<int>, escape_value array<long>"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, places of escaped ids, and their values (as unsigned 64-bit integers)."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    escape_at = np.flatnonzero(ids > np.uint64(LARGEST)).astype(np.int32)
    escape_value = ids[escape_at]
    if len(escape_at):
        ids = ids.copy()
        ids[escape_at] = 0
    n_blocks = -(-n // BLOCK)
    rows = BLOCK + int(COUNTS.max())
    table = np.zeros((n_blocks, rows), dtype=np.uint64)
    filled = np.zeros(n_blocks * BLOCK, dtype=np.uint64)
    filled[:n] = ids
    table[:, :BLOCK] = filled.reshape(n_blocks, BLOCK)
    flat = table.ravel()
    # a selector can only fit where the one before it, of fewer and wider ids, does
    best = np.full(flat.size, 15, dtype=np.uint8)
    at, largest = None, int(ids.max())
    for s in range(14, 1, -1):
        if at is None and largest < 1 << int(WIDTHS[s]):  # it fits everywhere
            best[:] = s
            continue
        if at is None:
            small = table < np.uint64(1 << int(WIDTHS[s]))
            fits = small[:, :BLOCK].copy()
            for j in range(1, int(COUNTS[s])):
                fits &= small[:, j : BLOCK + j]
            block, inside = np.nonzero(fits)
            at = block * rows + inside
        else:
            small = flat[at] < np.uint64(1 << int(WIDTHS[s]))
            at = at[small]
            for j in range(1, int(COUNTS[s])):
                at = at[flat[at + j] < np.uint64(1 << int(WIDTHS[s]))]
        if not len(at):
            break
        best[at] = s
    lengths = np.full(n_blocks, BLOCK)
    lengths[-1] = n - BLOCK * (n_blocks - 1)
    live, where = np.arange(n_blocks), np.zeros(n_blocks, dtype=np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    per_block = np.zeros(n_blocks, dtype=np.int64)
    while len(live):
        place = live * rows + where
        s = best[place]
        steps.append((live, place, s))
        per_block[live] += 1
        where = where + COUNTS[s]
        on = where < lengths[live]
        live, where = live[on], where[on]
    blocks = np.cumsum(per_block) - per_block
    to = np.concatenate([blocks[x] + i for i, (x, _, _) in enumerate(steps)])
    place = np.concatenate([x for _, x, _ in steps])
    sel = np.concatenate([x for _, _, x in steps])
    words = np.empty(len(sel), dtype=np.uint64)
    for s in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == s)
        from_ = place[mine]
        word = np.full(len(mine), s << 60, dtype=np.uint64)
        for j in range(int(COUNTS[s])):
            word |= flat[from_ + j] << np.uint64(j * int(WIDTHS[s]))
        words[to[mine]] = word
    return words, blocks.astype(np.int32), escape_at, escape_value


def unpack(words: np.ndarray, blocks: np.ndarray, n: int, escape_at=(), escape_value=()) -> np.ndarray:
    """The ids of ``pack``: every block is decoded at once, from its own offset."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    ends = np.cumsum(counts)
    block = np.repeat(np.arange(len(blocks)), np.diff(np.append(blocks.astype(np.int64), len(words))))
    first = (ends - counts)[blocks]
    place = block * BLOCK + (ends - counts) - first[block]
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        w, p, e = words[mine], place[mine], limit[mine]
        for j in range(int(COUNTS[s])):
            inside = p + j < e
            if inside.all():
                out[p + j] = (w >> np.uint64(j * int(WIDTHS[s]))) & mask
            else:
                out[(p + j)[inside]] = (w[inside] >> np.uint64(j * int(WIDTHS[s]))) & mask
    if len(escape_at):
        out[np.asarray(escape_at, dtype=np.int64)] = np.asarray(escape_value, dtype=np.uint64)
    return out


#: The normaliser and the pieces of tokenizers whose ids are those of the parts between white space.
_LEVELS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where a tokenizer drops white space, which parts its pieces, and letters' case, a text's ids are those of its parts
    between white space one after another; each distinct part of a batch is given to the library once. Any other
    tokenizer gets whole texts.
    """

    MARK = "<|startoftext|>"
    #: Parts remembered from batch to batch, about.
    REMEMBERED = 200_000

    def __init__(self, path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        first = ((known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_parts = known.get("normalizer") == _LEVELS and first.get("pattern") == {"Regex": _PIECES} and first.get("behavior") == "Removed" and bool(first.get("invert"))
        self.mark = self.tokenizer.token_to_id(self.MARK)
        self.known, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def levelled(texts: pa.Array) -> pa.Array:
        """Texts of the same ids with fewer distinct parts: a space before a full stop or comma that ends a part after an
        ASCII letter, where a piece ends anyway, and ASCII letters in lower case, as the tokenizer has them."""
        data, offsets = raw_bytes(texts)
        if len(data):
            stop = np.flatnonzero(_STOP[data[1:]] & _LETTER[data[:-1]]) + 1
            after = np.append(_SPACE[data[1:]], True)
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            stop = stop[after[stop] & ~np.isin(stop, offsets)]
            data = np.insert(data, stop, 0x20)
            offsets = offsets + np.searchsorted(stop, offsets, side="left")
        lower = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        low = pc.ascii_lower(lower)
        special = pc.any(pc.match_substring(low, "<|")).as_py()  # special tokens are told apart by case
        return lower if special else low

    def _each(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self._each(parts)
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(x) for x in each], dtype=np.int64)

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_apart``, with a special token between the parts, so that the library has one long text."""
        if self.mark is None or any(self.MARK in x for x in parts):
            return self._apart(parts)
        flat = self._each([self.MARK.join(parts) + self.MARK])[0]
        at = np.flatnonzero(flat == self.mark)
        if len(at) != len(parts):
            return self._apart(parts)
        return flat[flat != self.mark], np.diff(np.concatenate([[-1], at])) - 1

    def parts(self, distinct: pa.Array, step: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each part's ids start and how many they are. Parts met early, the common ones, are remembered."""
        place = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(place))
        got = [self._together(new.slice(i, step).to_pylist()) for i in range(0, len(new), step)]
        flat = np.concatenate([self.flat, *(x for x, _ in got)])
        sizes = np.concatenate([self.sizes, *(n for _, n in got)])
        at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.sizes) + np.arange(len(new))
        if len(self.known) < self.REMEMBERED:
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, new]), flat, sizes
        return flat, (np.cumsum(sizes) - sizes)[at], sizes[at]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` after it, and their number for each text."""
        if not self.by_parts:
            each = self._each(texts.to_pylist())
            ends = [np.append(x, np.uint32(end_id)) for x in each]
            return np.concatenate([*ends, np.zeros(0, np.uint32)]), np.array([len(x) for x in ends], dtype=np.int64)
        codes, distinct, counts = words_of(self.levelled(texts))
        flat, starts, sizes = self.parts(distinct)
        word_sizes = sizes[codes]
        sums = np.concatenate([[0], np.cumsum(word_sizes)])
        ends = np.cumsum(counts)
        n = sums[ends] - sums[ends - counts] + 1
        total = int(n.sum())
        out = np.full(total, end_id, dtype=np.uint32)
        row = np.repeat(np.arange(len(counts)), counts)  # ids that stand before a word: those of the words before, and an end id for each document before
        to = sums[:-1] + row
        shift = np.repeat(starts[codes] - sums[:-1], word_sizes)
        out[np.repeat(to - sums[:-1], word_sizes) + np.arange(int(sums[-1]))] = flat[shift + np.arange(int(sums[-1]))]
        return out, n.astype(np.int64)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    """One for each tokenizer in a Python worker, which many tasks use one after another."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(path: str | None, end_id: int, chunk_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, chunk, before = encoder_of(path), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list = []
        sizes: list[int] = []
        held = 0

        def closed() -> pa.RecordBatch:
            words, blocks, at, value = pack(np.concatenate(ids))
            columns = [[shard], [chunk], [before], [held], [docs], [sizes], [words.astype("<u8").tobytes()], [blocks.astype("<i4").tobytes()], [at.tolist()], [value.view(np.int64).tolist()]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                new, n = encoder.encode(texts_of(piece.column("text")), end_id)
                # documents stay whole: a chunk ends with the first document that brings it to chunk_ids
                taken = end = 0
                for doc, size in zip(piece.column("doc_id").to_pylist(), n.tolist(), strict=True):
                    docs.append(doc)
                    sizes.append(size)
                    held, end = held + size, end + size
                    if held >= chunk_ids:
                        ids.append(new[taken:end])
                        yield closed()
                        chunk, before, taken = chunk + 1, before + held, end
                        ids, docs, sizes, held = [], [], [], 0
                if end > taken:
                    ids.append(new[taken:end])
        if docs:
            yield closed()
        ids, docs, sizes = [], [], []
        release()

    return run


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str | None = None, end_id: int = 2, chunk_ids: int = 1 << 18, shards: int | None = None) -> None:
    """Encodes every whole text (null: empty), appends ``end_id`` to each, and writes shards in ascending ``doc_id`` order.

    Documents without an id come first; rows with one id are ordered by their text, and shards are cut between texts of one
    id too, by the first 64 characters. Copies of one row are records each. Very long texts are encoded whole, in a piece of
    their own. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = chosen.repartitionByRange(shards or partitions_for(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, end_id, chunk_ids), SCHEMA).write.option("compression", "none").parquet(path)


def _ids_of(words: bytes, blocks: bytes, n: int, at: list, value: list) -> np.ndarray:
    return unpack(np.frombuffer(words, dtype="<u8"), np.frombuffer(blocks, dtype="<i4"), n, at, np.array(value, dtype=np.int64).view(np.uint64))


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # what this worker has from writing; files are read without
        release()
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids = _ids_of(r["words"], r["blocks"], r["n_ids"], r["escape_at"], r["escape_value"]).astype("<u4")
                n = np.array(r["n_tokens"], dtype=np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["offset"] + r["before"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(ends - n, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start, n_tokens, ids_crc32``, and ``ids`` if asked for.

    Only the places of shards, one number for each file, are broadcast.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("ids_of_shard"))
    offsets = shards.selectExpr("shard", "coalesce(sum(ids_of_shard) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset")
    placed = rows.join(F.broadcast(offsets), "shard").select("offset", "before", "n_ids", "doc_ids", "n_tokens", "words", "blocks", "escape_at", "escape_value")
    return placed.mapInArrow(_reader(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' own record of each document of ``documents``."""
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)

"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window must lie in a document whole, so its necessary prefix is one token: its rarest. That token is met in the documents,
its place in the window fixes where the window would start, which must leave room for all its words in the document (length
and position), and then the whole window is compared.

A benchmark of up to ``BLOCK_BYTES`` is broadcast: tokens are words, and every word of a window is compared where a document is
read. A larger one is joined (``_joined``): tokens are runs of up to ``SHINGLE`` words, ordered by counts of bounded size that both
sides know, so that both choose the same token for the same window; each becomes a row, and windows are compared by 128 bits.
Nothing that is broadcast or collected there grows with the benchmark, and the documents are read three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

from ._store import OWN, broadcast_if, keep, opened, packed, packed_with, unpacked
from ._words import hashes_of, mapped, rolling, slices, texts_of, words_of

FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Bytes of benchmark that are broadcast, at most; a larger one is joined.
BLOCK_BYTES = 4 << 20
#: Of a joined benchmark: words of a token, counters of tokens, bits of the filter, and results that are broadcast at most.
SHINGLE, SLOTS, BITS, BROADCAST_ROWS = 5, 1 << 18, 1 << 24, 500_000
#: Lower-cases A-Z; what ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` leaves out becomes a space.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[0x41:0x5B] += 0x20
_TABLE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


class Windows:
    """The distinct windows of a block of items, by their rarest word."""

    def __init__(self, ids: list[str | None], texts: list[str | None], width: int) -> None:
        codes, distinct, counts = words_of(mapped(texts_of(pa.array(texts, pa.string())), _TABLE))
        self.words, self.ids, self.width = distinct, ids, width
        rows: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        end = np.cumsum(counts)
        for item, (hi, n) in enumerate(zip(end.tolist(), counts.tolist(), strict=True)):
            own = codes[hi - n : hi].astype(np.int32)
            for lo in range(n - width + 1) if n >= width else [0] * (n > 0):
                w = own[lo : lo + width]
                rows.setdefault(w.tobytes(), (w, set()))[1].add(item)
        self.lengths = np.array([len(w) for w, _ in rows.values()], dtype=np.int64)
        self.codes = np.full((len(rows), width), -1, dtype=np.int32)
        for i, (w, _) in enumerate(rows.values()):
            self.codes[i, : len(w)] = w
        self.items = [sorted(x) for _, x in rows.values()]

    def order(self, frequency: np.ndarray) -> None:
        """frequency: of each word in the corpus. Sets the prefix of each window and the next rarest word to look at."""
        n = len(self.lengths)
        f = np.where(self.codes >= 0, frequency[np.maximum(self.codes, 0)], np.iinfo(np.int64).max)
        by = np.argsort(f, axis=1, kind="stable") if n else np.zeros((0, self.width), dtype=np.int64)
        self.first, self.second = by[:, 0], np.where(self.lengths > 1, by[:, min(1, self.width - 1)], by[:, 0])
        word = self.codes[np.arange(n), self.first]
        self.listed = np.argsort(word, kind="stable")
        self.n_listed = np.bincount(word, minlength=len(self.words))
        self.from_listed = np.cumsum(self.n_listed) - self.n_listed

    def find(self, codes: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence. codes: of the documents' words (-1: not in any window)."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = np.flatnonzero(codes >= 0)
        known = known[self.n_listed[codes[known]] > 0]
        many = self.n_listed[codes[known]]
        cuts = np.searchsorted(np.cumsum(many), np.arange(step, int(many.sum()) + step, step), side="left") + 1
        lo = 0
        for hi in cuts.tolist():
            at, n = known[lo:hi], many[lo:hi]
            lo = hi
            if not len(at):
                continue
            place = np.repeat(at, n)
            inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            window = self.listed[np.repeat(self.from_listed[codes[at]], n) + inside]
            start = place - self.first[window]
            ok = (start >= row_start[place]) & (start + self.lengths[window] <= row_end[place])
            start, window = start[ok], window[ok]
            ok = codes[start + self.second[window]] == self.codes[window, self.second[window]]
            start, window = start[ok], window[ok]
            for j in range(self.width):
                if not len(start):
                    break
                ok = (self.lengths[window] <= j) | (codes[np.minimum(start + j, len(codes) - 1)] == self.codes[window, j])
                start, window = start[ok], window[ok]
            starts.append(start)
            found.append(window)
        return np.concatenate(starts), np.concatenate(found)


def _known(distinct: pa.Array, words: pa.Array) -> np.ndarray:
    """The code of each distinct word in a block's words, -1 for others."""
    return pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _counter(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.value
        seen = np.zeros(len(own), dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                codes, distinct, _ = words_of(mapped(texts_of(piece.column("text")), _TABLE))
                times = np.bincount(codes, minlength=len(distinct))
                known = _known(distinct, own)
                np.add.at(seen, known[known >= 0], times[known >= 0])
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(seen[full], pa.int64())], names=["code", "n"])

    return run


def _scanner(index, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = index.value
        for batch in opened(batches):
            for piece in slices(batch, "text", 8 << 20):
                codes, distinct, counts = words_of(mapped(texts_of(piece.column("text")), _TABLE))
                ends = np.cumsum(counts)
                row = np.repeat(np.arange(len(counts)), counts)
                per_row: list[set[str]] = [set() for _ in range(len(counts))]
                edge = np.zeros(len(codes) + 1, dtype=np.int64)
                start, window = w.find(_known(distinct, w.words)[codes] if len(codes) else codes, (ends - counts)[row], ends[row])
                for r, x in {(r, x) for r, x in zip(row[start].tolist(), window.tolist(), strict=True)}:
                    per_row[r].update(w.ids[i] for i in w.items[x] if w.ids[i] is not None)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.lengths[window], -1)
                sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_hit = sums[ends] - sums[ends - counts]
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in per_row]
                found = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in per_row], pa.int64()), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (share * n_hit >= counts))]
                yield pa.RecordBatch.from_arrays([piece.column(OWN), *found], names=[OWN, *FOUND])

    return run


def _runs(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, two of each; the words of each text; and the hash of the run of ``k`` words at each."""
    codes, distinct, counts = words_of(mapped(texts, _TABLE))
    one = hashes_of(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    two = hashes_of(distinct, 1)[codes] if len(codes) else np.zeros(0, np.uint64)
    return one, two, counts, rolling(one, k)


def _windows(texts: pa.Array, lengths: list[int], seen: np.ndarray, whole: int | None = None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each length: the length, the text of each window, and the windows' start, token, place of the token, and two hashes.

    The token is the rarest run of up to ``SHINGLE`` words by the counts ``seen``, of equal ones that of the smaller hash, then the
    first. ``whole``: the width of windows in items, of which shorter ones are windows whole.
    """
    one, two, counts, _ = _runs(texts, 1)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(one))
    for n in lengths:
        fits = at + n <= ends[row]
        if whole is not None and n < whole:
            fits &= counts[row] == n
        start = at[fits]
        if not len(start):
            continue
        k = min(SHINGLE, n)
        run = rolling(one, k)
        often = seen[(run % np.uint64(SLOTS)).astype(np.int64)]
        token, least, place = run[start], often[start], np.zeros(len(start), dtype=np.int64)
        for j in range(1, n - k + 1):
            t, c = run[start + j], often[start + j]
            better = (c < least) | ((c == least) & (t < token))
            token, least, place = np.where(better, t, token), np.where(better, c, least), np.where(better, j, place)
        first = (ends - counts)[row[start]]
        yield n, row[start], [start - first, token.view(np.int64), place, rolling(one, n)[start].view(np.int64), rolling(two, n)[start].view(np.int64)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often runs of words fall into each of ``SLOTS`` counters."""
    seen = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for piece in slices(batch, "text", 8 << 20):
            *_, run = _runs(texts_of(piece.column("text")), SHINGLE)
            seen += np.bincount((run % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    full = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(seen[full], pa.int64())], names=["slot", "n"])


_WINDOW = "n int, token long, place long, w1 long, w2 long"


def _of_items(width: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                ids = piece.column("item_id")
                for n, row, (_, *found) in _windows(texts_of(piece.column("text")), list(range(1, width + 1)), seen.value, width):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), *map(pa.array, found)], names=["item_id", "n", "token", "place", "w1", "w2"])

    return run


def _text_keys(texts: pa.Array) -> list[np.ndarray]:
    both = np.array([xxhash.xxh3_128_digest(x.as_buffer()) for x in texts], dtype="S16") if len(texts) else np.zeros(0, "S16")
    pairs = np.frombuffer(both.tobytes(), dtype="<i8").reshape(-1, 2)
    return [pairs[:, 0].copy(), pairs[:, 1].copy()]


def _of_documents(lengths: list[int], seen, bits):
    """Windows of documents whose token is among the benchmark's, as far as a filter of bounded size can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                texts = texts_of(piece.column("text"))
                keys = _text_keys(texts)
                for n, row, (start, token, *rest) in _windows(texts, lengths, seen.value):
                    slot = (token.view(np.uint64) % np.uint64(BITS)).astype(np.int64)
                    some = np.flatnonzero(bits.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
                    if len(some):
                        own = [keys[0][row[some]], keys[1][row[some]], start[some], np.full(len(some), n, np.int32), token[some], *(x[some] for x in rest)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["k1", "k2", "start", "n", "token", "place", "w1", "w2"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in opened(batches):
        for piece in slices(batch, "text", 8 << 20):
            texts = texts_of(piece.column("text"))
            *_, counts = words_of(mapped(texts, _TABLE))
            yield pa.RecordBatch.from_arrays([piece.column(OWN), pa.array(counts, pa.int64()), *map(pa.array, _text_keys(texts))], names=[OWN, "n_words", "k1", "k2"])


def _joined(docs: DataFrame, items: DataFrame, carried: list[str], width: int, share: int) -> DataFrame:
    """As ``scan_packed`` for a benchmark of any size: rows of both sides meet by their token, place, length and window.

    Rows are keyed by 128 bits of the text, so copies of a text have one result. Counts are ``SLOTS`` numbers, and the filter that
    keeps most windows from being rows is ``BITS`` bits, whatever the sizes of corpus and benchmark.
    """
    spark = docs.sparkSession
    seen = np.zeros(SLOTS, dtype=np.int64)
    counted = docs.select("text").mapInArrow(_sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # of bounded size
    seen[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(seen)
    windows = keep(items.mapInArrow(_of_items(width, counts), f"item_id string, {_WINDOW}"), "bench-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # width numbers at most
    words = windows.select(F.expr(f"token & {BITS - 1}L").alias("slot")).groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()  # of bounded size
    held = np.zeros(BITS >> 6, dtype=np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    bits = spark.sparkContext.broadcast(held)
    places = docs.select("text").mapInArrow(_of_documents(lengths, counts, bits), f"k1 long, k2 long, start long, {_WINDOW}")
    key, same = ["k1", "k2"], ["token", "n", "place", "w1", "w2"]
    hits = keep(places.join(windows.select(*same).distinct(), same, "left_semi").select(*key, "start", "n", "w1", "w2"), "bench-hits")
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*key, "start", "n").distinct().withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    n_hit = spans.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    ids = windows.filter("item_id IS NOT NULL").select("item_id", "n", "w1", "w2").distinct()
    found = hits.select(*key, "n", "w1", "w2").distinct().join(ids, ["n", "w1", "w2"]).select(*key, "item_id").distinct()
    named = found.groupBy(*key).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    results = keep(n_hit.join(named, key, "left"), "bench-results")
    rows = packed(docs, carried)
    sized = rows.mapInArrow(_sizes, packed_with(rows, n_words=LongType(), k1=LongType(), k2=LongType()))
    all_ = sized.join(broadcast_if(results, BROADCAST_ROWS), key, "left")
    empty = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_.select(
        OWN, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(empty)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def scan_packed(docs: DataFrame, benchmark: DataFrame, carried: list[str], *, width: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``own``, a struct of the columns ``carried`` of every document, with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A document is contaminated if it has a hit word and hit words times ``share`` reach its words. Null and empty texts
    have no words and are clean; rows that repeat an id are documents each. Items without words take no part; equal items
    are one, items with one id count once, and those without one give hits but are not among ``n_items`` and
    ``items_sha256``. Without documents there are no rows, without items nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    n_bytes = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    if n_bytes > block_bytes:
        return _joined(docs, items, carried, width, share)
    some = items.orderBy("item_id", "text").collect()  # of checked size
    index = Windows([r[0] for r in some], [r[1] for r in some], width)
    words = spark.sparkContext.broadcast(index.words)
    frequency = np.zeros(max(1, len(index.words)), dtype=np.int64)
    for r in docs.select("text").mapInArrow(_counter(words), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # one row a word of the benchmark
        frequency[r["code"]] = r["n"]
    index.order(frequency)
    rows = packed(docs, carried)
    done = packed_with(rows, n_words=LongType(), n_hit=LongType(), n_items=LongType(), items_sha256=StringType(), contaminated=BooleanType())
    return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(index), share), done)


def scan(docs: DataFrame, benchmark: DataFrame, carried: list[str] | None = None, **options) -> DataFrame:
    """As ``scan_packed``, with the columns ``carried`` (``doc_id``) beside the others: for names that do not clash."""
    carried = ["doc_id"] if carried is None else carried
    return scan_packed(docs, benchmark, carried, **options).select(*unpacked(carried), *FOUND)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.s = v.s AND p.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits) h, unnest(range(h.i, h.i + h.n)) AS u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

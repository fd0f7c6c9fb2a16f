"""Quality scores by histogram gradient-boosted trees over statistics of a document.

The trees are full binary trees of one depth, flattened into arrays of features, thresholds and leaf values, so that a
batch of documents is walked down all trees with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._store import OWN, opened, packed, packed_with, unpacked
from ._words import raw_bytes, slices, texts_of, words_of

FEATURES = (
    "log_chars", "log_words", "chars_per_word", "distinct_share", "top_share", "upper", "digit", "punctuation", "space", "beyond_ascii", "log_lines", "log_line_chars",
    "repeated_lines", "short_lines", "words_without_letters", "words_in_capitals", "words_capitalised", "words_ending_in_marks", "words_ending_in_two_marks", "spread_of_word_length", "log_longest_word", "marks_inside",
)

_CLASS = np.full(256, 3, dtype=np.int64)  # punctuation and control characters
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_CLASS[0x80:0xC0] = 5  # continuation bytes
_CLASS[0xC0:] = 6


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and the count of the most frequent one."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    key, times = np.unique(rows * (int(codes.max()) + 1) + codes, return_counts=True)
    row = key // (int(codes.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    return np.bincount(row, minlength=n).astype(float), most


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; zeros for an empty one."""
    n = len(texts)
    data, offsets = raw_bytes(texts)
    sizes = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * 7, sizes) + _CLASS[data], minlength=7 * n).reshape(n, 7).astype(float)
    chars = sizes - kinds[:, 5]
    codes, distinct, counts = words_of(texts)
    rows = np.repeat(np.arange(n), counts)
    own, most = _distinct(rows, codes, n)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(float)
    flags = [
        ~pc.match_substring_regex(distinct, r"[A-Za-z]|[^\x00-\x7F]").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(distinct, r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(distinct, r"^[A-Z][^A-Z]*$").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(distinct, r"[!-/:-@\[-`{-~]$").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(distinct, r"[!-/:-@\[-`{-~]{2}$").to_numpy(zero_copy_only=False),
        pc.match_substring_regex(distinct, r"[A-Za-z][!-/:-@\[-`{-~]+[A-Za-z]").to_numpy(zero_copy_only=False),
    ]
    sums = [np.bincount(rows, weights=x[codes].astype(float), minlength=n) if len(codes) else np.zeros(n) for x in (*flags, length, length**2)]
    longest = np.zeros(n)
    if len(codes):
        full = counts > 0
        longest[full] = np.maximum.reduceat(length[codes], (np.cumsum(counts) - counts)[full])
    mean = _ratio(sums[6], counts)
    lists = pc.split_pattern(texts, "\n")
    line_rows = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    lines = lists.flatten().dictionary_encode()
    line_codes = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(line_rows, minlength=n).astype(float)
    line_sizes = pc.utf8_length(lines.dictionary).to_numpy(zero_copy_only=False)
    short = np.bincount(line_rows, weights=(line_sizes[line_codes] < 20).astype(float), minlength=n) if len(line_codes) else np.zeros(n)
    own_lines, _ = _distinct(line_rows, line_codes, n)
    columns = [
        np.log1p(chars), np.log1p(counts), _ratio(chars, counts), _ratio(own, counts), _ratio(most, counts), _ratio(kinds[:, 0], chars), _ratio(kinds[:, 2], chars), _ratio(kinds[:, 3], chars), _ratio(kinds[:, 4], chars), _ratio(kinds[:, 6], chars), np.log1p(n_lines), np.log1p(_ratio(chars, n_lines)),
        1 - _ratio(own_lines, n_lines), _ratio(short, n_lines), *(_ratio(x, counts) for x in sums[:5]), np.sqrt(np.maximum(_ratio(sums[7], counts) - mean**2, 0)), np.log1p(longest), _ratio(sums[5], counts),
    ]
    out = np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))
    out[chars == 0] = 0
    return out


@dataclass
class Trees:
    """``feature`` and ``threshold`` of the inner nodes (node i has children 2i + 1 and 2i + 2) and ``leaf`` values, a row a tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 100, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss, second order; splits by histograms of at most ``bins`` bins a feature.

    Without rows the score is 0.5; with rows of one label it is that label's smoothed share.
    """
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2)
    start, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    if not n or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # value <= edge b: bin <= b
    base = binned + np.arange(d) * bins
    raw = np.full(n, start)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = (base + ((node - first) * d * bins)[:, None]).ravel()
            hg = np.bincount(key, weights=np.repeat(g, d), minlength=width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            hh = np.bincount(key, weights=np.repeat(h, d), minlength=width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < least) | (th - hh < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            pick = gain.reshape(width, -1).argmax(axis=1)
            for i, at in enumerate(pick.tolist()):
                if gain.reshape(width, -1)[i, at] > 1e-9:
                    feature[first + i], threshold[first + i] = at // bins, edges[at // bins][at % bins]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        sg, sh = np.bincount(node - inner, weights=g, minlength=inner + 1), np.bincount(node - inner, weights=h, minlength=inner + 1)
        leaf = -rate * sg / (sh + l2)
        raw += leaf[node - inner]
        for to, part in zip(out, (feature, threshold, leaf), strict=True):
            to.append(part)
    return Trees(start, *(np.stack(v) for v in out))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in slices(b, "text", 8 << 20):
            x = features_of(texts_of(piece.column("text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), values], names=["doc_id", "quality", "x"])


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **options) -> Trees:
    """Trees from at most ``max_rows`` labelled ids outside the held-out fold, the first by a hash of ``doc_id``.

    Labels without an id or a quality are left out, and equal ones count once. An id that several documents have gives one
    row for each quality, that of the least statistics, so reruns agree.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = named.filter(~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(_measured, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()  # max_rows at most
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r["quality"] > 0) for r in rows]), **options)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in opened(batches):
            for piece in slices(b, "text", 8 << 20):
                score = model.value.score(features_of(texts_of(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([piece.column(OWN), pa.array(score)], names=[OWN, "score"])

    return run


def scored_packed(docs: DataFrame, model: Trees, carried: list[str]) -> DataFrame:
    """``own``, a struct of the columns ``carried`` of every document, and ``score``, 0 to 1.

    Null and empty texts have the score of an empty text; rows that repeat an id are documents each; an empty table gives
    no rows.
    """
    rows = packed(docs, carried)
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), packed_with(rows, score=DoubleType()))


def scored(docs: DataFrame, model: Trees, carried: list[str] | None = None) -> DataFrame:
    """The columns ``carried`` (``doc_id``) and ``score_``: for names that do not clash."""
    carried = ["doc_id"] if carried is None else carried
    return scored_packed(docs, model, carried).select(*unpacked(carried), F.col("score").alias("score_"))


def op8_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= threshold).cast("int").alias("predicted"))

"""Counts of words, pairs of words, and runs of characters as sparse vectors, made in Arrow batches over a batch's distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.feature import RegexTokenizer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a vector, rows that are counted at once, and words that a worker remembers.
PLACES, STEP, REMEMBERED = 1 << 16, 512, 100_000
_VECTOR = pa.struct([pa.field("type", pa.int8(), False), ("size", pa.int32()), ("indices", pa.list_(pa.field("element", pa.int32(), False))), ("values", pa.list_(pa.field("element", pa.float64(), False)))])


def places(terms: list[str]) -> np.ndarray:
    """Where ``pyspark.ml``'s ``HashingTF`` counts each of ``terms``, which are ASCII: MurmurHash3 with seed 42."""
    out = np.zeros(len(terms), dtype=np.uint32)
    sizes = np.array([len(t) for t in terms], dtype=np.int64)
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    mixed = lambda k: turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        own = np.zeros((len(at), -(-n // 4) * 4), dtype=np.uint8)
        own[:, :n] = np.frombuffer("".join(terms[i] for i in at.tolist()).encode("ascii"), dtype=np.uint8).reshape(len(at), n)
        fours = own.view("<u4")
        h = np.full(len(at), 42, dtype=np.uint32)
        for k in range(n // 4):
            h = turn(h ^ mixed(fours[:, k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            h ^= mixed(fours[:, -1])
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return (out % PLACES).astype(np.int64)


def _runs(word: str) -> list[str]:
    """Runs of three to five characters of a word with a blank at either end; a shorter one is a run itself."""
    wide = f" {word} "
    return [wide[i : i + n] for n in (3, 4, 5) for i in range(max(len(word) + 3 - n, 1))]


def _of_words(words: list[str], known: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The places of each word and of its runs; ``known`` takes up to ``REMEMBERED`` words."""
    new = [w for w in words if w not in known]
    terms = [[w, *_runs(w)] for w in new]
    cuts = np.cumsum([len(t) for t in terms])[:-1] if terms else []
    made = dict(zip(new, np.split(places([t for own in terms for t in own]).astype(np.int32), cuts))) if new else {}
    out = [made[w] if w in made else known[w] for w in words]
    if len(known) < REMEMBERED:
        known.update((w, x.copy()) for w, x in made.items())
    return out


def counted(texts: pa.ListArray, known: dict[str, np.ndarray]) -> pa.StructArray:
    """A sparse vector for each list of words."""
    ends = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = texts.flatten().dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    own_places = _of_words(words, known)
    firsts = np.concatenate([[0], np.cumsum([len(x) for x in own_places])]).astype(np.int64)
    of_word = np.concatenate(own_places) if words else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    follows = np.flatnonzero(row[1:] == row[:-1])
    pairs, which = np.unique(ids[follows] * max(1, len(words)) + ids[follows + 1], return_inverse=True)
    of_pair = places([f"{words[p // len(words)]} {words[p % len(words)]}" for p in pairs.tolist()])[which]
    pair_ends = np.searchsorted(row[follows], np.arange(len(texts) + 1))
    indices, values, sizes = [], [], []
    for i in range(len(texts)):
        own, times = np.unique(ids[ends[i] : ends[i + 1]], return_counts=True)
        many = firsts[own + 1] - firsts[own]
        at = np.arange(many.sum()) + np.repeat(firsts[own] - np.cumsum(many) + many, many)
        sums = np.bincount(of_word[at], np.repeat(times, many), PLACES) + np.bincount(of_pair[pair_ends[i] : pair_ends[i + 1]], minlength=PLACES)
        here = np.flatnonzero(sums)
        indices.append(here.astype(np.int32))
        values.append(sums[here])
        sizes.append(len(here))
    cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x) if x else np.zeros(0, kind), arrow), type=t.type) for x, kind, arrow, t in ((indices, np.int32, pa.int32(), _VECTOR[2]), (values, np.float64, pa.float64(), _VECTOR[3]))]
    return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), PLACES, np.int32)), *lists], fields=list(_VECTOR))


@F.arrow_udf(VectorUDT())
def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo in range(0, len(batch), STEP):
            yield counted(batch.slice(lo, STEP), known)


class WordGrams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts a text's words of letters a-z and digits, pairs of neighbours, and runs of characters within words. Rows that have the
    output column are counted already."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getOutputCol() in dataset.columns:
            return dataset
        words = RegexTokenizer(inputCol=self.getInputCol(), outputCol="words_", pattern="[^a-z0-9]+").transform(dataset)
        return words.withColumn(self.getOutputCol(), _vectors(F.col("words_"))).drop("words_")

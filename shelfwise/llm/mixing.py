"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words, filled from a count of its documents by exact length: about the same part of each
length, then a bounded knapsack over what is left, by dynamic programming on a bitset. The copies of a length go to its
documents evenly, and those left over to the first in the order of a seeded hash: up to a cut, which is one row for each
source and length, so that every document can tell its copies from its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._store import OWN, broadcast_if, column, keep, opened, packed, packed_with, unpacked
from ._words import raw_bytes, texts_of

#: Places of the dynamic programme, at most: with longer budgets a place is several words.
PLACES = 1 << 24
#: Rows of a table of sources or cuts that are broadcast, at most; more are joined.
BROADCAST_ROWS = 200_000
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    data, offsets = raw_bytes(texts)
    word = ~_WHITE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    first[opens] = word[opens]
    sums = np.concatenate([[0], np.cumsum(first)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pa.array(word_counts(texts_of(b.column("text"))), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("row"), size], names=["doc_id", "source", "row", "size"])


def sizes_of(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``doc_id, source, row, size`` of every document (null text: 0 words); ``row`` tells documents of one id apart."""
    row = (F.lit(0) if row is None else row).cast("long").alias("row")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row, "text")
    return chosen.mapInArrow(_sized, "doc_id long, source string, row long, size long")


def _with_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in opened(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(word_counts(texts_of(b.column("text"))), pa.int64())], names=[OWN, "size"])


def targets_of(sizes: DataFrame, weights: Sequence[float], cap: float, share: float = 1.0) -> DataFrame:
    """``source, k, source_size, target`` for each source.

    Sources by code point, null last, have the weights in turn and share ``share`` of all words. Those whose part is above
    ``cap`` times their size are held there, and the rest is shared again by weight. Sources in ascending order of
    size over weight are held one after another, so two running sums over one row a source give the level of the rest.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    case = "element_at(array({}), CAST((k - 1) % {} + 1 AS INT))".format(", ".join(f"CAST({w!r} AS DOUBLE)" for w in weights), len(weights))
    return by.sparkSession.sql(
        f"""
        WITH ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM {{sources}}),
        weighed AS (SELECT *, {case} AS weight, CAST({cap!r} AS DOUBLE) * source_size AS most FROM ranked),
        summed AS (
          SELECT *, (sum(source_size) OVER () * CAST({share!r} AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D))
              / sum(weight) OVER (ORDER BY most / weight DESC, k DESC ROWS UNBOUNDED PRECEDING) AS level FROM weighed),
        levels AS (SELECT max(level) AS level FROM summed WHERE most / weight >= level)
        SELECT s.source, s.k, s.source_size, CASE WHEN l.level IS NULL OR s.most <= s.weight * l.level THEN CAST(s.most AS DOUBLE) ELSE s.weight * l.level END AS target
        FROM summed s CROSS JOIN levels l""",
        sources=by,
    )


def _knapsack(lengths: np.ndarray, free: np.ndarray, rest: int, order: list[int]) -> tuple[np.ndarray, int]:
    """How many of each length, at most ``free``, to take for as many words as can be up to ``rest``; the words missed.

    A table of ``PLACES`` holds any rest: where it is longer, a place is several words, and lengths are rounded to places
    downwards (the fullest of the choices that do not pass the rest counts) and upwards (none does). What the better one
    leaves open is fitted again with finer places, down to single words.
    """
    taken, free = np.zeros(len(lengths), dtype=np.int64), np.array(free, dtype=np.int64)
    while rest:
        unit = -(-(rest + 1) // PLACES)
        ways = [-(-lengths // unit)] if unit == 1 else [lengths // unit, -(-lengths // unit)]
        more = max((_placed(way, lengths, free, rest, rest // unit, order) for way in ways), key=lambda x: int((x * lengths).sum()))
        taken, free, rest = taken + more, free - more, rest - int((more * lengths).sum())
        if unit == 1 or not more.any():
            break
    return taken, rest


def _placed(lengths: np.ndarray, words: np.ndarray, free: np.ndarray, most: int, rest: int, order: list[int], tries: int = 64) -> np.ndarray:
    """The choice that fills most of ``rest`` places with ``most`` words at most, of the fullest ``tries`` ones; or nothing.

    Bit w of ``reach`` is set if some choice has w places; a length comes in parts of 1, 2, 4 ... documents. The step that
    first reached each number of places is held, not the bits before each step.
    """
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    first = np.zeros(rest + 1, dtype=np.int32)
    for i in order:
        left, part = min(int(free[i]), rest // int(lengths[i])) if lengths[i] else 0, 1
        while left > 0 and not reach >> rest & 1:
            part = min(part, left)
            new = (reach << (part * int(lengths[i]))) & mask & ~reach
            if new:
                first[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(steps)
                steps.append((i, part))
                reach |= new
            left, part = left - part, part * 2
        if reach >> rest & 1:
            break
    for _ in range(tries):
        taken, at = np.zeros(len(lengths), dtype=np.int64), reach.bit_length() - 1
        reach &= ~(1 << at)
        while at:
            i, part = steps[first[at]]
            taken[i] += part
            at -= part * int(lengths[i])
        if int((taken * words).sum()) <= most:
            break
    else:
        taken[:] = 0
    return taken


def _in_proportion(lengths: np.ndarray, counts: np.ndarray, budget: int, cap: int, order: list[int]) -> np.ndarray:
    """About the same part of every length, in a seeded order: each takes what brings the words taken up to the budget's part of
    the words met so far, so that what one length rounds off the next makes up, and little more than a document is left."""
    total, met, words = int((lengths * counts).sum()), 0, 0
    taken = np.zeros(len(lengths), dtype=np.int64)
    for i in order:
        n, size = int(counts[i]), int(lengths[i])
        met += n * size
        taken[i] = min(n * cap, max(0, (met * budget // total - words) // size))
        words += int(taken[i]) * size
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, cap: int = 1) -> np.ndarray:
    """How many copies of documents of each length to take so that their words come near to ``budget``, never above.

    There are ``counts`` documents of each length (above 0) and ``cap`` copies of each at most. A proportional part of every
    length is taken first and the rest is fitted; where that misses, some of the first part, from the shortest documents and
    from the longest, about as many words as five of the longest have, is given back and fitted with it; what still misses, as
    budgets of few lengths can, is fitted on top of the part that no length is short of. ``lengths`` ascend.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total * cap:
        return counts * cap
    order = np.random.default_rng(seed).permutation(len(lengths)).tolist()
    taken = _in_proportion(lengths, counts, budget, cap, order)
    rest = budget - int((taken * lengths).sum())
    more, missed = _knapsack(lengths, counts * cap - taken, rest, order)
    if missed:
        longest = int(lengths.max())
        fewer, room = taken.copy(), rest
        for enough, some in ((rest + 2 * longest, range(len(lengths))), (rest + 5 * longest, reversed(range(len(lengths))))):
            for i in some:
                back = min(int(fewer[i]), -(-max(0, enough - room) // int(lengths[i])))
                fewer[i] -= back
                room += back * int(lengths[i])
        again, left = _knapsack(lengths, counts * cap - fewer, room, order)
        if left < missed:
            taken, more, missed = fewer, again, left
    if missed:
        fewer = np.array([c * budget // total for c in counts.tolist()], dtype=np.int64)
        again, left = _knapsack(lengths, counts * cap - fewer, budget - int((fewer * lengths).sum()), order)
        if left < missed:
            return fewer + again
    return taken + more


def _fitted(seed: int, cap: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        copies = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]), seed + int(key[0]), cap)
        return pd.DataFrame({"k": rows["k"], "size": rows["size"], "whole": copies // rows["n"], "extra": copies % rows["n"]})

    return run


def _plan(rows: DataFrame, weights: Sequence[float], cap: int, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the cuts ``from, words, whole, h, id, at`` of each source and length.

    A document takes ``whole`` copies, and one more if its ``(hash, doc_id, row)`` is not after the cut. A length of one
    source, however many documents have it, is counted by 256 slices of the hash first, and only documents of the slice
    that the cut is in are numbered.
    """
    plan = keep(targets_of(rows, weights, float(cap), share), "mix-plan").withColumn("budget", F.expr("CAST(floor(target) AS LONG)"))
    sources = broadcast_if(plan.withColumnRenamed("source", "from"), BROADCAST_ROWS)
    known = rows.filter("size > 0").join(sources, rows["source"].eqNullSafe(sources["from"]))
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("slice", F.shiftright("h", 56))
    slices = keep(known.groupBy("k", "size", "slice").agg(F.count("*").alias("n"), F.first("budget").alias("budget")), "mix-slices")
    lengths = slices.groupBy("k", "size").agg(F.sum("n").alias("n"), F.first("budget").alias("budget"))
    fitted = keep(lengths.groupBy("k").applyInPandas(_fitted(seed, cap), "k int, size long, whole long, extra long"), "mix-fitted")
    before = "extra - coalesce(sum(n) OVER (PARTITION BY k, size ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS room"
    here = keep(slices.join(fitted, ["k", "size"]).selectExpr("k", "size", "slice", "n", before).filter("room BETWEEN 1 AND n").drop("n"), "mix-here")
    numbered = known.join(broadcast_if(here, BROADCAST_ROWS), ["k", "size", "slice"])
    numbered = numbered.selectExpr("k", "size", "h", "doc_id", "row", "room", "row_number() OVER (PARTITION BY k, size ORDER BY h, doc_id, row) AS place")
    last = numbered.filter("place = room").selectExpr("k", "size", "h", "doc_id AS id", "row AS at")
    cuts = fitted.join(plan.select("k", "source"), "k").join(last, ["k", "size"], "left")
    return plan, keep(cuts.selectExpr("source AS from", "size AS words", "whole", "h", "id", "at"), "mix-cuts")


def _copies(df: DataFrame, cuts: DataFrame, seed: int, source: Column, size: Column, doc_id: Column, row: Column) -> DataFrame:
    """``df`` with ``copies``. An id that is missing comes first, as in the order of the numbers."""
    h = F.xxhash64(F.lit(seed), doc_id)
    both = df.join(broadcast_if(cuts, BROADCAST_ROWS), source.eqNullSafe(F.col("from")) & (size == F.col("words")), "left")
    one = F.struct(h, doc_id, row) <= F.struct(F.col("h"), F.col("id"), F.col("at"))
    copies = F.when(F.col("h").isNull() | ~F.coalesce(one, F.lit(False)), F.col("whole")).otherwise(F.col("whole") + 1)
    return both.withColumn("copies", F.coalesce(copies, F.lit(0))).drop("from", "words", "whole", "h", "id", "at")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5.0, 2.0, 1.0), cap: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document; ``taken = copies * size``.

    ``copies`` is 0 to ``cap``. Documents without words take nothing; a null source is a source; rows that repeat an id are
    documents each. An empty table gives no rows; further columns are not looked at.
    """
    rows = keep(sizes_of(docs).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    plan, cuts = _plan(rows, weights, cap, share, seed)
    sources = broadcast_if(plan.select(F.col("source").alias("from_source"), "source_size", "target"), BROADCAST_ROWS)
    chosen = _copies(rows, cuts, seed, F.col("source"), F.col("size"), F.col("doc_id"), F.col("row"))
    chosen = chosen.join(sources, F.col("source").eqNullSafe(F.col("from_source")))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, row: str | None = None, *, weights: Sequence[float] = (5.0, 2.0, 1.0), cap: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it.

    Rows are told apart by ``doc_id``, or by a column ``row`` of whole numbers where ids repeat or are missing. Texts are
    not shuffled: each row finds the cut of its source and length.
    """
    at = F.lit(0) if row is None else column(row)
    _, cuts = _plan(keep(sizes_of(docs, at), "mix-sizes"), weights, cap, share, seed)
    rows = packed(docs, docs.columns)
    sized = rows.mapInArrow(_with_sizes, packed_with(rows, size=LongType()))
    at = F.lit(0) if row is None else F.col(OWN).getField(row)
    own = F.col(OWN)
    chosen = _copies(sized, cuts, seed, own["source"].cast("string"), F.col("size"), own["doc_id"].cast("long"), at.cast("long"))
    chosen = chosen.filter("copies > 0").select(OWN, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return chosen.select(*unpacked(docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

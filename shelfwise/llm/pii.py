"""Personal data: fixed patterns, and terms that reveal the entities that the patterns find.

A protected entity is the value of a span that a pattern finds. A term is a run of digits, ASCII letters (in lower case)
and characters beyond ASCII, of three characters at least, anywhere in a document that holds the entity, outside the
spans. Over the documents, a term discloses as much of an entity as their pointwise mutual information,
``log2(N * n_both / (n_entity * n_term))``, has of the entity's information, ``log2(N / n_entity)``: a term whose share
reaches ``alpha``, in ``support`` documents of the entity at least, is a span wherever it stands in a document of the
entity. ``sanitise`` removes terms that occur with the entity only, and puts a general word for the others.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keep
from ._words import hashes_of, mapped, slices, texts_of, words_of
from .decontaminate import _TABLE as _LEVEL

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # where a run of digits fails, so does every later start in it
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str) -> list[tuple[int, int]]:
    """Every start shares the next ``@`` with its neighbours, so one look back and one look ahead at each ``@`` do."""
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        ahead = _DOMAIN.match(text, at + 1) if start < at else None
        if ahead:
            out.append((start, ahead.end()))
            low = ahead.end()
        at = text.find("@", max(at + 1, low))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text) if m.end() - m.start() >= 13)
    return [s for s, d in found if 13 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds in order, by start within a kind; code points, end exclusive."""
    found = zip(KINDS, (emails(text), ips(text), cards(text), phones(text)), strict=True)
    return [(kind, s, e) for kind, spans in found for s, e in spans]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def entity_of(kind: str, value: str) -> int:
    level = value.translate(_LOWER) if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value)
    return _signed(xxhash.xxh3_64_intdigest(f"{kind}:{level}"))


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> dict[int, list[int]]:
    """Starts and ends in turn of every term that no base span overlaps, by the term's hash."""
    taken = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    places: dict[str, list[int]] = {}
    for m in _TERM.finditer(text):
        a, b = m.span()
        if b - a >= 3:
            i = bisect.bisect_left(starts, b) - 1
            if not (i >= 0 and reach[i] > a):
                places.setdefault(m[0].translate(_LOWER), []).extend((a, b))
    return {_signed(xxhash.xxh3_64_intdigest(t)): at for t, at in places.items()}


_FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, entities array<long>, free array<struct<t:long,at:array<int>>>"
_FREE = pa.list_(pa.struct([("t", pa.int64()), ("at", pa.list_(pa.int32()))]))


def _finder(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for piece in slices(b, "text", 8 << 20):
                texts = texts_of(piece.column("text"))
                hit = pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)
                n = len(texts)
                counts = {k: np.zeros(n, dtype=np.int64) for k in KINDS}
                base: list[list[str]] = [[] for _ in range(n)]
                entities: list[list[int]] = [[] for _ in range(n)]
                free: list[list[dict]] = [[] for _ in range(n)]
                for i in np.flatnonzero(hit).tolist():
                    text = texts[i].as_py()
                    spans = base_spans(text)
                    if not spans:
                        continue
                    for k, _, _ in spans:
                        counts[k][i] += 1
                    base[i] = [f"{k}:{s}:{e}" for k, s, e in spans]
                    entities[i] = sorted({entity_of(k, text[s:e]) for k, s, e in spans})
                    free[i] = [{"t": t, "at": at} for t, at in free_terms(text, spans).items()]
                columns = [pa.array(np.arange(row, row + n)), piece.column("doc_id"), *(pa.array(counts[k]) for k in KINDS), pa.array(base, pa.list_(pa.string())), pa.array(entities, pa.list_(pa.int64())), pa.array(free, _FREE)]
                names = ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "free"]
                row += n
                yield pa.RecordBatch.from_arrays(columns + [piece.column("text")] * with_text, names=names + ["text"] * with_text)

    return run


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, summed over what a task has seen so far; at most about a million terms are held."""
    held, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(times)], names=["t", "n"])

    for b in batches:
        for piece in slices(b, "text", 8 << 20):
            codes, distinct, counts = words_of(mapped(texts_of(piece.column("text")), _LEVEL))
            if not len(codes):
                continue
            pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * len(distinct) + codes)
            n = np.bincount(pairs % len(distinct), minlength=len(distinct))
            long_enough = pc.utf8_length(distinct).to_numpy(zero_copy_only=False) >= 3
            h = np.concatenate([held, hashes_of(distinct)[long_enough]])
            held, where = np.unique(h, return_inverse=True)
            times = np.bincount(where, weights=np.concatenate([times, n[long_enough]]), minlength=len(held)).astype(np.int64)
            if len(held) > 1_000_000:
                yield out()
                held, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield out()


def _classed(rows: DataFrame, of: str, kept: str) -> DataFrame:
    """``of, kept, c1, c2``: values of ``of`` that stand in the same rows, and have the same ``kept``, are one class."""
    both = [F.bit_xor(F.xxhash64("row")).alias("c1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("c2")]
    return rows.groupBy(of, kept).agg(*both)


def _disclosing(held: DataFrame, free: DataFrame, n: float, alpha: float, support: int) -> DataFrame:
    """``row, t, only``: terms of ``free`` (``row, t, n_t``) in documents of an entity of ``held`` (``row, e, n_e, most``) that tell enough of it.

    Entities that stand in the same documents count alike, and so do terms, so pairs are of classes: copies of a long list of
    contacts have one class of each. A pair in ``support`` documents is in one besides the entity's longest, so the longest
    document of an entity makes no pairs: only those that others made are looked up in it.
    """
    e, t = ["e1", "e2"], ["t1", "t2"]
    of_e = _classed(held, "e", "n_e").withColumnsRenamed({"c1": "e1", "c2": "e2"}).drop("n_e")
    of_t = _classed(free, "t", "n_t").withColumnsRenamed({"c1": "t1", "c2": "t2"}).drop("n_t")
    free = keep(free.join(of_t, "t"), "pii-term-classes")
    terms = keep(free.select("row", *t, "n_t").distinct(), "pii-terms-of-rows")
    sizes = terms.groupBy("row").agg(F.count("*").alias("terms"))
    entities = held.join(of_e, "e").select("row", *e, "n_e", "most").distinct().join(sizes, "row")
    entities = keep(entities, "pii-entities-of-rows")
    longest = entities.groupBy(*e).agg(F.max(F.struct("terms", "row"))["row"].alias("longest"))
    made = entities.join(longest, e) if support > 1 else entities.withColumn("longest", F.lit(-1).cast("long"))
    made = made.filter("row <> longest").join(terms, "row").filter("n_t <= most")
    pairs = keep(made.groupBy(*e, *t).agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).filter(F.col("n_et") >= support - 1), "pii-pairs")
    if support > 1:
        also = pairs.select(*e, *t).join(longest, e).join(terms.select(F.col("row").alias("longest"), *t), ["longest", *t], "left_semi").select(*e, *t, F.lit(1).alias("one"))
        pairs = pairs.join(also, [*e, *t], "left").withColumn("n_et", F.col("n_et") + F.coalesce("one", F.lit(0))).filter(F.col("n_et") >= support)
    told = pairs.withColumn("ic", F.log2(F.lit(n) / F.col("n_e"))).withColumn("pmi", F.log2(F.lit(n) * F.col("n_et") / F.col("n_e") / F.col("n_t")))
    told = keep(told.filter((F.col("ic") > 0) & (F.col("pmi") >= F.lit(alpha) * F.col("ic") - F.lit(1e-12))).select(*e, *t, (F.col("n_et") >= F.col("n_t")).alias("only")), "pii-told")
    marked = entities.select("row", *e).join(told, e).groupBy("row", *t).agg(F.max("only").alias("only"))
    return free.join(marked, ["row", *t]).select("row", "t", "only")


def find(docs: DataFrame, *, alpha: float = 0.8, support: int = 2, with_text: bool = False) -> DataFrame:
    """``row, doc_id``, the counts of base spans, ``base`` and ``terms`` (start, end, whether it occurs with the entity only).

    Null and empty texts have no spans. Rows that repeat an id are documents each. An empty table gives no rows. Very long texts
    are taken whole, in a piece of their own. Only ``doc_id`` and ``text`` are read, so other columns may have any names. An entity
    in fewer than ``support`` documents (2 at least) adds no spans: nothing can be said of what occurs with it.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = keep(chosen.mapInArrow(_finder(with_text), _FOUND + ", text string" * with_text), "pii-found")
    terms = keep(chosen.select("text").mapInArrow(_term_counter, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t")), "pii-terms")
    n = float(max(found.count(), 1))
    some = found.filter("size(base) > 0")
    held = some.select("row", F.explode("entities").alias("e"))
    owners = held.groupBy("e").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") < n))
    # n_et is n_e at most, so a term in more than ``most`` documents tells too little; 1e-9 is of the doubles
    owners = owners.withColumn("most", F.lit(n) * F.pow(F.col("n_e") / F.lit(n), F.lit(float(alpha))) * F.lit(1 + 1e-9))
    held = keep(held.join(owners, "e"), "pii-held")
    rows = held.groupBy("row").agg(F.max("most").alias("row_most"))
    free = some.select("row", "free").join(rows, "row").select("row", "row_most", F.explode("free").alias("x")).select("row", "row_most", "x.*")
    free = keep(free.join(terms.filter(F.col("n_t") >= support), "t").filter("n_t <= row_most").select("row", "t", "at", "n_t"), "pii-free")
    marked = _disclosing(held, free.select("row", "t", "n_t"), n, float(alpha), support)
    spans = free.join(marked, ["row", "t"]).selectExpr("row", "explode(transform(sequence(0, size(at) - 2, 2), i -> struct(at[i] AS s, at[i + 1] AS f, only))) AS x")
    spans = keep(spans.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("terms")), "pii-spans")
    return found.drop("free").join(spans, "row", "left").withColumn("terms", F.coalesce("terms", F.expr("CAST(array() AS array<struct<s:int,f:int,only:boolean>>)")))


def _sanitiser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, base, terms in zip(*(b.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
            marks = [(int(s), int(e), f"<{k.upper()}>") for k, s, e in (x.split(":") for x in base)]
            marks += [(t["s"], t["f"], "" if t["only"] else "<NUMBER>" if text[t["s"] : t["f"]].isdigit() else "<WORD>") for t in terms]
            parts, at = [], 0
            for s, e, word in sorted(marks):
                if s >= at:
                    parts += [text[at:s], word]
                at = max(at, e)
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` with every span replaced; of spans that overlap, the first stands for all.

    A null text stays null and an empty one empty; an empty table gives no rows; rows that repeat an id are documents each. Texts of
    any length are written anew whole. Other columns are not read, whatever their names.
    """
    return find(docs, with_text=True, **options).select("doc_id", "text", "base", "terms").mapInArrow(_sanitiser, "doc_id long, text string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.expr("array_join(concat(base, transform(terms, x -> concat('term:', x.s, ':', x.f))), ',')").alias("spans"),
    )

"""Near-duplicate documents by HyperMinHash.

A document's distinct five-word shingles fall into ``M`` buckets by the upper bits of their hashes. Each bucket keeps, of
its smallest hash, the number of leading zeros and ten bits after the first one: 16 bits. Empty buckets take the
register of another bucket, tried in a fixed order for each bucket, which leaves the chance of agreement at the
similarity for small sets too. Bands of registers give candidates; the share of equal registers, corrected for registers
that agree by accident, drops those far below the threshold; the others are decided on the full sets.

Documents of one shingle set are one class, and only classes are compared. Each bucket of a band has a hub, and all its
classes are compared with that, not with each other; a hub is the class that meets most others in buckets, and buckets
whose own hubs are much like a larger one's share that one. What the links found so far leave in different components
is told apart as follows, so that no pair that shares a bucket is lost and no group is squared:

* A bucket of at most ``BLOCK`` classes compares the registers of those of different components in one go; only
  plausible pairs leave it.
* The classes of a larger bucket have all been compared with its hub C on full sets. A class x has lost ``l`` of C's shingles
  and gained ``g`` others. Two classes u, v can be linked only if their common shingles, ``percent / (100 + percent)`` of
  ``nu + nv`` at least, are more than the ``nC - max(lu, lv)`` that they can have in common within C, so they have some
  number t of gained shingles in common; then, in one order, each has a common one among its first ``g - t + 1``. The order
  is rarest first, by a counting sketch of fixed size. Pairs with t below 1 show all that they gained; those that have
  none of it in common are within C, and as u is not linked to C, ``nC - lu`` is too small for a link unless v is smaller
  than C itself (and u too, where v is not linked to C). Such pairs are listed by their sizes. Before a pair is compared,
  marks of what either has lost (256 bits, so that differences are never overrated) raise the larger of lu and lv by what
  the other has lost besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keep, narrow, partitions_for
from ._words import hashes_of, mixed, sets_of, shingles_of, slices, texts_of, words_of
from .components import components

M, BANDS = 128, 32
ROWS = M // BANDS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Classes whose texts are fetched by a broadcast of their ids, at most; more are joined.
BROADCAST_ROWS = 500_000
#: Classes of a bucket that are compared by their registers in one go.
BLOCK = 128
#: Estimated percent from which on a bucket's hub gives way to a larger one's.
ALIKE = 85
#: Counters of the sketch, as a power of two, and the parts in which they are summed.
SKETCH_BITS, SKETCH_PARTS = 18, 16
#: Marks of what a class has lost of its hub's shingles: 64 bits each.
MARKS = ("m0", "m1", "m2", "m3")


def _tries(n: int = 4096) -> np.ndarray:
    """The bucket that an empty bucket (column) looks at in each try (row)."""
    with np.errstate(over="ignore"):
        h = mixed(np.arange(1, n * M + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return (h >> np.uint64(64 - 7)).astype(np.int64).reshape(n, M)


def registers_of(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The registers of ``n`` sets; hashes: the sorted distinct hashes of each set one after another, rows: their sets."""
    out = np.full(n * M, EMPTY, dtype=np.uint16)
    if len(hashes):
        key = rows * M + (hashes >> np.uint64(57)).astype(np.int64)
        first = np.concatenate([[True], key[1:] != key[:-1]])  # sorted: the first hash of a bucket is its smallest
        rest = hashes[first] << np.uint64(7)
        zeros = np.zeros(len(rest), dtype=np.int64)
        for s in (32, 16, 8, 4, 2, 1):
            small = rest < np.uint64(1 << (64 - s))
            zeros += np.where(small, s, 0)
            rest = np.where(small, rest << np.uint64(s), rest)
        mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out[key[first]] = (np.minimum(zeros, 57).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    out = out.reshape(n, M)
    source, tries = out.copy(), _tries()
    live = np.flatnonzero((out == EMPTY).any(axis=1) & (out != EMPTY).any(axis=1))
    for t in range(len(tries)):
        if not len(live):
            break
        part = out[live]
        part = np.where(part == EMPTY, source[live][:, tries[t]], part)
        out[live] = part
        live = live[(part == EMPTY).any(axis=1)]
    for i in live.tolist():
        out[i][out[i] == EMPTY] = source[i][source[i] != EMPTY][0]
    return out


def accidental(n: np.ndarray) -> np.ndarray:
    """Chance that two unlike registers agree, for sets of about ``n`` shingles: of equal leading zeros, one in 2**MANTISSA."""
    per = np.maximum(np.asarray(n, dtype=float) / M, 1e-3)[:, None]
    i = np.arange(0, 58)
    above = lambda k: 1 - (1 - 2.0**-k) ** per  # noqa: E731  at least k leading zeros
    p = above(i[None, :]) - above(i[None, :] + 1)
    return np.minimum((p**2).sum(axis=1) * 2.0**-MANTISSA, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for accidental agreement."""
    e = accidental((np.asarray(na) + np.asarray(nb)) / 2)
    return np.maximum(((a == b).mean(axis=1) - e) / (1 - e), 0)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow a similarity of ``percent`` and the estimate is not six standard errors below it."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    full = M * (1 - np.exp(-lo / M))  # registers that are not copies of others
    p = percent / 100
    return (100 * lo >= percent * hi) & (estimate(a, b, na, nb) >= p - 6 * np.sqrt(p * (1 - p) / np.maximum(full, 1)))


def _shingled(texts: pa.Array) -> list[np.ndarray]:
    codes, distinct, counts = words_of(pc.ascii_lower(texts))
    return sets_of(*shingles_of(hashes_of(distinct)[codes], counts))


def _set_id(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + np.uint64(0x51ED270B)))], dtype="<u8").tobytes()


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in slices(b, "text", 6 << 20):
            sets = _shingled(texts_of(piece.column("text")))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            regs = registers_of(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes), len(sets))
            ids = [_set_id(s) if len(s) else None for s in sets]
            held = pa.array([r.tobytes() if n else None for r, n in zip(regs, sizes.tolist(), strict=True)], pa.binary())
            columns = [piece.column("doc_id"), piece.column("h"), pa.array(sizes), pa.array(ids, pa.binary()), held]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "sid", "regs"])


def _setter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece in slices(b, "text", 6 << 20):
            sets = _shingled(texts_of(piece.column("text")))
            same = [len(s) > 0 and _set_id(s) == sid for s, sid in zip(sets, piece.column("sid").to_pylist(), strict=True)]
            kept = [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([piece.column("cid").filter(pa.array(same, pa.bool_())), lists], names=["cid", "shingles"])


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), M)


def _sieve(percent: int):
    """Keeps pairs that are plausible, and those of large buckets, whose full sets are needed anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = plausible(_table(b.column("ra")), _table(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy(), percent)
                ok |= b.column("large").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b", "large")], names=["a", "b", "large"])

    return run


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = 100 * estimate(_table(b.column("ra")), _table(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy()) >= percent
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def _bucket_pairs(percent: int):
    """Plausible pairs of classes of different components within each bucket; rows come by bucket.

    Pairs with the bucket's hub have been decided, and those whose largest hub is the same are for ``_in_large``.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        band, cid, label, n, hub, home = (rows.column(c).to_numpy() for c in ("band", "cid", "label", "n", "hub", "home"))
        regs = _table(rows.column("regs").combine_chunks())
        starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(band)], strict=True):
            x, y = np.triu_indices(hi - lo, 1)
            x, y = x + lo, y + lo
            open_ = (label[x] != label[y]) & (cid[x] != hub[x]) & (cid[y] != hub[y]) & ((home[x] != home[y]) | (home[x] < 0))
            open_ &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[open_], y[open_]
            if len(x):
                ok = plausible(regs[x], regs[y], n[x], n[y], percent)
                out.append((cid[x[ok]], cid[y[ok]]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in (0, 1))
        seen = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 4096:
                rows = pa.Table.from_batches(held)
                band = rows.column("band").to_numpy()
                last = len(band) - int((band[::-1] != band[-1]).argmax()) if band[0] != band[-1] else 0  # the last bucket may go on
                if last:
                    yield pairs(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _counters(hub: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(shingles.view(np.uint64) ^ mixed(hub.view(np.uint64))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for b in batches:
        gained, sizes = _flat(b.column("gained"))
        seen += np.bincount(_counters(np.repeat(b.column("hub").to_numpy(), sizes), gained), minlength=len(seen))
    if seen.any():
        parts = np.split(seen, SKETCH_PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["part", "seen"])


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype="<i8") for x in rows["seen"])
    return pd.DataFrame({"part": [key[0]], "seen": [total.tobytes()]})


def sketch_of(rows: DataFrame) -> np.ndarray:
    """How often each gained shingle of a hub occurs, by counters of a fixed number; several shingles can share one."""
    parts = rows.select("hub", "gained").mapInArrow(_sketcher, "part int, seen binary").groupBy("part").applyInPandas(_summed, "part int, seen binary").collect()
    seen = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.int64)
    for r in parts:
        seen[r["part"]] = np.frombuffer(r["seen"], dtype="<i8")
    return seen.ravel()


def _prefixes(sketch, percent: int):
    """The gained shingles that a class has to show to meet any other of its hub: rarest first, then by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hub, n, least, nc, lost = (b.column(c).to_numpy() for c in ("hub", "n", "least", "nc", "lost"))
            gained, sizes = _flat(b.column("gained"))
            other = np.maximum(least, -(-percent * n // 100))
            need = np.maximum(-(-percent * (n + other) // (100 + percent)) - nc + lost, 1)
            shown = np.clip(sizes - need + 1, 0, None)
            row = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((gained.view(np.uint64), sketch.value[_counters(hub[row], gained)], row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            use = place <= shown[row]
            row, place, gained = row[use], place[use], gained[by][use]
            names = ["hub", "cid", "n", "nc", "lost", *MARKS, "label", "loose"]
            columns = [b.column(c).take(pa.array(row)) for c in names]
            names += ["g", "s", "place"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[row]), pa.array(gained), pa.array(place)], names=names)

    return run


def _sieved(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    known = classes.select("cid", "n", "regs")
    wide = pairs.join(known.selectExpr("cid AS a", "n AS na", "regs AS ra"), "a").join(known.selectExpr("cid AS b", "n AS nb", "regs AS rb"), "b")
    wide = wide.filter(f"large OR 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return narrow(keep(wide.select("a", "b", "large", "na", "nb", "ra", "rb").mapInArrow(_sieve(percent), "a long, b long, large boolean"), "dup-pairs"))


def _decided(some: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``a, b, large, na, nb, common, linked, gained`` of pairs of classes, on the full sets of one document of each class.

    ``gained`` is what b has and a has not, for pairs of large buckets only, and ``m0`` to ``m3`` are marks of what a has and b
    has not: bits that are set for its hashes. A class's document is found by id and a hash of
    its text, so rows that repeat an id, or have none, meet their own class only.
    """
    wanted = some.selectExpr("a AS cid").unionByName(some.selectExpr("b AS cid")).distinct().join(classes.select("cid", "sid", "rep.doc_id", "rep.h"), "cid")
    wanted = narrow(keep(wanted.withColumnsRenamed({"doc_id": "rep_id", "h": "rep_h"}), "dup-wanted"))
    by = docs["doc_id"].eqNullSafe(wanted["rep_id"]) & (docs["h"] == wanted["rep_h"])
    texts = docs.join(F.broadcast(wanted), by) if wanted.count() <= BROADCAST_ROWS else docs.join(wanted, by)
    sets = keep(texts.select("cid", "sid", "text").mapInArrow(_setter, "cid long, shingles array<long>").dropDuplicates(["cid"]), "dup-sets")
    both = some.join(sets.selectExpr("cid AS a", "shingles AS sa"), "a").join(sets.selectExpr("cid AS b", "shingles AS sb"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long")).withColumn("na", F.size("sa").cast("long")).withColumn("nb", F.size("sb").cast("long"))
    both = both.withColumn("linked", F.expr(f"100 * common >= {percent} * (na + nb - common)")).withColumn("gained", F.expr("IF(large, array_except(sb, sa), NULL)"))
    both = both.withColumn("lost", F.expr("IF(large, array_except(sa, sb), NULL)"))
    mark = "aggregate(lost, 0L, (m, x) -> m | IF(shiftrightunsigned(x, 6) % 4 = {i}, shiftleft(1L, CAST(x & 63 AS int)), 0L)) AS m{i}"
    return keep(both.selectExpr("a", "b", "large", "na", "nb", "common", "linked", "gained", *(mark.format(i=i) for i in range(4))), "dup-tested")


def _in_large(tested: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of one large bucket's hub that can be linked and are in different components so far."""
    of = lambda side: labels.selectExpr(f"node AS {side}", f"label AS label_{side}")
    big = tested.filter("large").join(of("a"), "a", "left").join(of("b"), "b", "left")
    big = big.selectExpr("a AS hub", "b AS cid", "nb AS n", "na AS nc", "na - common AS lost", "gained", *MARKS, "coalesce(label_b, b) AS label", "coalesce(label_b, b) <> coalesce(label_a, a) AS loose")
    hubs = big.groupBy("hub").agg(F.min("n").alias("least"), F.max("loose").alias("some")).filter("some").drop("some")
    big = keep(big.join(hubs, "hub"), "dup-large")
    sketch = big.sparkSession.sparkContext.broadcast(sketch_of(big))
    kind = "hub long, cid long, n long, nc long, lost long, m0 long, m1 long, m2 long, m3 long, label long, loose boolean, g long, s long, place long"
    shown = keep(big.mapInArrow(_prefixes(sketch, percent), kind), "dup-shown")
    met = keep(shown.groupBy("hub", "s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("hub", "s"), "dup-met")
    shown = keep(shown.join(met, ["hub", "s"]), "dup-shared")
    apart = f"u.hub = v.hub AND u.cid <> v.cid AND u.label <> v.label AND 100 * least(u.n, v.n) >= {percent} * greatest(u.n, v.n)"
    only = lambda x, y: " + ".join(f"bit_count({x}.{m} & ~{y}.{m})" for m in MARKS)  # noqa: E731  lost by x and not by y, at least so many
    within = f"u.nc - greatest(u.lost + {only('v', 'u')}, v.lost + {only('u', 'v')})"  # what u and v can have in common of the hub's shingles
    room = f"{percent} * (u.n + v.n) <= {100 + percent} * ({within} + 1 + least(u.g - u.place, v.g - v.place))"
    far = shown.filter("loose").alias("u").join(shown.alias("v"), F.expr(f"u.s = v.s AND {apart} AND {room}"))
    fewest = f"greatest(least, CAST(ceil({percent} * n / 100) AS long))"
    slim = keep(big.drop("gained").filter(f"{percent} * (n + {fewest}) <= {100 + percent} * (nc - lost)"), "dup-slim")
    smaller = "v.n < v.nc AND (NOT v.loose OR u.n < u.nc)"
    near = slim.filter("loose").alias("u").join(slim.filter("n < nc").alias("v"), F.expr(f"{apart} AND {smaller} AND {percent} * (u.n + v.n) <= {100 + percent} * ({within})"))
    ordered = ("least(u.cid, v.cid) AS a", "greatest(u.cid, v.cid) AS b")
    return far.selectExpr(*ordered).unionByName(near.selectExpr(*ordered)).distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    A document without words (null, empty or white text) has an empty set and is linked with nothing. A document without
    an id takes part; it is kept only if its component has no id at all. Rows that repeat an id are documents each, and
    rows of the component's smallest id are all kept. An empty table gives no rows; further columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = keep(docs.mapInArrow(_signer, "doc_id long, h long, n long, sid binary, regs binary"), "dup-signed")
    classes = signed.filter("n > 0").groupBy("sid")
    classes = classes.agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("regs").alias("regs"))
    classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()), "dup-classes")
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("regs", b * width + 1, width)) for b in range(BANDS)))
    bands = classes.select("cid", F.explode(keys).alias("band"))
    shared = keep(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "dup-bands")
    members = keep(bands.join(shared, "band"), "dup-members")
    known = members.groupBy("cid").agg(F.sum("size").alias("met"))
    top = F.max(F.struct("met", (-F.col("cid")).alias("minus")))
    centres = keep(members.join(known, "cid").groupBy("band").agg(top.alias("top")).selectExpr("band", "-top.minus AS centre", "top.met AS met"), "dup-centres")
    # a centre that is much like that of a larger bucket of its own gives way to it
    own = members.select("band", "cid").join(centres.selectExpr("centre AS cid").distinct(), "cid")
    best = own.join(centres, "band").groupBy("cid").agg(F.max(F.struct("met", (-F.col("centre")).alias("minus"))).alias("top")).selectExpr("cid AS a", "-top.minus AS b").filter("a <> b")
    regs = classes.select("cid", "n", "regs")
    wide = best.join(regs.selectExpr("cid AS a", "n AS na", "regs AS ra"), "a").join(regs.selectExpr("cid AS b", "n AS nb", "regs AS rb"), "b")
    moved = keep(wide.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_alike(ALIKE), "a long, b long"), "dup-moved").selectExpr("a AS centre", "b AS hub")
    hubs = keep(centres.join(moved, "centre", "left").selectExpr("band", "coalesce(hub, centre) AS hub", "hub IS NOT NULL AS moved"), "dup-hubs")
    members = members.join(hubs, "band")
    stars = members.filter("cid <> hub").groupBy(F.col("hub").alias("a"), F.col("cid").alias("b")).agg(F.max(F.col("size") > BLOCK).alias("large"))
    tested = _decided(_sieved(stars, classes, percent), classes, docs, percent)
    labels = narrow(keep(components(tested.filter("linked").select("a", "b")), "dup-labels"))
    told = members.filter(f"size <= {BLOCK} AND (size > 2 OR moved)").select("band", "cid", "hub").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    with_large = tested.filter("large").select("a", "b")
    sizes = with_large.groupBy("a").agg(F.count("*").alias("k"))
    homes = with_large.join(sizes, "a").groupBy(F.col("b").alias("cid")).agg(F.max(F.struct("k", "a")).alias("x")).selectExpr("cid", "x.a AS home")
    told = told.withColumn("label", F.coalesce("label", "cid")).join(keep(homes, "dup-homes"), "cid", "left").withColumn("home", F.coalesce("home", F.lit(-1)))
    told = keep(told, "dup-told")
    open_ = keep(told.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band"), "dup-open")
    rows = told.join(open_, "band").join(regs, "cid").select("band", "cid", "label", "n", "hub", "home", "regs")
    dealt = rows.repartition(partitions_for(docs.sparkSession), "band").sortWithinPartitions("band")
    pairs = dealt.mapInArrow(_bucket_pairs(percent), "a long, b long").unionByName(_in_large(tested, labels, percent)).distinct().withColumn("large", F.lit(False))
    rest = _decided(_sieved(pairs, classes, percent), classes, docs, percent).filter("linked").select("a", "b")
    labels = narrow(keep(components(labels.selectExpr("node AS a", "label AS b").unionByName(rest)), "dup-labels"))
    named = classes.select("cid", "sid", "least").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = keep(named.groupBy("label").agg(F.min("least").alias("component_id")), "dup-least")
    by_class = keep(keep(named, "dup-named").join(least, "label").select("sid", "component_id"), "dup-by-class")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(by_class, "sid", "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s, least(len(w), 5) AS k
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN least_of l USING (doc_id)
"""

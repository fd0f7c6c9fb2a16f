"""Exact top-k by integer inner product: a Voronoi join of queries and data over pivots.

Data are grouped by their nearest pivot; a group's summary is its number of vectors and the largest distance of one to the
pivot. Queries are grouped by pivots of their own. With pivot p and radius r, every inner product of a query q with a group
lies within ``q.p - |q| r .. q.p + |q| r``: the lower ends, taken with the groups' sizes, give a score that the k-th best of
q reaches for sure, and so do its scores with the sampled vectors. The least of them over a query group Q, with pivot s and
radius t, is Q's bound: a data group is needed there only if ``s.p + t |p| + |s| r + t r`` reaches it, and of a group
that is needed only those vectors x are sent for which ``s.x + t |x|`` and ``max |q| |x|`` do. Each query group is solved
in pieces of what was sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep

#: Vectors in a piece and queries in a group, about: a task holds no more of either.
PIECE, QUERIES = 8192, 2048
#: Query groups that vectors are dealt to in one pass over them; the driver holds no more at once.
GROUPS = 4096
OUT = "own long, query_id long, vec_id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    for i, (lo, n) in enumerate(zip(offsets[:-1] - offsets[0], sizes, strict=True)):
        out[i, :n] = flat[lo : lo + n]
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where no sum can leave their exact range, else in integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if largest < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if largest < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: score descending, smaller id first."""
    if len(s) > 4 * k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= edge)
        if len(at) > 64 * k:  # ties at the edge: only the smallest ids of them can count
            over, tied = at[s[at] > edge], at[s[at] == edge]
            at = np.concatenate([over, tied[np.argpartition(ids[tied], k)[:k]]])
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))][:k]


@np.errstate(over="ignore", invalid="ignore")  # components may be of any size: what has no finite distance is the farthest
def farthest(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the points, each the farthest from those before it."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = np.maximum((m**2).sum(axis=1)[:, None] - 2 * (m @ pivots.T) + (pivots**2).sum(axis=1)[None, :], 0)
    near = d2.argmin(axis=1)
    return near, np.sqrt(((m - pivots[near]) ** 2).sum(axis=1))


@np.errstate(over="ignore")
def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m**2).sum(axis=1))


@dataclass
class Cells:
    """Groups of data that have vectors: pivots, sizes, radii."""

    pivots: np.ndarray
    index: np.ndarray
    size: np.ndarray
    radius: np.ndarray

    def sure(self, m: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that its k-th best reaches, by the groups' lower ends; the query itself may be among them."""
        mid, reach = m @ self.pivots[self.index].T, lengths(m)[:, None] * self.radius[None, :]
        low = mid - reach - 1e-9 * (np.abs(mid) + reach) - 1e-6
        order = np.argsort(-low, axis=1)
        held = np.cumsum(self.size[order], axis=1) >= k + 1
        at = np.where(held.any(axis=1), held.argmax(axis=1), 0)
        return np.where(held.any(axis=1), np.take_along_axis(low, order, axis=1)[np.arange(len(m)), at], -np.inf)


@dataclass
class Groups:
    """Query groups: pivots, radii, the least score to reach, and the longest query."""

    pivots: np.ndarray
    radius: np.ndarray
    bound: np.ndarray
    longest: np.ndarray

    @np.errstate(over="ignore", invalid="ignore")
    def need_cells(self, cells: Cells) -> np.ndarray:
        """Whether a query group (row) needs a data group (column). What overflows doubles is needed."""
        p = cells.pivots[cells.index]
        mid = self.pivots @ p.T
        slack = self.radius[:, None] * lengths(p)[None, :] + lengths(self.pivots)[:, None] * cells.radius[None, :] + self.radius[:, None] * cells.radius[None, :]
        return ~(mid + slack + 1e-9 * (np.abs(mid) + slack) + 1e-6 < self.bound[:, None])

    def need(self, m: np.ndarray) -> np.ndarray:
        """Whether a query group (column) needs a vector (row)."""
        mid, own = m @ self.pivots.T, lengths(m)
        slack = own[:, None] * self.radius[None, :]
        most = np.fmin(mid + slack + 1e-9 * (np.abs(mid) + slack), own[:, None] * self.longest[None, :] * (1 + 1e-9)) + 1e-6
        return ~(most < self.bound[None, :])


def _assigner(pivots: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, far = nearest(_matrix(b.column("v"), dim), pivots)
                yield pa.RecordBatch.from_arrays([b.column("own"), b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(far)], names=["own", "id", "v", "cell", "far"])

    return run


def _bounder(pivots: np.ndarray, cells: Cells, points: np.ndarray, dim: int, k: int):
    """The group of each query, and the score that its k-th best reaches for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"), dim)
            near, far = nearest(m, pivots)
            sure = cells.sure(m, k)
            if len(points) > k:
                s = np.nan_to_num(m @ points.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                held = np.partition(s, len(points) - k - 1, axis=1)[:, len(points) - k - 1]
                sure = np.fmax(sure, held - 1e-9 * lengths(m) * lengths(points).max() - 1e-6)
            columns = [b.column("own"), b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(far), pa.array(sure), pa.array(lengths(m))]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "id", "v", "cell", "far", "sure", "norm"])

    return run


def _router(groups: Groups, cells: Cells, dim: int, first: int):
    """A copy of each vector for each query group that needs it; groups are numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((len(groups.pivots), len(cells.pivots)), dtype=bool)
        pairs[:, cells.index] = groups.need_cells(cells)
        for b in batches:
            if not b.num_rows:
                continue
            m, cell = _matrix(b.column("v"), dim), b.column("cell").to_numpy()
            needed = pairs[:, cell].T & groups.need(m)
            for g in np.flatnonzero(needed.any(axis=0)).tolist():
                at = pa.array(np.flatnonzero(needed[:, g]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("own", "id", "v")), pa.array(np.full(len(at), first + g, np.int32))], names=["own", "id", "v", "grp"])

    return run


def _solver(dim: int, k: int):
    def run(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"own": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        v, q = np.stack(data["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        ids, names = data["id"].to_numpy(), asked["id"].to_numpy()
        keys, owns = data["own"].to_numpy(), asked["own"].to_numpy()
        parts = []
        for lo in range(0, len(q), 256):
            table = scores(q[lo : lo + 256], v)
            for i, s in enumerate(table):
                at = best(ids, s, k + 1)
                at = at[keys[at] != owns[lo + i]][:k]
                parts.append(pd.DataFrame({"own": owns[lo + i], "query_id": names[lo + i], "vec_id": ids[at], "score": s[at]}))
        return pd.concat(parts, ignore_index=True)

    return run


@dataclass
class Routed:
    """Copies of data and queries by query group and piece, and what they were dealt by: query groups in blocks of ``GROUPS``."""

    data: DataFrame
    asked: DataFrame
    cells: Cells
    groups: list[Groups]
    dim: int


def _sampled(rows: DataFrame, dim: int, sample: int) -> np.ndarray:
    some = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "own").limit(sample).select("v").collect()]
    points = np.zeros((len(some), dim))
    for i, v in enumerate(some):
        points[i, : len(v)] = v
    return points


def routed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, pivots: int | None = None, sample: int = 4096) -> Routed | None:
    """What each query group gets; None without vectors or queries. See ``top_k``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    whole = f"transform(v, x -> CASE WHEN abs({scale}D * x) < 9e15 THEN CAST(floor({scale}D * x) AS double) ELSE {scale}D * x END)"
    rows = keep(rows.withColumn("v", F.expr(whole)).withColumn("own", F.monotonically_increasing_id()), "knn-rows")
    asked = rows.filter(f"id % {every} = 0")
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first()
    if not n_queries or not dim:
        return None
    points = _sampled(rows, dim, sample)
    centres = farthest(points, pivots or min(len(points), max(16, int(n**0.5 / 4))))
    grouped = keep(rows.mapInArrow(_assigner(centres, dim), "own long, id long, v array<double>, cell int, far double"), "knn-cells")
    own = sorted((r["cell"], r["n"], r["far"]) for r in grouped.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect())  # one row a pivot
    cells = Cells(centres, *(np.array(x) for x in zip(*own, strict=True)))
    heads = farthest(_sampled(asked, dim, sample), -(-n_queries // QUERIES))
    told = asked.mapInArrow(_bounder(heads, cells, points, dim, k), "own long, id long, v array<double>, cell int, far double, sure double, norm double")
    told = keep(told, "knn-asked")
    parts = told.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    told = told.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("own", F.lit(1)), F.col("parts")).cast("int"))  # one row a pivot
    by_group = F.row_number().over(Window.orderBy("cell", "part")) - 1  # one row a query group
    summary = told.groupBy("cell", "part").agg(F.max("far").alias("far"), F.min("sure").alias("sure"), F.max("norm").alias("norm")).withColumn("grp", by_group)
    summary = keep(summary, "knn-groups")
    pad = f"CASE WHEN size(v) = {dim} THEN v ELSE concat(v, array_repeat(0D, {dim} - size(v))) END AS v"
    data, asked, blocks = [], [], []
    for lo in range(0, summary.count(), GROUPS):
        some = sorted(tuple(r) for r in summary.filter(F.col("grp").between(lo, lo + GROUPS - 1)).collect())  # GROUPS rows at most
        groups = Groups(heads[[c for c, *_ in some]], *(np.array([x[i] for x in some]) for i in (2, 3, 4)))
        sizes = groups.need_cells(cells) @ cells.size
        known = vectors.sparkSession.createDataFrame([(c, p, lo + g, max(1, -(-int(sizes[g]) // PIECE))) for g, (c, p, *_) in enumerate(some)], "cell int, part int, grp int, pieces int")
        asked.append(told.join(F.broadcast(known), ["cell", "part"]).selectExpr("own", "id", pad, "grp", "explode(sequence(0, pieces - 1)) AS piece"))
        sent = grouped.mapInArrow(_router(groups, cells, dim, lo), "own long, id long, v array<double>, grp int")
        data.append(sent.join(F.broadcast(known.select("grp", "pieces")), "grp").selectExpr("own", "id", pad, "grp", "CAST(pmod(xxhash64(own), pieces) AS int) AS piece"))
        blocks.append(groups)
    return Routed(reduce(DataFrame.unionByName, data), reduce(DataFrame.unionByName, asked), cells, blocks, dim)


def top_k(vectors: DataFrame, *, k: int = 10, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` best other rows.

    Components become ``floor(scale * x)``, x as double. Vectors that are null, or hold null or non-finite components,
    and rows without an id take no part; shorter vectors are padded with zeros; an empty table gives no rows. Ties go to the
    smaller id. Rows have keys of their own: those that repeat an id are queries and candidates each, and a query leaves
    out its own row only. Scores are exact; one that no long can hold becomes the nearest that it can, and such ones tie.

    Query groups are taken ``GROUPS`` at a time, each block in a pass over the vectors, so nothing in the driver or in a
    broadcast grows with the queries.

    Pivots are farthest-first choices from a sample of at most ``sample`` vectors, a quarter of the root of all rows in
    number unless given; every vector is in a group. A query group has about ``QUERIES`` queries, and what it is sent is
    cut into pieces of about ``PIECE`` vectors by a hash of the row, so no task holds a large group.
    """
    found = routed(vectors, k=k, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    key = ["grp", "piece"]
    best_ = found.data.groupBy(*key).cogroup(found.asked.groupBy(*key)).applyInPandas(_solver(found.dim, k), OUT)
    ranked = best_.selectExpr("query_id", "row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)  # Spark keeps k rows of a query in each task before it shuffles


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Prefix trie of conversations, by heavy-path decomposition.

A node is a distinct sequence of turns that some conversation starts with; the root is the empty sequence. Every node has a
key: its depth and the exclusive or, over its turns, of a 128-bit hash of (place, turn). Such keys have partial forms, so a
conversation of any length is cut into slices whose keys are combined afterwards.

Each node's heavy child is the one with the most conversations (ties: the one with the smallest conversation). Heavy children
form paths, one for each leaf. A light child has at most half of its parent's conversations, so that above any node are at
most log2(conversations) light ones: the paths' totals reach the root in as many rounds, of a join and a sum each. Totals
within a path are suffix sums over its slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep, new_path, partitions_for

#: Turns of a conversation, and nodes of a path, that one task sorts together.
SLICE = 1024
#: Characters of ids that are hashed at a time.
CHUNK = 1 << 20
#: Characters of a text that order turns of equal place and role.
TIE_CHARS = 32
KEY = ["depth", "x1", "x2"]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, chars``: the turns of each conversation, numbered from 1.

    Order: ``turn``, null first; turns that tie by role, then the first ``TIE_CHARS`` characters of the text, then a digest of
    both. Rows that repeat a turn are turns each. A null role or text is an empty one. Rows without ``conv_id`` belong to no
    conversation and are left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(role, 1, TIE_CHARS).alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("start"), digest.alias("digest"), F.length(text).cast("long").alias("chars"),
    )
    narrow = keep(narrow, "trie-turns")
    order = [F.col("turn").asc_nulls_first(), "role", "start", "digest"]
    cut = narrow.repartitionByRange(partitions_for(narrow.sparkSession), "conv_id", *order)
    cut = keep(cut.withColumn("part", F.spark_partition_id()), "trie-cut")
    counts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spread = counts.select("conv_id", "part", before.alias("before")).filter("before IS NOT NULL")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")
    numbered = cut.select("conv_id", "part", own.alias("own"), "digest", "chars").join(spread, ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "chars")


def _sliced(rows: DataFrame, group: str, descending: bool, sums: dict[str, tuple]) -> DataFrame:
    """Running totals along ``depth`` in each ``group``: by slices of ``SLICE`` depths, and by slices' totals where a group has several.

    ``sums`` has (column, aggregate function, how two totals are combined) for each new column.
    """
    sign = -1 if descending else 1
    rows = rows.withColumn("slice", F.floor(F.col("depth") / SLICE).cast("long"))
    inside = Window.partitionBy(group, "slice").orderBy((F.col("depth") * sign).asc()).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *(f(x).over(inside).alias(name) for name, (x, f, _) in sums.items()))
    longer = rows.groupBy(group).agg(F.min("slice").alias("lo"), F.max("slice").alias("hi")).filter("lo < hi").select(F.col(group).alias("of"))
    totals = rows.join(longer, F.col(group) == F.col("of"), "left_semi").groupBy(group, "slice").agg(*(f(x).alias(f"{name}_") for name, (x, f, _) in sums.items()))
    ahead = Window.partitionBy(group).orderBy((F.col("slice") * sign).asc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "slice", *(f(f"{name}_").over(ahead).alias(f"{name}_") for name, (_, f, _) in sums.items()))
    joined = running.join(totals, [group, "slice"], "left")
    new = {name: F.when(F.col(f"{name}_").isNull(), F.col(name)).otherwise(both(F.col(name), F.col(f"{name}_"))) for name, (_, _, both) in sums.items()}
    return joined.withColumns(new).drop("slice", *(f"{name}_" for name in sums))


def _chains(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth, the root's too: the node's key, its parent's, and whether the conversation ends there."""
    g1, g2 = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth")
    hashed = turns.select("conv_id", "depth", "chars", g1.alias("g1"), g2.alias("g2"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"))
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("last"))
    ends = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(0).cast("long")).alias("depth"), F.lit(True).alias("ends"))
    xor = lambda a, b: a.bitwiseXOR(b)
    keyed = _sliced(root.unionByName(hashed), "conv_id", False, {"x1": (F.col("g1"), F.bit_xor, xor), "x2": (F.col("g2"), F.bit_xor, xor)})
    return keyed.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "x1", "x2", xor(F.col("x1"), F.col("g1")).alias("p1"), xor(F.col("x2"), F.col("g2")).alias("p2"), "chars", F.coalesce("ends", F.lit(False)).alias("ends")
    )


def _parent(prefix: str = "") -> list[Column]:
    """The key of a node's parent, under the names of a key."""
    return [(F.col(prefix + "depth") - 1).alias("depth"), F.col(prefix + "p1").alias("x1"), F.col(prefix + "p2").alias("x2")]


def _nodes(chains: DataFrame) -> DataFrame:
    """A row for each node, with its number of children, its parent's conversation, and whether it is a light child."""
    counted = chains.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    counted = keep(counted, "trie-counted")
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("less")))
    kids = counted.filter("depth > 0").select(*_parent(), "n_convs", "conv_id").groupBy(*KEY).agg(F.count("*").alias("n_children"), (-largest["less"]).alias("heavy"))
    nodes = keep(counted.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("favoured")).filter("favoured IS NOT NULL")
    linked = nodes.drop("heavy").join(above, ["depth", "p1", "p2"], "left")
    return linked.withColumn("light", F.col("parent_conv_id").isNotNull() & (F.col("favoured") != F.col("conv_id"))).drop("favoured")


def _on_paths(chains: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node once, with the conversation of the leaf that its heavy path ends in (``path``); and ``path, top, level`` of each path."""
    leaves = nodes.filter("n_children = 0").select("conv_id")
    steps = chains.join(leaves, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), *KEY)
    steps = keep(steps.join(nodes, KEY), "trie-steps")
    light = F.when(F.col("light"), F.col("depth"))
    paths = keep(steps.groupBy("path").agg(F.coalesce(F.max(light), F.lit(0).cast("long")).alias("top"), F.count(light).alias("level")), "trie-paths")
    return keep(steps.join(paths, "path").filter("depth >= top"), "trie-placed"), paths


def _light_totals(placed: DataFrame) -> DataFrame | None:
    """Leaves and saved characters below the light children of each node that has some; a round for each level of paths."""
    spark = placed.sparkSession
    own = placed.groupBy("path").agg(F.sum("own").alias("saved"))
    tops = placed.filter("depth = top AND level > 0").select("path", "level", *_parent())
    at = tops.join(placed.select(*KEY, F.col("path").alias("parent_path")), KEY).join(own, "path")
    where = new_path(spark, "trie-light")
    at.write.partitionBy("level").parquet(where)
    levels = placed.agg(F.max("level")).first()[0] or 0
    if not levels:
        return None
    light = spark.read.schema(at.schema).parquet(where)
    done: list[DataFrame] = []
    for level in range(levels, 0, -1):
        here = light.filter(F.col("level") == level).withColumn("leaves", F.lit(1).cast("long"))
        if done:
            below = done[-1].groupBy(F.col("parent_path").alias("path")).agg(F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))
            here = here.join(below, "path", "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in ("saved", "leaves")})
        done.append(keep(here.select(*KEY, "parent_path", "saved", "leaves"), "trie-round"))
    return reduce(DataFrame.unionByName, done).groupBy(*KEY).agg(F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas into pieces of about ``CHUNK`` characters of one node each."""
    key, first, ids, size = None, 0, [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True)) | {"first": first, "piece": ",".join(ids)}])

    for batch in batches:
        for *new, conv_id in zip(*(batch.column(c).to_pylist() for c in [*KEY, "conv_id"]), strict=True):
            if ids and (new != key or size >= CHUNK):
                yield closed()
                ids, size = [], 0
            if not ids:
                key, first = new, conv_id
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
    if ids:
        yield closed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece at a time."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *new, piece in zip(*(batch.column(c).to_pylist() for c in [*KEY, "piece"]), strict=True):
            if new != key:
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = new, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True)) | {"ends_sha256": digest.hexdigest()}])


def _end_digests(chains: DataFrame) -> DataFrame:
    """A SHA-256 is one chain over its bytes: the ids of a node are sorted and written out by many tasks, and only the hashing of
    what they wrote is one task's work, piece by piece."""
    ends = chains.filter("ends").select(*KEY, "conv_id")
    n = partitions_for(chains.sparkSession)
    types = "depth long, x1 long, x2 long, "
    pieces = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_chunks, types + "first long, piece string")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "piece").mapInArrow(_digests, types + "ends_sha256 string")


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations ``convs`` (distinct ``conv_id``) with turns ``conv_id, depth, digest, chars``, depths from 1 without gaps.

    One row a node: ``conv_id`` (smallest conversation that starts with it), ``depth, parent_conv_id`` (null at the root),
    ``n_convs, n_children, n_leaves, saved_tokens`` (characters of last turns that need not be stored or computed again, summed
    over the subtree), ``ends_sha256`` of the ids that end there, and ``path``, the conversation of the leaf at the end of its
    heavy path. Without conversations there are no nodes. The working tables of the result stay until the session ends.
    """
    chains = keep(_chains(turns, convs), "trie-chains")
    nodes = keep(_nodes(chains), "trie-linked")
    steps, paths = _on_paths(chains, nodes)
    placed = steps.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    light = _light_totals(placed)
    zero = F.lit(0).cast("long")
    with_light = placed.join(light, KEY, "left") if light is not None else placed.withColumns({"saved_": zero, "leaves_": zero})
    valued = with_light.withColumns({
        "saved_here": F.col("own") + F.coalesce("saved_", zero), "leaves_here": (F.col("n_children") == 0).cast("long") + F.coalesce("leaves_", zero),
    }).drop("saved_", "leaves_")
    plus = lambda a, b: a + b
    summed = _sliced(valued, "path", True, {"saved_tokens": (F.col("saved_here"), F.sum, plus), "n_leaves": (F.col("leaves_here"), F.sum, plus)})
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ended = summed.join(_end_digests(chains), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) as they are; rows as in ``placed_turns``, nodes as in ``trie_of``."""
    turns = keep(placed_turns(conversations).withColumnRenamed("place", "depth"), "trie-placed-turns")
    return trie_of(turns, turns.select("conv_id").distinct())


def with_last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of ``prefix_trie`` with the ``role`` and ``text`` of their last turn (null at the root), by the smallest conversation of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    own = placed_turns(conversations).select("conv_id", F.col("place").alias("depth"), "digest")
    texts = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), digest.alias("digest"), role.alias("role"), text.alias("text"))
    return nodes.join(own, ["conv_id", "depth"], "left").join(texts.dropDuplicates(["conv_id", "digest"]), ["conv_id", "digest"], "left").drop("digest")


def branched(turns: DataFrame, every: int = 100, most: int = 6, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Conversations that branch off others: each begins with the first h turns of conversation ``conv_id - conv_id % every``
    (all if it has fewer, none if it does not exist), h being the crc32 of ``salt`` and the decimal id, modulo ``most``, and goes
    on with its own turns after its first h. Takes rows of ``placed_turns``; returns rows for ``trie_of`` and all conversations,
    those without turns too.
    """
    h = (F.crc32(F.concat(F.lit(salt), F.col("conv_id").cast("string"))) % most).alias("h")
    convs = keep(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h), "trie-convs")
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "chars")
    taken = convs.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "digest", "chars")
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    shifts = convs.join(bases, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("given"))
    rest = turns.join(shifts, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "digest", "chars")
    return taken.unionByName(rest), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt as ``branched`` says."""
    turns = keep(placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-placed-turns")
    rebuilt, convs = branched(turns)
    return trie_of(keep(rebuilt, "trie-rebuilt"), convs).drop("path")


OP11_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')[1:32], coalesce(text, '')[1:32],
      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384::BIGINT * (p & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
turns AS (
  SELECT v.c, o.place AS d, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.place <= v.h
  UNION ALL
  SELECT v.c, o.place - v.h + least(v.h, coalesce(b.n, 0)), o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.place > v.h LEFT JOIN convs b ON b.c = v.base),
steps AS (
  SELECT c, 0 AS d, '' AS k, NULL AS up, 0 AS chars FROM convs
  UNION ALL
  SELECT c, d, string_agg(md5(concat(length(role), ':', role, text)), '') OVER w, coalesce(string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), length(text)
  FROM turns WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(up) AS up, any_value(chars) AS chars FROM steps GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM steps GROUP BY c) GROUP BY k),
below AS (
  SELECT s.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.chars) AS saved
  FROM nodes x JOIN steps s ON s.c = x.c AND s.d <= x.d LEFT JOIN kids ON kids.k = x.k GROUP BY s.k)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.k = x.up AND x.d > 0 LEFT JOIN kids ON kids.k = x.k LEFT JOIN ends ON ends.k = x.k JOIN below ON below.k = x.k
"""

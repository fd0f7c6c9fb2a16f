"""The trie against a plain one, deep and wide shapes, and the rows that its docstrings speak of."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import trie
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(convs):
    """Nodes of {conversation: turns} as rows of the operator, by walking every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ended = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ended(p).encode()).hexdigest()) for p, m in members.items()), key=repr
    )


def in_order(rows):
    """The turns of each conversation, ordered as the operator says."""
    out = {}
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "")[:32].encode(), (r[3] or "")[:32].encode(), digest(r[2] or "", r[3] or ""))):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def seen(df):
    return sorted(map(tuple, df.drop("path").collect()), key=repr)


def test_random_tries(spark):
    rng = random.Random(5)
    rows = []
    for c in range(160):
        for turn in range(rng.randrange(0, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "x" * rng.randrange(3)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert seen(trie.prefix_trie(df)) == plain_trie(in_order(rows))
    turns = trie.placed_turns(df)
    assert seen(trie.trie_of(*trie.branched(turns))) == plain_trie(rebuilt(in_order(rows)))


def test_rows_of_every_kind(spark):
    """Null turns, roles, texts and ids, ties, repeated rows, and columns whose names the operator uses itself."""
    rows = [
        (1, None, "user", "a"), (1, 0, None, "b"), (1, 0, "user", None), (1, 1, "user", "é" * 40 + "1"), (1, 1, "user", "é" * 40 + "2"), (1, 1, "user", "é" * 40 + "2"),
        (2, None, "user", "a"), (2, 0, "", "b"), (None, 0, "user", "lost"), (3, 7, None, None), (100, 1, "user", "a"), (-4, 1, "user", "a"), (205, 1, "user", "only one turn"),
    ]
    names = "place digest chars depth x1 x2 path level part slice own top light heavy saved leaves n h base".split()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in names})
    assert seen(trie.prefix_trie(df)) == plain_trie(in_order(rows))
    for again in (df.repartition(5), df.coalesce(1)):
        assert seen(trie.prefix_trie(again)) == plain_trie(in_order(rows))
    branches = trie.branched(trie.placed_turns(df))
    assert branches[1].count() == 6
    assert sum(r.n_convs for r in trie.trie_of(*branches).filter("depth = 0").collect()) == 6


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(df).collect() == [] and trie.trie_of(*trie.branched(trie.placed_turns(df))).collect() == []


def test_long_and_common(spark, monkeypatch):
    """One conversation of a third of all turns, one that many share, and slices smaller than either."""
    monkeypatch.setattr(trie, "SLICE", 16)
    monkeypatch.setattr(trie, "CHUNK", 50)
    rows = [(7, i, "user", f"t{i % 9}") for i in range(900)] + [(1000 + c, i, "user", f"t{i % 9}") for c in range(150) for i in range(3)] + [(5000 + c, i, "user", f"t{i % 9}") for c in range(9) for i in range(40 + c % 3)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert seen(got) == plain_trie(in_order(rows))
    paths = {r.path: r.n for r in got.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert paths == {7: 901}  # every node is above the one leaf


def test_paths_are_heavy(spark):
    """Any node is on one path, a path ends in a leaf, and light children have at most half of their parent's conversations."""
    rows = [(c, d, "user", str(c >> d & 1)) for c in range(64) for d in range(6)] + [(c, 0, "user", "same") for c in range(100, 130)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {(r.conv_id, r.depth): r for r in got}
    assert len(by) == len(got) and {r.path for r in got} == {r.conv_id for r in got if not r.n_children}
    for r in got:
        if r.depth and r.path != by[r.parent_conv_id, r.depth - 1].path:
            assert 2 * r.n_convs <= by[r.parent_conv_id, r.depth - 1].n_convs


def test_last_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 70), (2, 0, "user", "a"), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_last_turns(trie.prefix_trie(df), df).collect()}
    assert got == {(1, 0): (None, None), (1, 1): ("user", "a"), (1, 2): ("assistant", "b" * 70), (2, 2): ("assistant", "")}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    assert compare(spark, trie.op11_prefix_trie, trie.OP11_SQL, f"/root/testdata/{sf}") > 40

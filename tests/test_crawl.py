"""Stop rules of a crawl against a plain loop; every rule fires by hand; the attempt that counts."""

import random
from collections import Counter

from shelfwise.operators import crawl

SCHEMA = "run long, at long, size long, status int, products int, ids array<string>, total long"


def replay(batches, results=500, most=400, stale_limit=2):
    seen, prev, stale, said, requests, added, at = set(), None, 0, None, 0, 0, None
    for k, (at, size, status, products, ids, total) in enumerate(batches):
        if k >= most:
            return at, "rounds", requests, added
        if at >= results:
            return at, "window", requests, added
        if said is not None and at >= said:
            return at, "total", requests, added
        if not ids and status != 200:
            return at, "status" if requests and status in crawl.ENDS else "error", requests, added
        said = total or said
        if not ids:
            return at, "empty", requests, added
        if ids == prev:
            return at, "repeat", requests, added
        prev = ids
        if products != 200:
            return at, "products" if requests and products in crawl.ENDS else "products error", requests, added
        new = len(set(ids) - seen)
        seen |= set(ids)
        requests, added, stale = requests + 1, added + new, 0 if new else stale + 1
        if len(ids) < size:
            return at, "short", requests, added
        if at + size >= results:
            return at, "window", requests, added
        if said is not None and at + len(ids) >= said:
            return at, "total", requests, added
        if stale >= stale_limit:
            return at, "stale", requests, added
    return at, "end", requests, added


def ids(lo, n=30):
    return [f"B{i}" for i in range(lo, lo + n)]


def full(at, lo, **more):
    row = {"at": at, "size": 30, "status": 200, "products": 200, "ids": ids(lo), "total": None} | more
    return tuple(row[k] for k in ("at", "size", "status", "products", "ids", "total"))


BY_HAND = {
    1: ("rounds", [full(i, 100 * i) for i in range(12)]), 2: ("window", [full(0, 0), full(500, 100)]), 3: ("window", [full(0, 0), full(480, 100)]), 4: ("total", [full(0, 0, total=40), full(45, 100)]), 5: ("total", [full(0, 0, total=31), full(30, 50), full(60, 90)]),
    6: ("status", [full(0, 0), full(30, 0, status=503, ids=None)]), 7: ("error", [full(0, 0, status=503, ids=[])]), 8: ("error", [full(0, 0), full(30, 0, status=418, ids=[])]), 9: ("empty", [full(0, 0), full(30, 0, ids=[])]), 10: ("repeat", [full(0, 0), full(30, 0)]),
    11: ("products", [full(0, 0), full(30, 40, products=429)]), 12: ("products error", [full(0, 0, products=429)]), 13: ("short", [full(0, 0), full(30, 40, ids=ids(40, 29))]), 14: ("short", [full(0, 0), full(30, 40, size=20, ids=ids(40, 19))]), 15: ("end", [full(0, 0), full(30, 40, size=20, ids=ids(40, 20))]),
    16: ("stale", [full(0, 0), full(30, 40), full(60, 0), full(90, 40), full(120, 100)]), 17: ("end", [full(0, 0), full(30, 40), full(60, 0), full(90, 100), full(120, 0)]), 18: ("total", [full(0, 0, total=0), full(30, 40, total=70), full(60, 80)]),
}


def frame(spark, runs):
    return spark.createDataFrame([(run, *b) for run, batches in runs.items() for b in batches], SCHEMA)


def test_every_rule(spark):
    runs = {k: b for k, (_, b) in BY_HAND.items()}
    got = {r.run: tuple(r)[1:] for r in crawl.stops(frame(spark, runs), most=11).collect()}
    assert {k: r[1] for k, r in got.items()} == {k: want for k, (want, _) in BY_HAND.items()}
    assert got == {k: replay(b, most=11) for k, b in runs.items()}


def test_random_replays(spark):
    rng = random.Random(2)
    runs = {}
    for run in range(300):
        batches = []
        for i in range(rng.randrange(1, 20)):
            size = rng.choice([30, 30, 30, 20])
            n = rng.choice([size] * 12 + [0, size - 1])
            status = rng.choice([200] * 15 + [503, 418])
            batches.append((30 * i, size, status, rng.choice([200] * 15 + [404, 403]), ids(rng.randrange(9) * 15, n) if status == 200 else [], rng.choice([None] * 6 + [0, 30 * i + 70])))
        runs[run] = batches
    got = {r.run: tuple(r)[1:] for r in crawl.stops(frame(spark, runs), results=400).collect()}
    assert got == {k: replay(b, results=400) for k, b in runs.items()}
    assert len(Counter(r[1] for r in got.values())) >= 9


def test_attempts(spark):
    rows = [
        (1, 0, 30, 200, []), (1, 0, 20, 200, ["a"]),  # nothing smaller is tried at the start
        (1, 30, 30, 503, []), (1, 30, 20, 200, []), (1, 30, 15, 200, ["b"]), (1, 30, 10, 200, ["c"]),
        (1, 60, 30, 200, []), (1, 60, 20, 200, ["d"]),  # an empty answer at full size is an answer
        (1, 90, 30, 503, []), (1, 90, 20, 500, []), (1, 90, 15, 500, []), (1, 90, 10, 429, []),
    ]
    got = crawl.attempts_that_count(spark.createDataFrame(rows, "run long, at long, size long, status int, ids array<string>")).collect()
    assert sorted((r.at, r["size"], r.status, tuple(r.ids)) for r in got) == [(0, 30, 200, ()), (30, 15, 200, ("b",)), (60, 30, 200, ()), (90, 10, 429, ())]


def test_long_runs_are_cut_before_windows(spark):
    """Batches behind the window are no rows of a window, and change nothing."""
    runs = {1: [full(30 * i, 10 * i) for i in range(400)], 2: [full(0, 0), full(900, 50), full(930, 0), full(960, 50)], 3: [full(0, 0), full(30, 0), full(700, 0)]}
    df = crawl.stops(frame(spark, runs))
    assert {r.run: tuple(r)[1:] for r in df.collect()} == {k: replay(b) for k, b in runs.items()}
    assert sorted((r.run, r.at) for r in crawl.reached(frame(spark, runs)).select("run", "at").collect()) == [*((1, 30 * i) for i in range(18)), (2, 0), (2, 900), (3, 0), (3, 30), (3, 700)]
    assert crawl.reached(frame(spark, {4: [full(None, 0), full(0, 0)]})).count() == 2

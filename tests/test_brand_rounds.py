"""Brand rounds against a plain loop."""

import random
import re
from difflib import SequenceMatcher

import pytest

from shelfwise.operators import brands

V = brands.BrandVocabulary(aliases={"Oak's": ("oak farms", "oak dairy")}, connectors=frozenset(["and", "foods"]), generic=frozenset(["milk", "tea"]), descriptors=frozenset(["organic", "classic"]))
KNOWN = {"milk", "tea", "organic", "classic"}


def text_key(t):
    return " ".join(re.sub("[^a-z0-9]+", " ", (t or "").lower()).split())


def brand_key(t):
    return text_key(re.sub("['’]", "", t))


def linked(a, b):
    """Of brands (name, n, ord), ``a`` seen first."""
    ka, kb = brand_key(a[0]), brand_key(b[0])
    words = lambda k: [w for w in k.split() if w not in V.connectors]
    ta, tb = words(ka), words(kb)
    block = lambda t, k: t[0] if t else k[:1]
    if not ka or not kb or block(ta, ka) != block(tb, kb):
        return False
    seeds = {brand_key(x): c for c, known in V.aliases.items() for x in (*known, c)}
    if seeds.get(ka) and seeds.get(ka) == seeds.get(kb):
        return True
    (short, t), (long, _) = sorted([(ka, ta), (kb, tb)], key=lambda x: len(x[0]))
    if long.startswith(short + " "):
        rest = long[len(short) + 1 :].split()
        if all(w in KNOWN for w in rest) or (len(t) >= 2 and len(rest) <= 2 and not any(re.search("[0-9]", w) for w in rest)):
            return True
    grams = lambda k: {k.replace(" ", "")[i : i + 3] for i in range(max(1, len(k.replace(" ", "")) - 2))}
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0
    if ta and tb and ta[0] == tb[0] and share(set(ta), set(tb)) >= 0.66 and share(grams(ka), grams(kb)) >= 0.72:
        return True
    return len(ta) >= 2 and len(tb) >= 2 and ta[:2] == tb[:2] and SequenceMatcher(None, ka, kb).ratio() >= 0.8


def families(seen):
    seen = sorted(seen, key=lambda b: b[2])
    group = {b[0]: {b[0]} for b in seen}
    for i, a in enumerate(seen):
        for b in seen[i + 1 :]:
            if linked(a, b) and group[a[0]] is not group[b[0]]:
                both = group[a[0]] | group[b[0]]
                for x in both:
                    group[x] = both
    seeds = {brand_key(x) for c, known in V.aliases.items() for x in (*known, c)}

    def score(b):
        k = brand_key(b[0])
        t = [w for w in k.split() if w not in V.connectors]
        return (k in seeds, -sum(w in KNOWN for w in t[2:]), -(k.split()[-1] in brands.SUFFIXES), -len(t), -sum(w in V.generic for w in t), b[1], -len(k), -b[2])

    by = {b[0]: b for b in seen}
    best = {x: max((by[m] for m in own), key=score)[0] for x, own in group.items() if len(own) > 1}
    return {x: c for x, c in best.items() if x != c}


def prefix_map(sources, own):
    rank = lambda b: (len(text_key(b).split()), len(text_key(b)), b)
    goes_on = lambda long, short: text_key(short) and text_key(long).startswith(text_key(short) + " ") and text_key(long)[len(text_key(short)) + 1 :].split()[0] in KNOWN
    found, to_source = {}, set()
    for b in sorted(own, key=rank):
        root = next((s for s in sorted(sources, key=rank) if goes_on(b, s)), None)
        if root:
            found[b] = root
            to_source.add(b)
            continue
        for other in sorted(own, key=rank):
            if other != b and other not in to_source and goes_on(other, b):
                found[other] = b
    return found


def rounds(rows, most=4):
    rows = [list(r) for r in rows]
    for r in rows:
        r[1] = (r[2] or r[1] or None) if r[3] == "source" else r[1] or None
    count = 0
    while count < most:
        before = {r[1] or "" for r in rows}
        mine = [r for r in rows if r[3] != "source" and r[1]]
        seen = {}
        for o, b, *_ in mine:
            n, first = seen.get(b, (0, o))
            seen[b] = (n + 1, min(first, o))
        mapped = prefix_map({r[1] for r in rows if r[3] == "source" and r[1]}, set(seen)) | families([(b, n, o) for b, (n, o) in seen.items()])
        for r in mine:
            r[1] = mapped.get(r[1], r[1])
            if all(w in V.generic for w in text_key(r[1]).split() if w not in V.connectors):
                r[1] = None
        count += 1
        if {r[1] or "" for r in rows} == before:
            break
    return {r[0]: r[1] for r in rows}, count


@pytest.mark.parametrize("seed", range(3))
def test_rounds(spark, seed):
    rng = random.Random(seed)
    name = lambda: " ".join([rng.choice(["Acme", "Bolt", "Oak", "Blue Ridge"]), *rng.sample(["Organic", "Milk", "Tea", "Classic", "Farms", "Farm", "Foods", "Gold", "2"], rng.randrange(4))])
    rows = []
    for i in range(120):
        source = rng.random() < 0.15
        rows.append((i, rng.choice([name(), name(), "", None, "Milk Tea"]), name() if source and rng.random() < 0.8 else None, "source" if source else rng.choice(["derived", None])))
    df = spark.createDataFrame(rows, "o long, brand string, source_brand string, brand_source string")
    got, count = brands.normalised(df, V, "o")
    want, times = rounds(rows)
    assert {r.o: r.brand for r in got.collect()} == want
    assert count == times


def test_ends_and_empty(spark):
    rows = [(1, "Acme Milk Tea", None, "derived"), (2, "Acme Milk", None, "derived"), (3, "Acme", "Acme", "source")]
    df = spark.createDataFrame(rows, "o long, brand string, source_brand string, brand_source string")
    got, count = brands.normalised(df, V, "o")
    assert {r.brand for r in got.collect()} <= {"Acme", "Acme Milk"} and count <= 4
    assert brands.normalised(df.limit(0), V, "o")[0].collect() == []

"""The merged record against a plain fold over shuffled feeds."""

import random

import pytest

from shelfwise.operators import record

FIELDS = ["k", "o", "name", "raw_name", "brand", "source_brand", "brand_source", "source_categories", "source", "store_id", "retailer", *record.OFFERED, "image", "category"]
SCHEMA = (
    "k long, o long, name string, raw_name string, brand string, source_brand string, brand_source string, source_categories array<string>, source string, store_id string, retailer string, "
    "current_price string, basis_price string, prime_price string, discount string, discount_percent int, unit_price string, url string, image string, category string"
)
EMPTY = (None, "", [])
key = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())


def fold(rows, defaults):
    """One row after another, as a merge of two records at a time."""
    held, offers = None, {}
    for r in rows:
        r = {k: (None if v in EMPTY else v) for k, v in r.items()}
        r["brand_source"] = None if r["brand"] is None else r["brand_source"] or "derived"
        r["source_brand"] = (r["source_brand"] or r["brand"]) if r["brand_source"] == "source" else None
        first = held is None
        if first:
            held = {k: v for k, v in r.items() if k not in ("source", "store_id")} | {"sources": [], "stores": []}
        else:
            for k, v in r.items():
                if k not in ("source", "store_id", "k", "o") and held[k] is None and v is not None:
                    held[k] = v
            mine, theirs = r["brand_source"] == "source", held["brand"] is not None and held["brand_source"] == "source"
            if mine and (not theirs or key(r["source_brand"]).startswith(key(held["source_brand"] or held["brand"]) + " ")):
                held |= {"brand": r["brand"], "source_brand": r["source_brand"], "brand_source": "source"}
                if name := held["raw_name"] or r["name"]:
                    held["name"] = f"{name}/{held['brand']}"
            if any(key(c) == "fresh produce" for c in r["source_categories"] or []):
                held["source_categories"] = sorted(set((held["source_categories"] or []) + r["source_categories"]))
                if held["brand_source"] != "source":
                    held |= {"brand": None, "source_brand": None, "brand_source": None}
        for name, v in (("sources", r["source"]), ("stores", r["store_id"])):
            if v is not None and v not in held[name]:
                held[name].append(v)
        if r["store_id"] is not None:
            offer = offers.setdefault(r["store_id"], {k: None for k in record.OFFERED} | {"sources": []})
            for k in record.OFFERED:
                v = (r[k] or 0) if k == "discount_percent" else r[k]
                offer[k] = offer[k] if v is None else v
            if r["source"] and r["source"] not in offer["sources"]:
                offer["sources"].append(r["source"])
        if offers:
            chosen = next((offers[s] for s in defaults if s in offers), next(iter(offers.values())))
            held |= {k: v for k, v in chosen.items() if k in record.OFFERED and v is not None}
    return held, offers


def random_rows(rng, n):
    pick = lambda *x: rng.choice(x)
    rows = []
    for k in range(n):
        for o in range(rng.randrange(1, 12)):
            brand = pick(None, "", "Acme", "Acme Farms", "Acme Farms Gold", "Bolt", "acme")
            rows.append((
                k, o, pick(None, "", "name a", "name b"), pick(None, None, "", "raw c"), brand, pick(None, None, "Acme", "Acme Farms"), pick(None, "derived", "source"), pick(None, [], ["Dairy"], ["Fresh Produce", "Fruit"], ["Fresh  produce!"]),
                pick(None, "Flyer", "All Deals", "Search Deals"), pick(None, "", "1", "2", "3", "D1", "D2"), pick(None, "", "hmart"), pick(None, "", "$1", "$2"), pick(None, "$3", "$4/lb"), pick(None, "$2", "$1 ea"), pick(None, "", "5% off"), pick(None, 0, 5),
                pick(None, "$1/oz"), pick(None, "u", "v"), pick(None, "", "i"), pick(None, "Dairy"),
            ))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fold(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 250)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    defaults = ["D1", "D2"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
    found = {r.k: r for r in record.merged_records(df, "k", "o", ["image", "category"], defaults, lambda name, brand: F.concat_ws("/", name, brand)).collect()}
    assert set(found) == {r[0] for r in rows}
    for k, r in found.items():
        own = [dict(zip(FIELDS, x, strict=True)) for x in rows if x[0] == k]
        held, offers = fold(own, defaults)
        for c in ("name", "raw_name", "brand", "source_brand", "brand_source", "image", "category", *(x for x in record.OFFERED if x != "prime_price")):
            assert r[c] == held[c], (k, c)
        assert (r.source_categories or None) == (held["source_categories"] or None) and r.sources == held["sources"] and r.source_count == len(held["sources"])
        assert r.available_store_ids == (held["stores"] or defaults)
        got = [(o.store_id, {c: o[c] for c in record.OFFERED} | {"sources": o.sources}) for o in r.store_offers or []]
        assert got == list(offers.items()), k
        assert (r.prime_price is None) == (held["prime_price"] is None) and r.retailer
        if held["prime_price"] and held["basis_price"] == "$4/lb" and len(own) > 1:
            assert r.prime_price.endswith("/lb")


def test_by_hand(spark):
    """The name follows the brand, a zero stays, tags come of the result."""
    rows = [
        (1, 1, "organic milk", None, "Organic", None, "derived", ["Dairy"], "Flyer", None, None, "$2", None, None, None, 0, None, None, None, None),
        (1, 2, "x", "acme farms organic milk", "Acme", None, "source", None, "All Deals", "D1", None, None, "$5", "$4", None, 20, None, None, None, None),
    ]
    r = record.merged_records(spark.createDataFrame(rows, SCHEMA), "k", "o").collect()[0]
    assert (r.name, r.brand, r.current_price, r.discount_percent) == ("Acme Farms Organic Milk", "Acme", "$2", 20)
    assert r.tags == ["multi-source deal", "organic", "prime deal"] and r.retailer == "Whole Foods"


def test_empty(spark):
    assert record.merged_records(spark.createDataFrame([], SCHEMA), "k", "o", ["image"], ["D1"]).collect() == []

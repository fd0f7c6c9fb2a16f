"""The price sort ranks every part."""

from shelfwise.catalogue import QUERIES
from shelfwise.plans.prices import resolved


def test_every_part_is_ranked(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.p_partkey: r.place for r in QUERIES["price_sort_nulls_last"](spark, sf).collect()}
    assert len(found) == 2000 and sorted(found.values()) == list(range(1, 2001))
    rows = resolved(spark, sf).selectExpr("p_partkey", "coalesce(prime_price, basis_price) AS p").collect()
    bare = {r.p_partkey for r in rows if r.p is None or "$" not in r.p}
    assert bare and {k for k, place in found.items() if place > 2000 - len(bare)} == bare

"""Pages by hand for each site, called from SQL."""

from pyspark.sql import functions as F

from shelfwise.catalogue import QUERIES
from shelfwise.sources import cards

TILES = """<html><body><div id="grid">
<div><a data-csa-c-type="productTile" href="/grocery/product/olive-oil-b0abc12345?ref=x"><div class="flex flex-col gap-2"><img src="//img/1.jpg"><span class="bds--body-2 dim">Acme</span>
  <span class="bds--heading-5 name">Olive <b>Oil</b></span></div><span class="bds--body-6">16 fl oz</span><span>Prime <i>deal</i></span><span>20% off</span><p>Join Prime to buy this item at $7.99/lb.</p>
  <div class="flex flex-wrap gap-2"><span class="bds--heading-5">$3.00</span></div><div class="flex flex-wrap gap-2 row"><span class="bds--heading-5">$9.99/lb</span><span class="old line-through">$12.49/lb</span></div></a></div>
<div><a data-csa-c-type="productTile" data-csa-c-content-id="B000000002" href="https://other.example/grocery/product/2"><div class="flex flex-col gap-2"><span class="bds--heading-5">Plain</span></div><div class="flex flex-wrap gap-2"></div></a></div>
<div><a data-csa-c-type="productTile" data-csa-c-content-id="B3" href="/grocery/product/3"><div class="flex gap-2"><span class="bds--heading-5">not in the top part</span></div></a></div>
<section><a data-csa-c-type="productTile" data-csa-c-content-id="B4" href="/grocery/product/4"><div class="flex flex-col gap-2"><span class="bds--heading-5">not in a div</span></div></a></section>
<div><a href="/grocery/product/5"><div class="flex flex-col gap-2"><span class="bds--heading-5">no tile</span></div></a><unclosed><p>
"""

OFFERS = """<main>
<div data-test="offer-card-1"><button aria-label="Show items for  Fresh Milk "></button><div data-test="offer-title">another title</div><div class="a__OfferCardValue">$2.50 - $3.00</div><p>Expires soon</p><p>not this</p><img src="m.jpg"><a href="/x">x</a><a href="/pl/9">y</a></div>
<div data-test="offer-card-2"><div data-test="offer-title">Apples</div><div class="OfferCardValue--z">Buy 2, get 1 free</div></div>
<div data-test="offer-card-3"><div data-test="offer-title">No value</div><div class="OfferCardValue">new</div></div>
<div data-test="offer-card-4"><div class="OfferCardValue">$5</div></div>
<div data-test="offer-card-5"><div data-test="offer-title">Apples</div><div class="OfferCardValue--z">Buy 2, get 1 free</div><img src="second.jpg"></div>
<a data-test="multistory-1" href="http://www.target.com/c/1">* 30% off* | Snacks &amp; more</a><a data-test="multistory-2">Save when you buy two</a><a data-test="multistory-3"> </a></main>
"""


def called(spark, function, *pages):
    cards.register(spark)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id int, html string")
    return spark.sql(f"SELECT p.page_id, t.* FROM {{p}} p, LATERAL {function}(p.html) t", p=df).collect()


def test_search_tiles(spark):
    got = called(spark, "search_tiles", TILES, None, "", "no markup <<")
    assert [tuple(r) for r in got] == [
        (0, 0, "B0ABC12345", "Olive Oil", "Acme", "16 fl oz", "//img/1.jpg", "https://www.wholefoodsmarket.com/grocery/product/olive-oil-b0abc12345?ref=x", "$9.99/lb", "$12.49/lb", "$7.99/lb", "20% off", "$9.99/lb"),
        (0, 1, "B000000002", "Plain", None, None, None, "https://other.example/grocery/product/2", None, None, None, None, None),
    ]


def test_offer_cards(spark):
    got = [tuple(r)[1:] for r in called(spark, "offer_cards", OFFERS, None)]
    assert [(r[0], *r[2:]) for r in got] == [
        (0, "Apples", None, "https://www.target.com/s?searchTerm=Apples", None, "Buy 2, get 1 free", None, "Buy 2, get 1 free"),
        (1, "Fresh Milk", "m.jpg", "https://www.target.com/pl/9", "$2.50 to $3.00", None, "Expires soon", "$2.50 - $3.00"),
        (2, "Save when you buy two", None, "https://www.target.com/s?searchTerm=Save+when+you+buy+two", None, "Save when you buy two", None, "Save when you buy two"),
        (3, "Snacks & more", None, "https://www.target.com/c/1", None, "30% off", None, "30% off"),
    ]
    assert len({r[1] for r in got}) == 4 and all(r[1].startswith("target:") and len(r[1]) == 23 for r in got)


def test_deep_pages(spark):
    """A page of a hundred thousand nested elements is no recursion."""
    deep = "<div>" * 100_000 + "<a data-csa-c-type='productTile' data-csa-c-content-id='B1' href='/grocery/product/1'><div class='flex flex-col gap-2'><span class='bds--heading-5'>deep</span></div></a>"
    assert [r["name"] for r in called(spark, "search_tiles", deep)] == ["deep"]


def test_pages_are_read_by_many_tasks(spark):
    """Parts are one small file, so a single task read all pages."""
    for name in ("search_tiles", "offer_cards"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").select(F.spark_partition_id()).distinct().count() == 4
    assert cards.dealt_out(spark.range(100), 10).rdd.getNumPartitions() == 10

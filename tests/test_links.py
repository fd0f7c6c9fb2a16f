"""Links against the standard library's."""

from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from shelfwise.functions import links

ODD = ["", "a b", "ü&=?", "~*-._/+", "50% off", "x,y"]


def paged(url, n):
    parts = urlsplit(url)
    query = parse_qs(parts.query, keep_blank_values=True)
    query["page"] = [str(n)]
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(query, doseq=True), parts.fragment))


def test_query_strings(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ODD)], "x string, i int")
    got = [r[0] for r in df.orderBy("i").select(links.search_link(F.col("x"), F.lit("price"), F.col("i") * 30, F.lit(30), F.array(F.lit("p_n_deal:1"), F.col("x")))).collect()]
    want = [links.SEARCH_API + urlencode({"text": "", "old": x, "offset": i * 30, "size": 30, "sort": "price", "programType": "GROCERY", "filters": f"p_n_deal:1,{x}", "categories": ""}) for i, x in enumerate(ODD)]
    assert got == want
    one = df.limit(1).select(links.products_link(F.lit("d/1"), F.array(F.lit("B1"), F.lit("B2"))), links.flyer_link(F.lit(7)), links.promotion_link(F.lit("p9"), F.lit("7")), links.promotion_link(F.lit(""), F.lit("7"))).first()
    assert tuple(one) == (links.PRODUCTS_API + urlencode({"offerListingDiscriminator": "d/1", "programType": "GROCERY", "asins": "B1,B2"}), links.FLYER + "7", links.PROMOTION + "p9?store-id=7", None)


def test_pages(spark):
    urls = ["https://x.example/deals", "https://x.example/deals?order=a+b&page=2&map=c%2Cd", "https://x.example/deals?page=1&page=7&z=", "http://x.example/?a=1&b=2&a=3#top", "https://x.example/p?flag&ü=é"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(links.page_link(F.col("u"), F.col("i") + 3)).collect()]
    assert got == [paged(u, i + 3) for i, u in enumerate(urls)]


def test_absolute(spark):
    cases = {"/p/1": "https://s.example/p/1", " http://a.example/x": "https://a.example/x", "https://b.example": "https://b.example", "p/1": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "href string, want string")
    assert all(r.want == r.got for r in df.select("want", links.absolute_link(F.col("href"), "https://s.example").alias("got")).collect())

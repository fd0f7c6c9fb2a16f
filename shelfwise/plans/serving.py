"""Queries of the feed, personalised shelves and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import pricing, text
from shelfwise.functions.dialect import DUCK
from shelfwise.operators import feed as fd

from shelfwise.working import keep

from .adapters import CATALOG, OFFERS, catalog, duck, offers, sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


_SOURCES = f"SELECT product AS p_partkey, count(DISTINCT source) AS source_count, list_sort(list(DISTINCT source)) AS sources, list_sort(list(DISTINCT CAST(store % 7 AS VARCHAR))) AS stores FROM {OFFERS} AS x GROUP BY product"
_FEED = f"""(SELECT p.p_partkey, concat('P', CAST(p.p_partkey AS STRING)) AS asin, p_name AS name, p_brand AS brand, p_type AS category, basis_price, prime_price, discount, CAST(greatest(0, {DUCK.largest_percent('discount')}) AS INTEGER) AS discount_percent,
  CAST(p.p_partkey % 10 AS DOUBLE) / 10 AS category_confidence, CASE p.p_partkey % 3 WHEN 0 THEN ['organic', 'vegan'] WHEN 1 THEN ['keto'] ELSE [] END AS tags, coalesce(s.source_count, 0) AS source_count, s.sources, CASE WHEN p.p_partkey % 11 = 0 THEN [] ELSE s.stores END AS stores
  FROM ({pricing.resolve_prices_sql(DUCK, duck(CATALOG), 'regular', 'prime', 'cur', 'promo', '*').replace('*, price_branch, basis_price, prime_price, discount', '*')}) p LEFT JOIN ({_SOURCES}) s ON s.p_partkey = p.p_partkey)"""


def products(spark, d):
    """The catalog with resolved prices, sources and stores: what the feed filters and ranks."""
    priced = pricing.resolve_prices(catalog(spark, d), "regular", "prime", "cur", "promo")
    rows = offers(spark, d).groupBy(F.col("product").alias("p_partkey")).agg(F.collect_set("source").alias("sources"), F.collect_set((F.col("store") % 7).cast("string")).alias("stores"))
    tags = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('organic', 'vegan') WHEN 1 THEN array('keto') ELSE CAST(array() AS array<string>) END")
    return priced.join(rows, "p_partkey", "left").select(
        "p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asin"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit("Whole Foods").alias("retailer"),
        "basis_price", "prime_price", F.lit(None).cast("string").alias("current_price"), "discount", pricing.discount_percent("discount").alias("discount_percent"), ((F.col("p_partkey") % 10).cast("double") / 10).alias("category_confidence"), tags.alias("tags"),
        F.coalesce(F.size("sources"), F.lit(0)).alias("source_count"), "sources", F.expr("CAST(array() AS array<string>)").alias("source_labels"), F.when(F.col("p_partkey") % 11 == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.col("stores")).alias("available_store_ids"),
    )


_HAY = DUCK.key("concat_ws(' ', name, brand, category, asin, array_to_string(tags, ' '))")


@query("feed_filter", f"SELECT category, count(*) AS n, CAST(sum(discount_percent) AS BIGINT) AS percent FROM {_FEED} WHERE contains({_HAY}, 'e') AND lower(category) <> 'x' AND len(list_intersect(tags, ['vegan', 'keto'])) > 0 AND discount_percent >= 10 AND (len(coalesce(stores, [])) = 0 OR len(list_intersect(stores, ['1', '2'])) > 0) AND len(list_intersect(coalesce(sources, []), ['Flyer', 'All Deals'])) > 0 GROUP BY category")
def feed_filter(spark, d):
    found = fd.filter_feed(products(spark, d), q="E", tag="Vegan, keto", min_discount="10", store_id="1,2", source="flyer,all deals")
    return found.groupBy("category").agg(F.count("*").alias("n"), F.sum("discount_percent").alias("percent"))


def _sort(name: str, mode: str, order: str, where: str = "true", **filters):
    @query(name, f"SELECT asin, discount_percent, source_count FROM {_FEED} WHERE {where} ORDER BY {order}, asin LIMIT 120")
    def f(spark, d):
        return fd.feed(products(spark, d), mode, fd.clamp("x", 120, 1000), ["asin"], **filters).select("asin", "discount_percent", "source_count")

    return f


_NAME = DUCK.key("name")
_sort("feed_sort_discount", "discount", f"discount_percent DESC, {_NAME}", "discount_percent >= 15", min_discount=15)
_sort("feed_sort_price", "price-asc", f"try_cast(nullif(regexp_extract(prime_price, '\\$([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) NULLS LAST, {_NAME}")
_sort("feed_sort_sources", "source-count", f"source_count DESC, discount_percent DESC, {_NAME}")
_sort("feed_sort_display", "", f"CASE WHEN discount_percent = 0 THEN -1 ELSE discount_percent END DESC, CASE WHEN prime_price IS NULL THEN 1 ELSE 0 END, CASE WHEN basis_price IS NULL THEN 1 ELSE 0 END, source_count DESC, category_confidence DESC, {_NAME}")


@query("feed_limit_count", f"SELECT count(*) AS total, least(count(*), 60) AS shown FROM {_FEED} WHERE discount_percent >= 20")
def feed_limit_count(spark, d):
    total = fd.filter_feed(products(spark, d), min_discount=20).agg(F.count("*").alias("total"))
    return total.select("total", F.least("total", F.lit(fd.clamp("60", 120, 1000)).cast("long")).alias("shown"))


@query("point_lookup", f"SELECT asin, name FROM {_FEED} WHERE asin = 'P7'")
def point_lookup(spark, d):
    """One product: the id gives the stored key, so the filter reaches the scan."""
    key = int("P7".removeprefix("P"))
    return products(spark, d).filter(F.col("p_partkey") == key).select("asin", "name").limit(1)


@query("client_filter", "SELECT p_partkey FROM part WHERE contains(lower(concat(p_name, ' ', p_brand)), 'a') AND p_type = (SELECT min(p_type) FROM part)")
def client_filter(spark, d):
    """Exact category, raw lower-case substring: wider than the served filter in what it searches."""
    parts = table(spark, d, "part")
    first = parts.agg(F.min("p_type").alias("p_type"))
    return parts.join(F.broadcast(first), "p_type", "left_semi").filter(F.contains(F.lower(F.concat("p_name", F.lit(" "), "p_brand")), F.lit("a"))).select("p_partkey")  # one row is broadcast


_LIKES = "SELECT DISTINCT concat('P', CAST(event_id % 97 AS STRING)) AS asin FROM events WHERE event_type = '{}' AND event_id % 5 = {}"


def profile(spark, d):
    return (sql(spark, d, _LIKES.format(k, n), "events") for k, n in (("click", 0), ("error", 1)))


_AFFINITY = """{n} AS (SELECT kind, value, count(*) AS n FROM (SELECT 'category' AS kind, category AS value FROM f WHERE asin IN (SELECT asin FROM {s}) UNION ALL SELECT 'brand', brand FROM f WHERE asin IN (SELECT asin FROM {s}) UNION ALL SELECT 'tag', unnest(tags) FROM f WHERE asin IN (SELECT asin FROM {s})) GROUP BY ALL)"""
_BASE = f"WITH f AS (SELECT * FROM {_FEED}), lk AS ({_LIKES.format('click', 0)}), dk AS ({_LIKES.format('error', 1)}), {_AFFINITY.format(n='la', s='lk')}, {_AFFINITY.format(n='da', s='dk')}"


@query("affinity_counts", f"{_BASE} SELECT kind, value, n FROM la")
def affinity_counts(spark, d):
    liked, _ = profile(spark, d)
    return fd.affinity(products(spark, d), liked, "asin")


_W = "coalesce((SELECT n FROM {t} WHERE kind = '{k}' AND value = f.{c}), 0)"
_TAGW = "coalesce((SELECT CAST(sum(n) AS BIGINT) FROM {t} WHERE kind = 'tag' AND list_contains(f.tags, value)), 0)"
_PERSONAL = f"""{_BASE}, s AS (SELECT *, discount_percent * 4 + CASE WHEN prime_price IS NOT NULL THEN 18 ELSE 0 END + CASE WHEN basis_price IS NOT NULL THEN 10 ELSE 0 END - CASE WHEN discount_percent = 0 AND basis_price IS NULL THEN 18 ELSE 0 END + greatest(0, source_count - 1) * 10 + CAST(floor(category_confidence * 12 + 0.5) AS BIGINT)
  + CASE WHEN starts_with(lower(name), 's') THEN 140 WHEN contains(lower(name), 's') THEN 100 WHEN starts_with(lower(brand), 's') THEN 75 WHEN contains(lower(brand), 's') THEN 55 ELSE 10 END
  + CASE WHEN asin IN (SELECT asin FROM lk) THEN 24 ELSE 0 END - CASE WHEN asin IN (SELECT asin FROM dk) THEN 90 ELSE 0 END
  + 16 * {_W.format(t='la', k='category', c='category')} - 20 * {_W.format(t='da', k='category', c='category')} + 16 * {_W.format(t='la', k='brand', c='brand')} - 22 * {_W.format(t='da', k='brand', c='brand')} + 8 * {_TAGW.format(t='la')} - 10 * {_TAGW.format(t='da')} AS score FROM f)"""


@query("shelf_rank_personalized", f"{_PERSONAL} SELECT category, asin, CAST(score AS BIGINT) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, discount_percent DESC, name, asin) AS place FROM s) WHERE place <= 10")
def shelf_rank(spark, d):
    """Ten best of each shelf by a score from deal, query and profile."""
    liked, disliked = profile(spark, d)
    rows = fd.personal_score(keep(products(spark, d), "products"), liked, disliked, "asin", "s")
    w = Window.partitionBy("category").orderBy(F.desc("score"), F.desc("discount_percent"), "name", "asin")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("category", "asin", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query("shelf_counts", "SELECT p_type AS category, count(*) AS total, CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 99 END AS shelf FROM part GROUP BY p_type")
def shelf_counts(spark, d):
    """Shelves with their totals in a preferred order, others after."""
    preferred = F.array(F.lit("STANDARD"), F.lit("ECONOMY"))
    at = F.array_position(preferred, F.col("category"))
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("total")).withColumn("shelf", F.when(at > 0, at).otherwise(99).cast("int"))


@query("stratified_round_robin", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS rn FROM customer) ORDER BY rn, c_mktsegment LIMIT 100")
def round_robin(spark, d):
    """A sample that takes one of each stratum in turn."""
    w = Window.partitionBy("c_mktsegment").orderBy("c_name", "c_custkey")
    return table(spark, d, "customer").withColumn("rn", F.row_number().over(w)).filter("rn <= 100").orderBy("rn", "c_mktsegment").limit(100).select("c_custkey", "c_mktsegment")


@query("preference_toggle", "SELECT user_id, CAST(count(*) FILTER (n % 2 = 1) AS BIGINT) AS liked FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def preference_toggle(spark, d):
    """Membership after toggles: in the set if toggled an odd number of times."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count_if(F.col("n") % 2 == 1).alias("liked"))

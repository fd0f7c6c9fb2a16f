"""Queries of entity resolution: keys, ordered merges, offers, dedupe, brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import names, text
from shelfwise.functions.dialect import DUCK
from shelfwise.operators import brands, graph, merge
from shelfwise.working import keep

from .adapters import OFFERS, duck, offers, sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


@query("entity_key", """
SELECT key, count(*) AS n FROM (
  SELECT CASE WHEN len(ids) > 1 THEN concat('asins:', array_to_string(list_sort(ids), ',')) WHEN one <> '' THEN concat('asin:', one) WHEN len(ids) = 1 THEN concat('asin:', ids[1]) ELSE 'name:item' END AS key
  FROM (SELECT list_filter([CASE WHEN l_linenumber % 3 = 0 THEN concat('B', CAST(l_partkey % 50 AS VARCHAR)) END, CASE WHEN l_linenumber % 2 = 0 THEN concat('A', CAST(l_suppkey % 20 AS VARCHAR)) ELSE '' END], lambda x: x <> '') AS ids, CASE WHEN l_linenumber = 5 THEN concat('C', CAST(l_suppkey % 7 AS VARCHAR)) END AS one FROM lineitem))
GROUP BY key""")  # fmt: skip
def entity_key(spark, d):
    ids = F.expr("array(CASE WHEN l_linenumber % 3 = 0 THEN concat('B', l_partkey % 50) END, CASE WHEN l_linenumber % 2 = 0 THEN concat('A', l_suppkey % 20) ELSE '' END)")
    one = F.expr("CASE WHEN l_linenumber = 5 THEN concat('C', l_suppkey % 7) END")
    return table(spark, d, "lineitem").select(merge.entity_key(ids, one, F.lit("Item!")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("entity_merge_first_nonempty", f"""
SELECT product, arg_min(price, ord) FILTER (price IS NOT NULL) AS price, arg_min(expires, ord) FILTER (expires <> '') AS expires, arg_min(percent, ord) AS percent, count(DISTINCT source) AS source_count,
  (SELECT string_agg(source, ',' ORDER BY o) FROM (SELECT source, min(ord) AS o FROM {OFFERS} AS x WHERE x.product = y.product GROUP BY source)) AS sources
FROM {OFFERS} AS y GROUP BY product""")  # fmt: skip
def entity_merge(spark, d):
    """Five feeds folded into one record a product: first value that is not empty in the order of feeds; 0 is a value."""
    rows = offers(spark, d)
    values = merge.first_non_empty(rows, ["product"], "ord", ["price", "expires", "percent"])
    uses = rows.groupBy("product", "source").agg(F.min("ord").alias("o"))
    sources = uses.groupBy("product").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]), ",").alias("sources"), F.count("*").alias("source_count"))
    return values.join(sources, "product")


@query("offer_merge_last_nonempty", f"SELECT product, store, arg_max(price, ord) FILTER (price IS NOT NULL) AS price, arg_max(expires, ord) FILTER (expires <> '') AS expires, arg_max(percent, ord) AS percent, count(DISTINCT source) AS n_sources FROM {OFFERS} AS x GROUP BY product, store")
def offer_merge(spark, d):
    out = merge.merge_offers(offers(spark, d), "product", "store", "ord", ["price", "expires", "percent"], "source")
    return out.select("product", "store", "price", "expires", "percent", F.size("sources").cast("long").alias("n_sources"))


@query("primary_offer", f"SELECT product, arg_min(store, k) AS store, arg_min(percent, k) AS percent FROM (SELECT *, concat(CASE WHEN store % 10 = 1 THEN '0' ELSE '1' END, ord) AS k FROM {OFFERS} AS x) GROUP BY product")
def primary_offer(spark, d):
    return merge.primary_offer(offers(spark, d), "product", "store", "ord", F.col("store") % 10 == 1, ["percent"])


_BRANDS = "SELECT c_nationkey AS k, c_custkey AS o, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Acme' WHEN 2 THEN 'Acme Farms' WHEN 3 THEN 'Other' ELSE 'Acme Farms Gold' END AS brand, CASE WHEN c_custkey % 5 IN (2, 4) AND c_custkey % 3 = 0 THEN 'source' WHEN c_custkey % 5 = 1 AND c_custkey % 7 = 0 THEN 'source' ELSE 'derived' END AS brand_source FROM customer"


@query("brand_upgrade_fold", f"""
WITH RECURSIVE r AS (SELECT k, brand, brand_source, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM ({_BRANDS})),
f AS (
  SELECT k, i, brand, CASE WHEN brand IS NOT NULL THEN brand_source END AS brand_source FROM r WHERE i = 1
  UNION ALL
  SELECT r.k, r.i, CASE WHEN t THEN r.brand ELSE f.brand END, CASE WHEN t THEN r.brand_source ELSE f.brand_source END
  FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1, LATERAL (SELECT (f.brand IS NULL AND r.brand IS NOT NULL) OR (r.brand IS NOT NULL AND r.brand_source = 'source' AND (coalesce(f.brand_source, '') <> 'source' OR starts_with(lower(r.brand), concat(lower(f.brand), ' ')))) AS t) AS x)
SELECT k, brand, brand_source FROM f WHERE i = (SELECT max(i) FROM r WHERE r.k = f.k)""")  # fmt: skip
def brand_upgrade(spark, d):
    rows = sql(spark, d, _BRANDS, "customer")
    ordered = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "brand", "brand_source"))), lambda x: F.struct(x["brand"].alias("brand"), x["brand_source"].alias("brand_source"))).alias("rows"))
    return ordered.select("k", merge.upgraded_brand(F.col("rows")).alias("b")).select("k", "b.brand", "b.brand_source")


@query("dedupe_first_wins", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedupe_first(spark, d):
    return merge.first_rows(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("dedupe_last_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedupe_last(spark, d):
    return merge.first_rows(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], last=True).select("user_id", "event_type", "event_id")


@query("dedupe_two_key", """
WITH r AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN page_id % 37 END AS asin, CASE WHEN page_id % 8 > 0 THEN page_id % 11 END AS name FROM pages)
SELECT min(page_id) AS page_id, 'asin' AS kind FROM r WHERE asin IS NOT NULL GROUP BY asin UNION ALL SELECT min(page_id), 'name' FROM r WHERE asin IS NULL AND name IS NOT NULL GROUP BY name""")  # fmt: skip
def dedupe_two_key(spark, d):
    """By id where there is one, by name where there is none, dropped where there is neither."""
    rows = table(spark, d, "pages").selectExpr("page_id", "CASE WHEN page_id % 4 > 0 THEN page_id % 37 END AS asin", "CASE WHEN page_id % 8 > 0 THEN page_id % 11 END AS name")
    key = F.when(F.col("asin").isNotNull(), F.struct(F.lit("asin").alias("kind"), F.col("asin").alias("v"))).when(F.col("name").isNotNull(), F.struct(F.lit("name").alias("kind"), F.col("name").alias("v")))
    return rows.withColumn("k", key).filter("k IS NOT NULL").groupBy("k").agg(F.min("page_id").alias("page_id")).select("page_id", "k.kind")


@query("product_field_merge", "SELECT o_custkey AS c, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS status, arg_min(o_orderpriority, o_orderkey) AS priority, count(*) AS n FROM orders GROUP BY o_custkey")
def product_field_merge(spark, d):
    rows = table(spark, d, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("O")))
    return rows.groupBy(F.col("o_custkey").alias("c")).agg(F.min_by("status", F.when(F.col("status").isNotNull(), F.col("o_orderkey"))).alias("status"), F.min_by("o_orderpriority", "o_orderkey").alias("priority"), F.count("*").alias("n"))


_SEED = "SELECT concat(p_brand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' Foods' WHEN 2 THEN concat(' ', p_type) ELSE concat(' ', lower(p_type), ' mix') END) AS brand, count(*) AS n FROM part GROUP BY 1"
_KEYED = f"SELECT brand, n, {DUCK.key('brand')} AS k, list_filter(string_split({DUCK.key('brand')}, ' '), lambda t: t <> 'foods') AS toks FROM ({_SEED})"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length(replace(k, ' ', '')) - 1, 2)), lambda i: substr(replace(k, ' ', ''), i, 3)))"
_PAIRS = f"""
WITH b AS (SELECT brand, n, k, toks, {_GRAMS} AS grams FROM ({_KEYED})),
p AS (SELECT a.brand AS a, c.brand AS b, a.k AS ka, c.k AS kb, len(list_intersect(a.toks, c.toks)) * 1.0 / len(list_distinct(list_concat(a.toks, c.toks))) AS jaccard,
  len(list_intersect(a.grams, c.grams)) * 1.0 / len(list_distinct(list_concat(a.grams, c.grams))) AS trigram FROM b a JOIN b c ON a.toks[1] = c.toks[1] AND a.brand < c.brand)"""


def brand_rows(spark, d):
    """Brand observations with key, significant words and trigrams of the compact key."""
    rows = sql(spark, d, _SEED, "part").withColumn("k", text.text_key("brand"))
    compact = F.replace(F.col("k"), F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(compact) - 2, F.lit(1))), lambda i: F.substr(compact, i, F.lit(3)))
    return rows.withColumn("toks", F.filter(F.split("k", " "), lambda t: t != "foods")).withColumn("grams", F.array_distinct(grams))


def brand_pairs(spark, d):
    """Linked pairs of brands of one first word, by their trigrams and words, or because one key goes on from the other."""
    rows = keep(brand_rows(spark, d).withColumn("block", F.element_at("toks", 1)), "brand-rows")
    some = brands.by_grams(rows, 0.72).unionByName(brands.by_prefix(rows)).distinct()
    both = some.join(rows.alias("x"), F.expr("a = x.brand")).join(rows.alias("y"), F.expr("b = y.brand"))
    share = lambda c: F.size(F.array_intersect(f"x.{c}", f"y.{c}")) / F.size(F.array_union(f"x.{c}", f"y.{c}"))
    out = both.select("a", "b", F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), share("toks").alias("jaccard"), share("grams").alias("trigram"))
    prefix = F.startswith("kb", F.concat("ka", F.lit(" "))) | F.startswith("ka", F.concat("kb", F.lit(" ")))
    return out.filter(((F.col("jaccard") >= 0.66) & (F.col("trigram") >= 0.72)) | prefix)


_LINKED = "(jaccard >= 0.66 AND trigram >= 0.72) OR starts_with(kb, concat(ka, ' ')) OR starts_with(ka, concat(kb, ' '))"


@query("brand_blocks_pairs", f"{_PAIRS} SELECT a, b, round(jaccard, 4) AS jaccard, round(trigram, 4) AS trigram FROM p WHERE {_LINKED}")
def brand_blocks_pairs(spark, d):
    return brand_pairs(spark, d).select("a", "b", F.round("jaccard", 4).alias("jaccard"), F.round("trigram", 4).alias("trigram"))


_REACH = f"""{_PAIRS.replace('WITH b AS', 'WITH RECURSIVE b AS')}, e AS (SELECT a, b FROM p WHERE {_LINKED}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT brand AS x, brand AS y FROM b UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a), c AS (SELECT x AS brand, min(y) AS label FROM r GROUP BY x)"""


def labelled(spark, d):
    rows = brand_rows(spark, d)
    found = graph.connected_components(brand_pairs(spark, d).select("a", "b"))
    return rows.join(found.withColumnRenamed("node", "brand"), "brand", "left").withColumn("label", F.coalesce("label", "brand"))


@query("brand_components", f"{_REACH} SELECT brand, label FROM c")
def brand_components(spark, d):
    return labelled(spark, d).select("brand", "label")


@query("brand_canonical", f"{_REACH} SELECT label, arg_min(brand, (len(toks), -n, length(k), brand)) AS canonical, count(*) AS members, CAST(sum(n) AS BIGINT) AS n FROM c JOIN b USING (brand) GROUP BY label")
def brand_canonical(spark, d):
    """The member that names its family, every family: fewest words, most seen, shortest; of equals the smallest brand."""
    score = F.struct(F.size("toks").alias("a"), (-F.col("n")).alias("b"), F.length("k").alias("c"), "brand")
    return labelled(spark, d).groupBy("label").agg(F.min_by("brand", score).alias("canonical"), F.count("*").alias("members"), F.sum("n").alias("n"))


BRANDS = brands.BrandVocabulary(aliases={"Brand#1": ("brand 1 promo", "brand 1 standard mix")}, connectors=frozenset(["foods"]), generic=frozenset(["mix"]), descriptors=frozenset(["promo", "small"]))


@query("brand_families", None)
def brand_families(spark, d):
    """Families by the whole predicate and the whole choice score; SQL has no such sequence ratio, so tests hold known names."""
    seen = table(spark, d, "part").selectExpr("concat(p_brand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' Foods' WHEN 2 THEN concat(' ', p_type) ELSE concat(' ', lower(p_type), ' mix') END) AS brand", "p_partkey")
    return brands.families(seen.groupBy("brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("ord")), BRANDS)


@query("brand_rounds", None)
def brand_rounds(spark, d):
    """Brands brought together over rounds, by starts of keys and by families; a plain loop holds the operator in tests."""
    seen = "concat(p_brand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' Foods' WHEN 2 THEN concat(' ', p_type) ELSE concat(' ', lower(p_type), ' mix') END)"
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{seen} AS brand", "CASE WHEN p_size % 8 = 1 THEN p_brand END AS source_brand", "CASE WHEN p_size % 8 = 1 THEN 'source' ELSE 'derived' END AS brand_source")
    return brands.normalised(rows, BRANDS, "p_partkey")[0].select("p_partkey", "brand")


@query("prefix_theta_join", f"SELECT a.brand AS root, count(*) AS n, min(b.brand) AS first FROM ({_KEYED}) a JOIN ({_KEYED}) b ON starts_with(b.k, concat(a.k, ' ')) GROUP BY a.brand")
def prefix_join(spark, d):
    """Brands that another one starts with: words of each prefix are made on one side, so the join is on equality."""
    rows = brand_rows(spark, d).select("brand", "k")
    words = F.split("k", " ")
    prefixes = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.size(words) - 1))).filter(F.size(words) > 1).select("brand", F.array_join(F.slice(words, F.lit(1), F.col("i")), " ").alias("k"))
    both = rows.alias("a").join(prefixes.alias("b"), "k")
    return both.groupBy(F.col("a.brand").alias("root")).agg(F.count("*").alias("n"), F.min("b.brand").alias("first"))


VOCABULARY = names.Vocabulary(
    generic=frozenset(["organic", "fresh", "milk", "tea", "snacks"]), descriptors=frozenset(["organic", "classic", "vanilla"]), stops=frozenset(["fresh", "sale", "organic"]),
    families={"Annie's": ("annie's homegrown", "annies homegrown", "annie's", "annies")},
)


@query("brand_from_name", None)
def brand_from_name(spark, d):
    """Brand and rest of a name; SQL cannot walk words, so tests hold known names."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit(" "), "p_name").alias("name"))
    return names.with_brand(rows, "name", VOCABULARY)


@query("failed_bucket", "SELECT CASE WHEN quality IS NULL OR toxic IS NULL THEN 'failed' ELSE 'classified' END AS status, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'Other' ELSE concat('C', CAST(quality AS STRING)) END AS category, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def failed_bucket(spark, d):
    """Rows without a category or subcategory go to a bucket of their own."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    failed = F.col("quality").isNull() | F.col("toxic").isNull()
    return rows.groupBy(F.when(failed, "failed").otherwise("classified").alias("status"), F.when(failed, "Other").otherwise(F.concat(F.lit("C"), F.col("quality").cast("string"))).alias("category")).agg(F.count("*").alias("n"))


@query("display_names", "SELECT p_partkey, concat(array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' '), ' of 12OZ') AS name FROM part")
def display_names(spark, d):
    return table(spark, d, "part").select("p_partkey", names.display_name(F.concat("p_name", F.lit(" Of 12oz (16 fl oz) | claim"))).alias("name"))

"""Queries of the price algebra and of text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import pricing, text
from shelfwise.functions.dialect import DUCK, SPARK

from shelfwise.working import keep

from .adapters import CATALOG, catalog, duck, table

QUERIES, ORACLES = {}, {}
_RESOLVED = pricing.resolve_prices_sql(DUCK, duck(CATALOG), "regular", "prime", "cur", "promo", "p_partkey, p_name, p_brand, p_type")


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add


def resolved(spark, d):
    return pricing.resolve_prices(catalog(spark, d), "regular", "prime", "cur", "promo").withColumn("percent", pricing.discount_percent("discount"))


@query("standardize_catalog", f"SELECT p_partkey, {DUCK.key('p_name')} AS name_key, price_branch, basis_price, prime_price, discount, CAST(greatest(0, {DUCK.largest_percent('discount')}) AS INTEGER) AS percent FROM ({_RESOLVED})")
def standardize_catalog(spark, d):
    return resolved(spark, d).select("p_partkey", text.text_key("p_name").alias("name_key"), "price_branch", "basis_price", "prime_price", "discount", "percent")


@query("promo_rule_counts", f"SELECT coalesce(CAST(price_branch AS VARCHAR), 'none') AS rule, count(*) AS n, count(discount) AS with_discount FROM ({_RESOLVED}) GROUP BY 1")
def promo_rule_counts(spark, d):
    return resolved(spark, d).groupBy(F.coalesce(F.col("price_branch").cast("string"), F.lit("none")).alias("rule")).agg(F.count("*").alias("n"), F.count("discount").alias("with_discount"))


_TEXT = "concat(CAST(l_linenumber * 3 AS STRING), '% to ', CAST(CAST(floor(l_discount * 100 + 0.5) AS INT) AS STRING), ' % off')"


@query("discount_sort_value", f"SELECT l_returnflag, {DUCK.largest_percent(_TEXT)} AS percent, count(*) AS n FROM lineitem GROUP BY ALL")
def discount_sort_value(spark, d):
    found = table(spark, d, "lineitem").withColumn("t", F.expr(_TEXT))
    return found.groupBy("l_returnflag", pricing.discount_percent("t").alias("percent")).agg(F.count("*").alias("n"))


@query("price_sort_nulls_last", f"SELECT p_partkey, rank() OVER (ORDER BY try_cast(nullif(regexp_extract(coalesce(prime_price, basis_price), '\\$([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) NULLS LAST, {DUCK.key('p_name')}, p_partkey) AS place FROM ({_RESOLVED})")
def price_sort_nulls_last(spark, d):
    """The place of every part, those without a price last: ranges of the order are ranked each by itself, after the rows of the ranges before."""
    order = (F.asc_nulls_last("v"), F.asc("k"), F.asc("p_partkey"))
    priced = resolved(spark, d).select("p_partkey", pricing.first_price(F.coalesce("prime_price", "basis_price")).alias("v"), text.text_key("p_name").alias("k"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(priced.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "price-ranges")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")  # one row a range
    return dealt.join(F.broadcast(before), "part").select("p_partkey", (F.rank().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")).alias("place"))


@query("list_sale_percent", "SELECT p_partkey, CASE WHEN l <= 0 OR s >= l THEN NULL ELSE concat(CAST(CAST(round_even(100 - s * 100.0 / l, 0) AS INTEGER) AS VARCHAR), '% off') END AS discount FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS l, CAST(floor(p_retailprice) AS BIGINT) - p_partkey % 7 * 16 AS s FROM part)")
def list_sale_percent(spark, d):
    """List and sale price to per cent off; none where the sale is not below the list."""
    both = table(spark, d, "part").selectExpr("p_partkey", "CAST(floor(p_retailprice) AS BIGINT) AS l", "CAST(floor(p_retailprice) AS BIGINT) - p_partkey % 7 * 16 AS s")
    return both.selectExpr("p_partkey", "CASE WHEN l <= 0 OR s >= l THEN NULL ELSE concat(CAST(CAST(bround(100 - s * CAST(100 AS DOUBLE) / l, 0) AS INT) AS STRING), '% off') END AS discount")


@query("offer_value_parse", f"""
SELECT p_partkey, CASE WHEN hi IS NOT NULL THEN concat('$', lo, ' to $', hi) WHEN one IS NOT NULL THEN concat('$', one) END AS price,
  CASE WHEN v LIKE '%\\%%' ESCAPE '\\' OR lower(v) LIKE 'buy%' OR lower(v) LIKE '%bogo%' THEN v END AS discount, concat('target:', substr(sha1(concat(p_name, '|', v, '|')), 1, 16)) AS offer_id
FROM (SELECT *, nullif(regexp_extract(v, '\\$([0-9.]+) - \\$([0-9.]+)', 1), '') AS lo, nullif(regexp_extract(v, '\\$([0-9.]+) - \\$([0-9.]+)', 2), '') AS hi, nullif(regexp_extract(v, '^\\$([0-9.]+)', 1), '') AS one
  FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN concat('$', CAST(p_size AS VARCHAR), '.50 - $', CAST(p_size + 3 AS VARCHAR), '.00') WHEN 1 THEN concat('$', CAST(p_size AS VARCHAR), '.99') WHEN 2 THEN concat(CAST(p_size AS VARCHAR), '% off') ELSE 'Buy 1 get 1' END AS v FROM part))""")  # fmt: skip
def offer_value_parse(spark, d):
    """An offer's value text to a price, a range or a promotion, and the offer's id from its texts."""
    made = table(spark, d, "part").selectExpr("p_partkey", "p_name", "CASE p_partkey % 4 WHEN 0 THEN concat('$', p_size, '.50 - $', p_size + 3, '.00') WHEN 1 THEN concat('$', p_size, '.99') WHEN 2 THEN concat(p_size, '% off') ELSE 'Buy 1 get 1' END AS v")
    lo, hi = (F.nullif(F.regexp_extract("v", r"\$([0-9.]+) - \$([0-9.]+)", n), F.lit("")) for n in (1, 2))
    one = F.nullif(F.regexp_extract("v", r"^\$([0-9.]+)", 1), F.lit(""))
    promo = F.contains(F.col("v"), F.lit("%")) | F.startswith(F.lower("v"), F.lit("buy")) | F.contains(F.lower("v"), F.lit("bogo"))
    return made.select("p_partkey", F.when(hi.isNotNull(), F.concat(F.lit("$"), lo, F.lit(" to $"), hi)).when(one.isNotNull(), F.concat(F.lit("$"), one)).alias("price"), F.when(promo, F.col("v")).alias("discount"), F.concat(F.lit("target:"), F.substring(F.sha1(F.concat("p_name", F.lit("|"), "v", F.lit("|"))), 1, 16)).alias("offer_id"))


@query("price_labels", f"SELECT p_partkey, coalesce(prime_price, basis_price, 'See price') AS label, concat_ws(' · ', nullif(p_brand, ''), CASE WHEN percent > 0 THEN concat(CAST(percent AS VARCHAR), '% off') END, CASE WHEN prime_price IS NOT NULL THEN 'Prime' END) AS meta FROM (SELECT *, greatest(0, {DUCK.largest_percent('discount')}) AS percent FROM ({_RESOLVED}))")
def price_labels(spark, d):
    r = resolved(spark, d)
    meta = F.concat_ws(" · ", text.blank_to_null("p_brand"), F.when(F.col("percent") > 0, F.concat(F.col("percent").cast("string"), F.lit("% off"))), F.when(F.col("prime_price").isNotNull(), F.lit("Prime")))
    return r.select("p_partkey", F.coalesce("prime_price", "basis_price", F.lit("See price")).alias("label"), meta.alias("meta"))


@query("unit_price_format", "SELECT p_partkey, concat('$', CAST(c // 100 AS VARCHAR), '.', lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '/', CASE p_size % 3 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' ELSE 'ea' END) AS unit_price FROM (SELECT *, CAST(floor(p_retailprice * 100 / p_size) AS BIGINT) AS c FROM part WHERE p_size > 0)")
def unit_price_format(spark, d):
    unit = F.expr("CASE p_size % 3 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' ELSE 'ea' END")
    priced = table(spark, d, "part").filter("p_size > 0").withColumn("c", F.expr("CAST(floor(p_retailprice * 100 / p_size) AS BIGINT)"))
    return priced.select("p_partkey", F.concat(F.expr(pricing.money(SPARK, "c")), F.lit("/"), unit).alias("unit_price"))


@query("text_keys", f"SELECT doc_id, md5({DUCK.key('text')}) AS text_key, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS compact, length({DUCK.key('text')}) AS n FROM documents")
def text_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.text_key("text")).alias("text_key"), F.md5(text.compact_key("text")).alias("compact"), F.length(text.text_key("text")).cast("long").alias("n"))


@query("brand_keys", f"SELECT s_suppkey, {DUCK.key(chr(39) + 'The Farmer’s ' + chr(39) + ' || s_name').replace('coalesce(', 'replace(coalesce(').replace(', ' + chr(39) * 2 + ')', ', ' + chr(39) * 2 + '), ' + chr(39) + '’' + chr(39) + ', ' + chr(39) * 2 + ')', 1)} AS brand_key, replace({DUCK.key('s_name')}, ' ', '-') AS slug FROM supplier")
def brand_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.brand_key(F.concat(F.lit("The Farmer’s "), "s_name")).alias("brand_key"), text.slug("s_name").alias("slug"))


_FUZZY = "trim(lower(concat(p_name, ' & Co. ', CAST(p_size AS STRING), ' oz , x-y/z')))"
for _old, _new in text.FUZZY:
    _FUZZY = f"replace({_FUZZY}, '{_old}', '{_new}')"


@query("fuzzy_norm", f"SELECT p_partkey, trim(regexp_replace({_FUZZY}, '\\s+', ' ', 'g')) AS name FROM part")
def fuzzy_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fuzzy_key(F.concat("p_name", F.lit(" & Co. "), F.col("p_size").cast("string"), F.lit(" oz , x-y/z"))).alias("name"))


PHRASES = ("the", "cherry", "potato", "tomato paste", "box", "is", "of the", "on", "steel", "brush")


@query("phrase_match_variants", " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER ({' OR '.join(f'contains(h, {chr(39)} {v} {chr(39)})' for v in text.variants(p))}) AS n FROM (SELECT concat(' ', {DUCK.key('text')}, ' ') AS h FROM documents)" for p in PHRASES))
def phrase_match_variants(spark, d):
    """Documents that have each phrase as whole words: one pass, one counter a phrase, then unpivoted."""
    counted = table(spark, d, "documents").select(text.text_key("text").alias("h")).agg(*(F.count_if(text.has_phrase("h", p)).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n")) for i, p in enumerate(PHRASES)))).alias("x")).select("x.*")


@query("word_vs_substring", f"SELECT lang, count(*) FILTER (contains(lower(text), 'the')) AS as_substring, count(*) FILTER (contains(concat(' ', {DUCK.key('text')}, ' '), ' the ')) AS as_word FROM documents GROUP BY lang")
def word_vs_substring(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count_if(text.has_any(F.lower("text"), ["the"])).alias("as_substring"), F.count_if(text.has_word("text", "the")).alias("as_word"))


_TYPED = "concat(p_name, CASE p_size % 9 WHEN 0 THEN ' Organic Milk' WHEN 1 THEN ' chicken vegan' WHEN 2 THEN ' Sweet Potato' WHEN 3 THEN ' potato Protein' WHEN 4 THEN ' popcorn gluten-free' WHEN 5 THEN ' Whole Blueberries non gmo' WHEN 6 THEN ' cornbread' ELSE '' END)"


def _ladder() -> str:
    out = []
    for terms, sign in text.EMOJI:
        yes = " OR ".join(f"contains(n, '{t}')" for t in terms if t[0] != "!")
        no = "".join(f" AND NOT contains(n, '{t[1:]}')" for t in terms if t[0] == "!")
        out.append(f"WHEN ({yes}){no} THEN '{sign}'")
    return f"CASE {' '.join(out)} ELSE '{text.NO_EMOJI}' END"


@query("emoji_ladder", f"SELECT p_partkey, {_ladder()} AS emoji FROM (SELECT p_partkey, lower({_TYPED}) AS n FROM part)")
def emoji_ladder(spark, d):
    return table(spark, d, "part").select("p_partkey", text.emoji(F.expr(_TYPED)).alias("emoji"))


_TAG_SQL = ", ".join("CASE WHEN {} THEN '{}' END".format(" OR ".join(f"contains(n, '{w}')" for w in words), tag) for tag, words in text.TAGS)


@query("tags_array", f"SELECT p_partkey, coalesce(array_to_string(list_sort(list_filter([{_TAG_SQL}, CASE WHEN p_partkey % 3 = 0 THEN 'multi-source deal' WHEN p_partkey % 3 = 1 THEN 'flyer-only deal' END, CASE WHEN p_partkey % 2 = 0 THEN 'prime deal' END], lambda x: x IS NOT NULL)), ','), '') AS tags FROM (SELECT p_partkey, lower({_TYPED}) AS n FROM part)")
def tags_array(spark, d):
    sources = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Flyer"), F.lit("All Deals"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("Flyer"))).otherwise(F.array(F.lit("All Deals")))
    found = text.tags(F.expr(_TYPED), F.lit(None).cast("string"), F.lit(""), sources, F.size(sources), F.when(F.col("p_partkey") % 2 == 0, F.lit("$1")))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("tags"))


_NAME = "CASE s_suppkey % 6 WHEN 0 THEN 'WFM' WHEN 1 THEN ' H-Mart ' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL WHEN 4 THEN 'target' ELSE s_name END"
_LINK = "CASE s_suppkey % 5 WHEN 0 THEN 'https://www.Target.com/p' WHEN 1 THEN 'https://hmart.com' ELSE NULL END"


@query("retailer_normalize", f"""SELECT s_suppkey, CASE WHEN {DUCK.key(_NAME)} IN ('whole foods', 'whole foods market', 'wfm') THEN 'Whole Foods' WHEN {DUCK.key(_NAME)} = 'target' THEN 'Target' WHEN {DUCK.key(_NAME)} IN ('h mart', 'hmart') THEN 'H Mart'
  WHEN {DUCK.key(_NAME)} NOT IN ('', 'unknown') THEN trim({_NAME}) WHEN lower({_LINK}) LIKE '%target.com%' THEN 'Target' WHEN lower({_LINK}) LIKE '%hmart%' THEN 'H Mart' ELSE 'Whole Foods' END AS retailer FROM supplier""")  # fmt: skip
def retailer_normalize(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.retailer(F.expr(_NAME), F.expr(_LINK), F.array().cast("array<string>")).alias("retailer"))


@query("feature_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split({DUCK.key('concat(p_name, ' + chr(39) + ' ' + chr(39) + ', p_brand, ' + chr(39) + ' ' + chr(39) + ', p_type)')}, ' ')) AS token FROM part) WHERE length(token) >= 2 GROUP BY token")
def feature_tokens(spark, d):
    words = F.split(text.text_key(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ")
    return table(spark, d, "part").select(F.explode(words).alias("token")).filter(F.length("token") >= 2).groupBy("token").agg(F.count("*").alias("n"))

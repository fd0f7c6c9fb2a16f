"""Queries of single records: ids, texts, signatures, lookups, overrides, probe differences, sorts, samples, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import fields
from shelfwise.functions.dialect import DUCK
from shelfwise.functions.text import blank_to_null, text_key
from shelfwise.operators import lookups, ranks

from .adapters import OFFERS, duck, offers, sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


_LINKED = """(SELECT p_partkey, concat('/Grocery/Product/b', lpad(CAST(p_partkey AS STRING), 9, '0'), '?x=1') AS link,
  concat('new B', lpad(CAST(p_partkey % 50 AS STRING), 9, '0'), ', old B', lpad(CAST(p_size AS STRING), 9, 'X'), ' B123 xB', lpad('1', 9, '0'), ' B', lpad(CAST(p_partkey % 50 AS STRING), 9, '0')) AS body,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('Join Prime to buy this item at  $', CAST(p_size AS STRING), '.50/lb now') END AS prime FROM part)"""


@query("ids_of_texts", f"""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('B', lpad(CAST(p_partkey AS STRING), 9, '0')) END AS id,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([concat('B', lpad(CAST(p_partkey % 50 AS STRING), 9, '0')), concat('B', lpad(CAST(p_size AS STRING), 9, 'X'))])), ',') END AS ids,
  CASE WHEN p_partkey % 4 > 0 THEN concat('$', CAST(p_size AS STRING), '.50/lb') END AS prime FROM part""")  # fmt: skip
def ids_of_texts(spark, d):
    rows = sql(spark, d, f"SELECT * FROM {_LINKED} AS x", "part")
    link = F.when(F.col("p_partkey") % 9 == 0, F.replace(F.col("link"), F.lit("Product"), F.lit("search"))).otherwise(F.col("link"))
    body = F.when(F.col("p_partkey") % 7 != 0, F.col("body"))
    return rows.select("p_partkey", fields.id_of_link(link).alias("id"), F.array_join(fields.ids_of_text(body), ",").alias("ids"), fields.prime_price_text(F.col("prime")).alias("prime"))


@query("tile_texts", """
SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN concat(p_name, ' & <', p_brand, '>') END AS tidy, concat(left(concat(p_name, ' & <', p_brand, '>'), 12), '...<truncated>') AS short,
  concat(p_name, ' &amp; &lt;', p_brand, '&gt;') AS html FROM part WHERE length(p_name) > 6""")  # fmt: skip
def tile_texts(spark, d):
    rows = table(spark, d, "part").filter("length(p_name) > 6").withColumn("x", F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">")))
    spaced = F.when(F.col("p_partkey") % 6 > 0, F.concat(F.lit(" \n"), F.replace(F.col("x"), F.lit(" "), F.lit(" \t ")), F.lit("  *"))).otherwise(F.lit(" * "))
    tidy = F.nullif(fields.tidy(spaced), F.lit("*"))
    return rows.select("p_partkey", tidy.alias("tidy"), fields.shortened(F.col("x"), 12).alias("short"), fields.escaped(F.col("x")).alias("html"))


@query("durations", """
SELECT event_id, CASE WHEN s >= 3600 THEN concat(CAST(s // 3600 AS VARCHAR), 'h ', lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0'), 'm')
  WHEN s >= 60 THEN concat(CAST(s // 60 AS VARCHAR), 'm ', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 's') ELSE concat(CAST(s AS VARCHAR), 's') END AS shown
FROM (SELECT event_id, CAST(greatest(0, (event_id % 23 - 2) * (event_id % 411)) AS BIGINT) AS s FROM events)""")  # fmt: skip
def durations(spark, d):
    seconds = (F.col("event_id") % 23 - 2) * (F.col("event_id") % 411)
    return table(spark, d, "events").select("event_id", fields.duration(seconds).alias("shown"))


_SUMMARY = """(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('B', CAST(p_partkey AS STRING)) END AS asin, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('/p/', CAST(p_partkey AS STRING)) END AS url,
  p_name AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS size FROM part)"""


@query("compact_records", f"""
SELECT p_partkey, coalesce(nullif(asin, ''), nullif(url, ''), name) AS id, concat('{{', array_to_string(list_filter([
  CASE WHEN asin <> '' THEN concat('"asin":"', asin, '"') END, CASE WHEN url <> '' THEN concat('"url":"', url, '"') END, concat('"name":"', name, '"'),
  CASE WHEN brand <> '' THEN concat('"brand":"', brand, '"') END, CASE WHEN size IS NOT NULL THEN concat('"size":', CAST(size AS STRING)) END,
  CASE WHEN p_partkey % 2 = 0 THEN '"tags":["a"]' END], lambda x: x IS NOT NULL), ','), '}}') AS record FROM {_SUMMARY} AS x""")  # fmt: skip
def compact_records(spark, d):
    """Records without empty fields, as JSON, and the id that stands for each."""
    rows = sql(spark, d, f"SELECT * FROM {_SUMMARY} AS x", "part")
    rows = rows.withColumn("tags", F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    record = fields.compact_json(rows.schema, ["asin", "url", "name", "brand", "size", "tags"])
    return rows.select("p_partkey", fields.product_id(F.col("asin"), F.col("url"), F.col("name")).alias("id"), record.alias("record"))


_SIGNED = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'H-Mart' END AS retailer, CASE WHEN p_size % 4 = 0 THEN '#' WHEN p_size % 4 = 1 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS sub, p_name AS name FROM part)"
_RETAILER = f"CASE WHEN coalesce(retailer, '') = '' THEN 'whole foods' ELSE {DUCK.key('retailer')} END"
_BRAND_SIGN = f"CASE WHEN {DUCK.key('brand')} <> '' THEN concat('brand:', {_RETAILER}, ':', {DUCK.key('brand')}) ELSE concat('name:', {_RETAILER}, ':', {DUCK.key('name')}) END"
_SUB_SIGN = f"CASE WHEN {DUCK.key('brand')} <> '' THEN concat('subcategory:', {_RETAILER}, ':', {DUCK.key('brand')}, ':', {{s}}) ELSE concat('subcategory:', {_RETAILER}, ':', {{s}}) END"
_PAGE = "CASE WHEN coalesce(retailer, '') = '' THEN 'whole foods' ELSE lower(retailer) END"


@query("signatures", f"""
SELECT p_partkey, {_BRAND_SIGN} AS brand_signature, {_SUB_SIGN.format(s="CASE WHEN sub = '' THEN 'pantry' ELSE " + DUCK.key('sub') + " END")} AS subcategory_signature,
  CASE WHEN coalesce(brand, '') <> '' THEN concat('brand:', {_PAGE}, ':', lower(brand)) ELSE concat('name:', {_PAGE}, ':', lower(name)) END AS page_signature FROM {_SIGNED} AS x""")  # fmt: skip
def signatures(spark, d):
    """What a brand or subcategory override is looked up by, on the server and on the page."""
    rows = sql(spark, d, f"SELECT * FROM {_SIGNED} AS x", "part")
    c, none = F.col, F.lit(None).cast("string")
    return rows.select(
        "p_partkey", fields.brand_signature(c("retailer"), c("brand"), none, c("name")).alias("brand_signature"),
        fields.subcategory_signature(c("retailer"), c("brand"), c("sub"), none).alias("subcategory_signature"),
        fields.brand_signature(c("retailer"), c("brand"), none, c("name"), key=lambda x: F.lower(x)).alias("page_signature"),
    )


@query("has_deal", "SELECT p_brand, CAST(count(*) FILTER (p_partkey % 3 = 0 OR p_size % 7 = 0 OR p_partkey % 11 = 5) AS BIGINT) AS deals FROM part GROUP BY p_brand")
def has_deal(spark, d):
    rows = table(spark, d, "part").withColumns({"a": F.when(F.col("p_partkey") % 3 == 0, "10% off").otherwise(""), "b": F.when(F.col("p_size") % 7 == 0, "$1"), "c": F.when(F.col("p_partkey") % 11 == 5, "$2").otherwise("")})
    return rows.groupBy("p_brand").agg(F.count_if(fields.has_deal(F.col("a"), F.col("b"), F.col("c"))).alias("deals"))


@query("category_walk_last", f"SELECT product, max(ord) AS ord, arg_max_null(price, ord) AS price FROM {OFFERS} AS x WHERE percent >= 3 OR coalesce(price, '') <> '' GROUP BY product")
def category_walk(spark, d):
    """Rows with any deal, the last seen of each product."""
    rows = offers(spark, d).filter((F.col("percent") >= 3) | fields.has_deal(F.col("price")))
    return rows.groupBy("product").agg(F.max("ord").alias("ord"), F.max_by("price", "ord").alias("price"))


@query("interesting_urls", "SELECT page_id FROM pages WHERE contains(url, '/es/') OR contains(url, 'utm_source') OR contains(url, 'search?')")
def interesting_urls(spark, d):
    tokens = ("/es/", "utm_source", "search?")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(F.coalesce("url", F.lit("")), F.lit(t))
    return table(spark, d, "pages").filter(hit).select("page_id")


@query("array_membership", "SELECT DISTINCT l_orderkey AS k, true AS hit FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def array_membership(spark, d):
    """Rows of which any id is in a set: ids exploded, met by equality, keys joined back."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_partkey").alias("ids"))
    wanted = table(spark, d, "part").filter("p_size = 7").select("p_partkey")
    return lookups.with_any_id(rows, "ids", wanted, "k").select("k", F.lit(True).alias("hit"))


@query("array_membership_anti", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) = 0")
def array_membership_anti(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderkey").alias("ids"), F.count("*").alias("n"))
    wanted = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    return lookups.with_any_id(rows, "ids", wanted, "k", anti=True).select("k", "n")


@query("point_lookup_array", "SELECT p_partkey, p_name FROM part WHERE p_name = 'cold widget' OR p_brand = 'cold widget' OR list_contains([p_type, p_name], 'cold widget') ORDER BY p_partkey LIMIT 1")
def point_lookup_array(spark, d):
    """Equality or membership, the first row."""
    rows = table(spark, d, "part").withColumn("ids", F.array("p_type", "p_name"))
    return lookups.point_lookup(rows, "p_name", "ids", "cold widget", "p_partkey").select("p_partkey", "p_name")


_FIXES = "SELECT c_custkey AS item, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('K', CAST(c_custkey AS VARCHAR)) END AS o FROM customer WHERE c_custkey % 3 = 0"


@query("override_joins", f"""
SELECT c.c_custkey, coalesce(nullif(k.o, ''), nullif(s.o, ''), c.c_mktsegment) AS value, coalesce(nullif(k.o, ''), nullif(s.o, '')) IS NOT NULL AS overridden
FROM customer c LEFT JOIN ({_FIXES}) k ON k.item = c.c_custkey LEFT JOIN (SELECT n_nationkey, concat('S', n_name) AS o FROM nation WHERE n_nationkey < 8) s ON s.n_nationkey = c.c_nationkey""")  # fmt: skip
def override_joins(spark, d):
    """An override by key beats one by signature, and an empty one is none."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("sign"), F.col("c_mktsegment").alias("value"))
    by_key = rows.filter("item % 3 = 0").select("item", F.when(F.col("item") % 6 == 0, "").otherwise(F.concat(F.lit("K"), F.col("item").cast("string"))).alias("override"))
    by_sign = table(spark, d, "nation").filter("n_nationkey < 8").select(F.col("n_nationkey").alias("sign"), F.concat(F.lit("S"), "n_name").alias("override"))
    return lookups.overridden(rows, "item", "sign", by_key, by_sign, "value").select(F.col("item").alias("c_custkey"), "value", "overridden")


@query("probe_difference", """
WITH l AS (SELECT user_id * 100 + event_id % 7 AS url, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1),
r AS (SELECT user_id * 100 + event_id % 7 AS url, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(l.url, r.url) AS url, CASE WHEN r.s IS NULL THEN 'left' WHEN l.s IS NULL THEN 'right' ELSE 'both' END AS side, l.s AS left_statuses, r.s AS right_statuses
FROM l FULL JOIN r ON l.url = r.url WHERE l.s IS NULL OR r.s IS NULL OR l.s <> r.s""")  # fmt: skip
def probe_difference(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 7).alias("url"), "event_type", "event_id")
    found = lookups.probe_difference(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "url", "event_type")
    return found.select("url", "side", F.array_join("left_statuses", ",").alias("left_statuses"), F.array_join("right_statuses", ",").alias("right_statuses"))


@query("store_labels", f"SELECT store AS s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, '') AS raw, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE CAST(store AS STRING) END AS label, n FROM (SELECT store, count(*) AS n FROM {OFFERS} AS x GROUP BY 1) JOIN supplier ON s_suppkey = store")
def store_labels(spark, d):
    """Stores by their label, or their id where the dimension has none."""
    raw = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("label"))
    counts = offers(spark, d).groupBy(F.col("store").alias("s_suppkey")).agg(F.count("*").alias("n"))
    named = lookups.labelled(counts, raw.filter("s_suppkey % 4 <> 0"), "s_suppkey", "label")
    return named.join(raw.withColumnRenamed("label", "raw"), "s_suppkey").select("s_suppkey", "raw", "label", "n")


@query("affected_rows", f"SELECT brand_signature AS signature, count(*) AS n FROM (SELECT {_BRAND_SIGN} AS brand_signature FROM {_SIGNED} AS x) WHERE brand_signature IN (SELECT {_BRAND_SIGN} FROM {_SIGNED} AS x WHERE p_partkey % 40 = 2) GROUP BY 1")
def affected_rows(spark, d):
    """How many rows a change of brand reaches: those of the same signature."""
    rows = signatures(spark, d).select("p_partkey", F.col("brand_signature").alias("signature"))
    changed = rows.filter("p_partkey % 40 = 2").select("signature")
    return rows.join(changed, "signature", "left_semi").groupBy("signature").agg(F.count("*").alias("n"))


@query("answers_by_place", """
WITH c AS (SELECT c_custkey, c_mktsegment, (rn - 1) // 20 AS chunk, CAST((rn - 1) % 20 + 1 AS INTEGER) AS local_id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer)),
a AS (SELECT c_mktsegment, chunk, local_id, concat('label ', CAST(local_id % 3 AS VARCHAR)) AS label FROM c WHERE local_id % 5 > 0)
SELECT c.c_custkey, a.label FROM c LEFT JOIN a USING (c_mktsegment, chunk, local_id)""")  # fmt: skip
def answers_by_place(spark, d):
    """Answers to a prompt's rows, by chunk and number."""
    from shelfwise.sources import sinks

    asked = sinks.chunked(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 20)
    asked = asked.withColumn("chunk", F.concat_ws("/", "c_mktsegment", "chunk"))
    answers = asked.filter("local_id % 5 > 0").select("chunk", "local_id", F.concat(F.lit("label "), (F.col("local_id") % 3).cast("string")).alias("label"))
    return lookups.answered(asked, answers, "chunk", "local_id").select("c_custkey", "label")


@query("preferred_targets", """
WITH m AS (SELECT conv_id, turn, role, contains(lower(text), 'the of') OR contains(lower(text), 'prime') AS hit FROM conversations)
SELECT conv_id, turn, role, hit AS first FROM m WHERE hit OR conv_id NOT IN (SELECT conv_id FROM m WHERE hit)""")  # fmt: skip
def preferred_targets(spark, d):
    """The rows that a context speaks for, or all where it speaks for none; what it speaks for comes first."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.contains(low, F.lit("the of")) | F.contains(low, F.lit("prime"))
    rows = lookups.preferred_or_all(table(spark, d, "conversations").withColumn("first", hit), "conv_id", F.col("first"))
    return rows.select("conv_id", "turn", "role", "first")


@query("seeded_sample", "SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy', 'promo') ORDER BY md5(concat('17:', CAST(p_partkey AS STRING))), p_partkey LIMIT 50")
def seeded_sample(spark, d):
    rows = table(spark, d, "part").filter(F.lower("p_type").isin("economy", "promo"))
    return lookups.seeded_sample(rows, "p_partkey", 17, 50).select("p_partkey")


def _top(name: str, sql_order: str, order, columns: str, source: str = "part", most: int = 100):
    names = [c.strip() for c in columns.split(",")]

    @query(name, f"SELECT {columns}, CAST(row_number() OVER (ORDER BY {sql_order}) AS INTEGER) AS place FROM (SELECT * FROM {source} ORDER BY {sql_order} LIMIT {most})")
    def f(spark, d):
        return lookups.ordered(table(spark, d, source), order(), most).select(*names, "place")

    return f


def _whole(name: str, sql_order: str, order, columns: str, source: str = "part"):
    """Every row with its place in the order."""
    names = [c.strip() for c in columns.split(",")]

    @query(name, f"SELECT {columns}, row_number() OVER (ORDER BY {sql_order}) AS place FROM {source}")
    def f(spark, d):
        return ranks.numbered(table(spark, d, source), order()).select(*names, "place")

    return f


_KEY = DUCK.key("p_name")
_whole("catalog_sort", f"-(p_size % 5), {_KEY}, p_partkey", lambda: (F.desc(F.col("p_size") % 5), text_key("p_name").asc(), F.asc("p_partkey")), "p_partkey")
_whole("rank_sort", "coalesce(CASE WHEN p_size % 3 > 0 THEN p_partkey END, 9999), p_partkey", lambda: (F.coalesce(F.when(F.col("p_size") % 3 > 0, F.col("p_partkey")), F.lit(9999)).asc(), F.asc("p_partkey")), "p_partkey")
_top("queue_sort", "p_size % 4, -round(p_retailprice, 0), p_name, p_partkey", lambda: (F.asc(F.col("p_size") % 4), F.desc(F.round("p_retailprice", 0)), F.asc("p_name"), F.asc("p_partkey")), "p_partkey, p_name")
_whole("label_sort", "coalesce(nullif(p_type, 'PROMO'), ''), p_name, p_partkey", lambda: (F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("")).asc(), F.asc("p_name"), F.asc("p_partkey")), "p_partkey, p_type")
_top("head_sample", "p_partkey", lambda: (F.asc("p_partkey"),), "p_partkey, p_name", most=25)
_whole("key_sorted_output", "lpad(CAST(p_partkey % 1000 AS VARCHAR), 6, '0'), p_partkey", lambda: (F.lpad((F.col("p_partkey") % 1000).cast("string"), 6, "0").asc(), F.asc("p_partkey")), "p_partkey")


@query("sorted_counts", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand <> 'Brand#5' GROUP BY 1")
def sorted_counts(spark, d):
    """Counts of values that are not empty, most first."""
    return lookups.counted(table(spark, d, "part").withColumn("value", F.when(F.col("p_brand") != "Brand#5", F.col("p_brand")).otherwise("")), "value")


@query("disagreement_counts", """
SELECT count(*) AS audited, CAST(count(*) FILTER (quality <> label % 2) AS BIGINT) AS category_disagreements, CAST(count(*) FILTER (toxic <> label % 3) AS BIGINT) AS subcategory_disagreements,
  CAST(count(*) FILTER (label IS NULL) AS BIGINT) AS failures FROM labels LEFT JOIN embeddings ON vec_id = doc_id""")  # fmt: skip
def disagreement_counts(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "embeddings").selectExpr("vec_id AS doc_id", "label"), "doc_id", "left")
    return both.agg(F.count("*").alias("audited"), F.count_if(F.expr("quality <> label % 2")).alias("category_disagreements"), F.count_if(F.expr("toxic <> label % 3")).alias("subcategory_disagreements"), F.count_if(F.col("label").isNull()).alias("failures"))


@query("brand_set_digest", "SELECT p_type, count(DISTINCT coalesce(p_brand, '')) AS brands, md5(string_agg(DISTINCT coalesce(p_brand, ''), '|' ORDER BY coalesce(p_brand, ''))) AS digest FROM part GROUP BY p_type")
def brand_set_digest(spark, d):
    """The set of brands as one value: rounds of brand normalisation end when it stays."""
    one = table(spark, d, "part").groupBy("p_type", F.coalesce("p_brand", F.lit("")).alias("b")).agg(F.count("*").alias("n"))
    return one.groupBy("p_type").agg(F.count("*").alias("brands"), F.md5(F.array_join(F.array_sort(F.collect_list("b")), "|")).alias("digest"))


@query("validation_report", """
SELECT 'flyer' AS dataset, count(*) AS n, CAST(count(*) FILTER (p_size % 7 = 0 OR p_type = 'PROMO') AS BIGINT) AS problems FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'all_deals', count(*), CAST(count(*) FILTER (p_size % 7 = 0 OR p_type = 'PROMO') AS BIGINT) FROM part WHERE p_partkey % 2 = 1""")  # fmt: skip
def validation_report(spark, d):
    """Rows and rows with a missing field of two datasets, in one pass."""
    from shelfwise.operators import audit

    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, "i").alias("image"), F.when(F.col("p_type") != "PROMO", "u").otherwise("").alias("url"))
    dataset = F.when(F.col("p_partkey") % 2 == 0, "flyer").otherwise("all_deals")
    return rows.groupBy(dataset.alias("dataset")).agg(F.count("*").alias("n"), F.count_if(audit.missing_fields("image", "url") != "").alias("problems"))


@query("detail_ranks", """
SELECT o_orderkey, l_linenumber, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + l_linenumber / 1000.0 ELSE l_linenumber END AS rank, details
FROM (SELECT l_orderkey AS o_orderkey, unnest(range(1, count(*) + 1)) AS l_linenumber, count(*) AS details FROM lineitem GROUP BY 1)""")  # fmt: skip
def detail_ranks(spark, d):
    """Details of a promotion: its rank and the detail's number in thousandths, or the number alone where it has no rank."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("details"))
    some = rows.select("o_orderkey", "details", F.explode(F.sequence(F.lit(1), F.col("details"))).alias("l_linenumber"))
    rank = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") + F.col("l_linenumber") / 1000.0).otherwise(F.col("l_linenumber"))
    return some.select("o_orderkey", "l_linenumber", rank.cast("double").alias("rank"), "details")


@query("retry_delays", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(value / 10, 2.0) ELSE 2.0 * pow(2, event_id % 5) END AS seconds FROM events")
def retry_delays(spark, d):
    after = F.when(F.col("event_id") % 3 == 0, (F.col("value") / 10).cast("string")).otherwise(F.when(F.col("event_id") % 3 == 1, "soon"))
    return table(spark, d, "events").select("event_id", fields.retry_delay(after, F.col("event_id") % 5, 2.0).alias("seconds"))


@query("score_summary", "SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 THEN embedding[1] WHEN vec_id % 4 < 3 THEN embedding[2] ELSE embedding[3] END, 4) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def score_summary(spark, d):
    """Locked, else category, else subcategory score."""
    v = F.col("embedding").cast("array<double>")
    locked, category, sub = F.when(F.col("vec_id") % 4 == 0, F.get(v, F.lit(0))), F.when(F.col("vec_id") % 4 < 3, F.get(v, F.lit(1))), F.get(v, F.lit(2))
    return table(spark, d, "embeddings").select("vec_id", fields.first_score(*(s.cast("string") for s in (locked, category, sub))).alias("score"))


@query("speed_up", "SELECT user_id % 10 AS mode, round(sum(value) FILTER (event_type = 'click') / sum(value) FILTER (event_type = 'view'), 2) AS speed_up FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0")
def speed_up(spark, d):
    """Elapsed time of one way over another, by a pivot."""
    sums = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("mode")).pivot("event_type", ["click", "view"]).agg(F.sum("value"))
    return sums.filter("click IS NOT NULL AND view IS NOT NULL").select("mode", F.round(F.col("click") / F.col("view"), 2).alias("speed_up"))


@query("blank_ids", "SELECT p_partkey, array_to_string(list_filter([trim(p_brand), CASE WHEN p_size % 2 = 0 THEN trim(p_type) END], lambda x: x IS NOT NULL AND x <> ''), ',') AS ids FROM part")
def blank_ids(spark, d):
    """Ids trimmed, blank ones left out."""
    raw = F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("  "))), F.lit("  "))
    ids = F.filter(F.transform(raw, lambda x: blank_to_null(F.trim(x))), lambda x: x.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.array_join(ids, ",").alias("ids"))


_WORDY = """(SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Produce' WHEN 1 THEN 'Pantry' WHEN 2 THEN 'Beverages' WHEN 3 THEN 'Dairy & Eggs' WHEN 4 THEN 'Alcohol' WHEN 5 THEN 'Other' ELSE 'Frozen' END AS category,
  concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' Tea' WHEN 1 THEN ' steak' WHEN 2 THEN ' Vitamin-C oil' WHEN 3 THEN ' shampoo' WHEN 4 THEN ' pizza, select kinds' WHEN 5 THEN ' and water' WHEN 6 THEN ' SALMON fillets' WHEN 7 THEN ' fruit spread preserves 12 fl oz' ELSE ' barrel' END) AS name FROM part)"""


@query("suspicious_labels", f"""
SELECT CASE WHEN category = 'Other' THEN 'Failed fallback bucket.' WHEN category = 'Produce' AND k IN (0, 3, 5) THEN 'Produce label with packaged/drink/supplement/personal-care words.'
  WHEN category = 'Pantry' AND k IN (2, 3) THEN 'Pantry label with likely wellness or personal-care words.' WHEN category = 'Beverages' AND k = 3 THEN 'Beverage label with non-drink words.'
  WHEN category = 'Dairy & Eggs' AND k = 4 THEN 'Dairy label with possible prepared/frozen/snack/dairy-alternative ambiguity.' WHEN category = 'Alcohol' AND k = 5 THEN 'Alcohol label with likely non-alcohol product words.' END AS reason, count(*) AS n
FROM (SELECT *, p_partkey % 9 AS k FROM {_WORDY} AS x) GROUP BY 1""")  # fmt: skip
def suspicious_labels(spark, d):
    from shelfwise.operators import audit

    rows = sql(spark, d, f"SELECT * FROM {_WORDY} AS x", "part")
    return rows.groupBy(audit.suspicious_reason(F.col("category"), text_key("name")).alias("reason")).agg(F.count("*").alias("n"))


@query("promo_heuristics", f"SELECT p_partkey, p_partkey % 9 IN (4, 5) AS grouped, p_partkey % 9 IN (3, 6) AS fresh FROM {_WORDY} AS x")
def promo_heuristics(spark, d):
    """Names of several products in one promotion, and of a fresh counter's items (parts of words count: shampoo holds ham)."""
    from shelfwise.operators import audit

    rows = sql(spark, d, f"SELECT * FROM {_WORDY} AS x", "part")
    return rows.select("p_partkey", audit.holds_any(F.col("name"), audit.GROUPED).alias("grouped"), audit.holds_any(F.col("name"), audit.FRESH_COUNTER).alias("fresh"))


@query("rule_haystacks", """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 7 THEN concat(p_name, ' fruit spread 12  fluid ounce u') WHEN p_partkey % 9 = 2 THEN concat(p_name, ' vitamin c oil u') WHEN p_partkey % 9 = 4 THEN concat(p_name, ' pizza select kinds u')
  ELSE concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' tea' WHEN 1 THEN ' steak' WHEN 3 THEN ' shampoo' WHEN 5 THEN ' and water' WHEN 6 THEN ' salmon fillets' ELSE ' barrel' END, ' u') END AS haystack FROM part""")  # fmt: skip
def rule_haystacks(spark, d):
    from shelfwise.functions.text import haystack

    rows = sql(spark, d, f"SELECT * FROM {_WORDY} AS x", "part")
    return rows.select("p_partkey", haystack(F.col("name"), F.lit(""), F.lit("/U/")).alias("haystack"))

"""Queries of the catalog audit, dataset comparison, windows, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.functions.dialect import DUCK
from shelfwise.operators import audit, crawl, digests, merge
from shelfwise.sources import landed, sinks
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


@query("category_counts", "SELECT coalesce(nullif(p_type, ''), 'Pantry') AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, d):
    return table(spark, d, "part").groupBy(F.coalesce(text.blank_to_null("p_type"), F.lit("Pantry")).alias("category")).agg(F.count("*").alias("n"))


@query("multi_dim_counts", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())")
def multi_dim_counts(spark, d):
    """Several group-bys in one pass."""
    return sql(spark, d, "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS g FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), ())", "lineitem")


@query("confidence_histogram", "SELECT CASE WHEN c >= 0.9 THEN '0.90-1.00' WHEN c >= 0.75 THEN '0.75-0.89' WHEN c >= 0.55 THEN '0.55-0.74' WHEN c >= 0.35 THEN '0.35-0.54' ELSE '0.00-0.34' END AS bucket, count(*) AS n FROM (SELECT CAST(p_partkey % 101 AS DOUBLE) / 100 AS c FROM part) GROUP BY 1")
def confidence_histogram(spark, d):
    c = (F.col("p_partkey") % 101).cast("double") / 100
    return table(spark, d, "part").groupBy(audit.confidence_bucket(c).alias("bucket")).agg(F.count("*").alias("n"))


@query("store_presence", f"SELECT store, count(*) AS n, count(DISTINCT product) AS products FROM {OFFERS} AS x GROUP BY store")
def store_presence(spark, d):
    return offers(spark, d).groupBy("store").agg(F.count("*").alias("n"), F.count_distinct("product").alias("products"))


_BY = f"SELECT product, count(DISTINCT store) AS stores, count(DISTINCT coalesce(price, '-')) AS prices, count(DISTINCT source) AS sources FROM {OFFERS} AS x GROUP BY product"


def by_product(spark, d):
    """Null is a value of its own among prices."""
    return offers(spark, d).groupBy("product").agg(F.count_distinct("store").alias("stores"), F.count_distinct(F.coalesce("price", F.lit("-"))).alias("prices"), F.count_distinct("source").alias("sources"))


@query("store_price_diff", f"SELECT product, prices FROM ({_BY}) WHERE stores > 1 AND prices > 1")
def store_price_diff(spark, d):
    return by_product(spark, d).filter("stores > 1 AND prices > 1").select("product", "prices")


@query("store_source_diff", f"SELECT product, sources FROM ({_BY}) WHERE stores > 1 AND sources > 1")
def store_source_diff(spark, d):
    return by_product(spark, d).filter("stores > 1 AND sources > 1").select("product", "sources")


@query("single_store_items", f"SELECT count(*) AS n FROM ({_BY}) WHERE stores = 1")
def single_store_items(spark, d):
    return by_product(spark, d).filter("stores = 1").agg(F.count("*").alias("n"))


@query("word_clusters", f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(string_split({DUCK.key('text')}, ' ')) AS token FROM documents) WHERE length(token) >= 4 AND token NOT IN ('with', 'that', 'from') AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY ALL HAVING count(*) >= 3")
def word_clusters(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.split(text.text_key("text"), " ")).alias("token"))
    good = words.filter((F.length("token") >= 4) & ~F.col("token").isin("with", "that", "from") & ~F.col("token").rlike("^[0-9]+$"))
    return good.groupBy("lang", "token").agg(F.count("*").alias("n")).filter("n >= 3")


@query("near_duplicate_groups", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k, count(*) AS n, count(DISTINCT coalesce(p_brand, '-')) AS brands FROM part GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT coalesce(p_brand, '-')) > 1 OR count(DISTINCT coalesce(p_type, '-')) > 1)")
def near_duplicate_groups(spark, d):
    g = table(spark, d, "part").groupBy(text.compact_key("p_name").alias("k")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("p_brand", F.lit("-"))).alias("brands"), F.count_distinct(F.coalesce("p_type", F.lit("-"))).alias("types"))
    return g.filter("n > 1 AND (brands > 1 OR types > 1)").select("k", "n", "brands")


@query("source_overlap", f"SELECT sources, count(*) AS n FROM (SELECT product, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {OFFERS} AS x GROUP BY product) GROUP BY sources")
def source_overlap(spark, d):
    one = offers(spark, d).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return one.groupBy("sources").agg(F.count("*").alias("n"))


_AUDIT = "SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN 'i' ELSE '' END AS image, CASE WHEN p_partkey % 5 > 0 THEN 'u' END AS url, CASE WHEN p_partkey % 3 > 0 THEN '$1' END AS price, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '85% off' WHEN 2 THEN 'bogo' ELSE '10% off' END AS promo, CASE p_partkey % 4 WHEN 1 THEN 85 WHEN 3 THEN 10 END AS percent, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Produce' WHEN 2 THEN concat(p_brand, ' Foods') ELSE p_type END AS brand, p_brand FROM part"


def audited(spark, d):
    return sql(spark, d, _AUDIT, "part")


@query("data_quality_reasons", f"SELECT p_partkey, concat_ws('; ', CASE WHEN image = '' THEN 'Missing image' END, CASE WHEN url IS NULL THEN 'Missing product URL' END, CASE WHEN price IS NULL THEN 'Missing sale/current price' END, CASE WHEN promo = '' THEN 'Missing discount text' END, CASE WHEN percent >= 80 THEN 'Very high discount percent' END, CASE WHEN percent IS NULL AND promo <> '' THEN 'Discount text did not parse into percent' END) AS reasons FROM ({_AUDIT})")
def data_quality(spark, d):
    return audited(spark, d).select("p_partkey", audit.data_reasons(*(F.col(c) for c in ("image", "url", "price", "promo", "percent"))).alias("reasons"))


@query("brand_quality", f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN brand = '' THEN 'Missing brand.' WHEN lower(brand) IN ('fresh produce', 'produce', 'unknown', 'none', 'select') THEN 'Suspicious generic brand.' WHEN NOT contains(regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g')) AND NOT contains(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g')) THEN 'Brand differs from source_brand.' END AS reason FROM ({_AUDIT})) GROUP BY reason")
def brand_quality(spark, d):
    return audited(spark, d).groupBy(audit.brand_reason(F.col("brand"), F.col("p_brand")).alias("reason")).agg(F.count("*").alias("n"))


@query("required_fields", f"SELECT p_partkey, concat_ws(',', CASE WHEN image = '' THEN 'image' END, CASE WHEN url IS NULL THEN 'url' END, CASE WHEN price IS NULL THEN 'price' END, CASE WHEN promo = '' THEN 'promo' END, CASE WHEN brand = '' THEN 'brand' END) AS missing FROM ({_AUDIT}) WHERE image = '' OR url IS NULL OR price IS NULL OR promo = '' OR brand = ''")
def required_fields(spark, d):
    return audited(spark, d).select("p_partkey", audit.missing_fields("image", "url", "price", "promo", "brand").alias("missing")).filter("missing <> ''")


@query("suspicious_category", "SELECT CASE WHEN regexp_matches(t, '(^| )(the|of)( |$)') THEN 'Packaged words.' WHEN regexp_matches(t, '(^| )(de|la)( |$)') THEN 'Personal-care words.' END AS reason, count(*) AS n FROM (SELECT {} AS t FROM documents) GROUP BY 1".format(DUCK.key("text")))
def suspicious_category(spark, d):
    t = table(spark, d, "documents").select(text.text_key("text").alias("t"))
    reason = F.when(F.col("t").rlike("(^| )(the|of)( |$)"), "Packaged words.").when(F.col("t").rlike("(^| )(de|la)( |$)"), "Personal-care words.")
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("audit_summary", f"SELECT count(*) AS total, count(*) FILTER (brand = '') AS no_brand, count(*) FILTER (percent IS NULL) AS no_percent, concat(CAST(CAST(count(*) FILTER (image = '') * 100.0 / count(*) AS DECIMAL(6, 1)) AS VARCHAR), '%') AS no_image FROM ({_AUDIT})")
def audit_summary(spark, d):
    return audited(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("brand") == "").alias("no_brand"), F.count_if(F.col("percent").isNull()).alias("no_percent"), audit.share(F.count_if(F.col("image") == ""), F.count("*")).alias("no_image"))


@query("change_report", "SELECT a AS old, b AS new, count(*) AS n FROM (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) WHERE a <> b GROUP BY ALL")
def change_report(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("new"), F.lag("event_type").over(w).alias("old")).filter("old <> new").groupBy("old", "new").agg(F.count("*").alias("n"))


@query("brand_samples", "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_name))[1:3], '|') AS samples FROM part GROUP BY p_brand")
def brand_samples(spark, d):
    parts = table(spark, d, "part")
    first = parts.select("p_brand", "p_name").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name"))).filter("rn <= 3")
    samples = first.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("samples"))
    counts = parts.groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.join(samples, counts["p_brand"].eqNullSafe(samples["p_brand"]), "left").select(counts["p_brand"], "n", F.coalesce("samples", F.lit("")).alias("samples"))


_LABEL_TEXT = """concat('{"category": "Q', CAST(quality AS STRING), '", "doc_id": ', CAST(doc_id AS STRING), ', "flagged": ', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, '}')"""


@query("label_digest", f"""
SELECT quality, count(*) AS n, substr(sha256(concat('[', string_agg({_LABEL_TEXT}, ', ' ORDER BY doc_id), ']')), 1, 16) AS digest FROM labels GROUP BY quality""")
def label_digest(spark, d):
    """Order-sensitive digest of a whole label set, as of one JSON array."""
    found = digests.ordered_digest(table(spark, d, "labels"), ["quality"], ["doc_id"], F.expr(_LABEL_TEXT))
    return found.select("quality", "n", F.substring("digest", 1, 16).alias("digest"))


@query("url_parts", "SELECT scheme, host, count(*) AS n FROM (SELECT nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS scheme, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host FROM pages) GROUP BY ALL")
def url_parts(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, d, "pages").groupBy(part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#:]+)").alias("host")).agg(F.count("*").alias("n"))


@query("combined_counts", f"SELECT source, count(*) AS n, count(DISTINCT product) AS entities FROM {OFFERS} AS x GROUP BY source UNION ALL SELECT 'merged', count(*), count(DISTINCT product) FROM {OFFERS} AS y")
def combined_counts(spark, d):
    rows = offers(spark, d)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("product").alias("entities")).unionByName(rows.agg(F.lit("merged").alias("source"), F.count("*").alias("n"), F.count_distinct("product").alias("entities")))


@query("fk_violations", "SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def fk_violations(spark, d):
    """Foreign keys as anti-joins."""
    t = lambda n: table(spark, d, n)
    bad = lambda name, child, key, parent, pkey: t(child).join(t(parent).select(F.col(pkey).alias(key)), key, "left_anti").agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
    return bad("orders", "orders", "o_custkey", "customer", "c_custkey").unionByName(bad("lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey")).unionByName(bad("customer", "customer", "c_nationkey", "nation", "n_nationkey"))


@query("check_violations", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') OR value < 0 GROUP BY event_type")
def check_violations(spark, d):
    return table(spark, d, "events").filter(~F.col("event_type").isin("click", "view", "purchase") | (F.col("value") < 0)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("asin_membership_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def asin_membership(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("dataset_overlap", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k")
def dataset_overlap(spark, d):
    rows = table(spark, d, "lineitem")
    sides = rows.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("l"), F.max((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30)).alias("r")).filter("l OR r")
    return sides.agg(F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(~F.col("r")).alias("only_left"), F.count_if(~F.col("l")).alias("only_right"))


@query("ids_intersect", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 1")
def ids_intersect(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.filter("l_returnflag = 'R'").select("l_suppkey").intersect(rows.filter("l_linenumber = 1").select("l_suppkey"))


@query("ids_except", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def ids_except(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.filter("l_returnflag = 'R'").select("l_partkey").subtract(rows.filter("l_returnflag = 'N'").select("l_partkey"))


@query("miss_buckets", f"""WITH k AS (SELECT item_id, {DUCK.key('text')} AS t FROM benchmark), dt AS (SELECT DISTINCT {DUCK.key('text')} AS t FROM documents)
SELECT CASE WHEN t IN (SELECT t FROM dt) THEN 'strict' WHEN contains(t, ' of the ') THEN 'grouped' WHEN length(t) < 150 THEN 'fresh' ELSE 'missing' END AS bucket, count(*) AS n FROM k GROUP BY 1""")  # fmt: skip
def miss_buckets(spark, d):
    """Exclusive reasons why a row has no match, first that holds."""
    items = table(spark, d, "benchmark").select(text.text_key("text").alias("t"))
    found = table(spark, d, "documents").select(text.text_key("text").alias("t")).distinct().withColumn("hit", F.lit(True))
    bucket = F.when(F.col("hit"), "strict").when(text.has_any("t", [" of the "]), "grouped").when(F.length("t") < 150, "fresh").otherwise("missing")
    return items.join(found, "t", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("first_seen_per_run", "WITH f AS (SELECT user_id, min(CAST(extract(day FROM ts) AS BIGINT)) AS run FROM events GROUP BY user_id) SELECT run, count(*) AS new_ids, CAST(sum(count(*)) OVER (ORDER BY run) AS BIGINT) AS total FROM f GROUP BY run")
def first_seen(spark, d):
    """Ids new in each run and their running total, over one row a run."""
    f = table(spark, d, "events").groupBy("user_id").agg(F.min(F.dayofmonth("ts")).cast("long").alias("run"))
    return f.groupBy("run").agg(F.count("*").alias("new_ids")).withColumn("total", F.sum("new_ids").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)))


@query("batch_stop_cut", """
WITH x AS (SELECT conv_id, turn, role, text, length(text) AS n, lag(length(text)) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, CASE WHEN n <= before THEN 1 ELSE 0 END AS stale FROM x), g AS (SELECT *, sum(CASE WHEN stale = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS grp FROM s),
c AS (SELECT *, sum(stale) OVER (PARTITION BY conv_id, grp ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS streak FROM g)
SELECT conv_id, min(turn) AS stop FROM c WHERE streak >= 2 GROUP BY conv_id""")  # fmt: skip
def batch_stop_cut(spark, d):
    """The first batch at which two in a row brought nothing new: gaps and islands."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("n"), F.lag(F.length("text")).over(w).alias("before")).withColumn("stale", F.when(F.col("n") <= F.col("before"), 1).otherwise(0))
    g = s.withColumn("grp", F.sum(1 - F.col("stale")).over(run))
    c = g.withColumn("streak", F.sum("stale").over(Window.partitionBy("conv_id", "grp").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)))
    return c.filter("streak >= 2").groupBy("conv_id").agg(F.min("turn").alias("stop"))


#: Batches of crawls made of events: short and empty ones, repeats, totals, failures of either status.
_CRAWL = """(SELECT run, i, i * 30 AS pos, size, CASE WHEN event_id % 43 = 0 THEN 503 WHEN event_id % 47 = 0 THEN 418 ELSE 200 END AS status, CASE WHEN event_id % 53 = 0 THEN 429 WHEN event_id % 61 = 0 THEN 403 ELSE 200 END AS products,
  CASE WHEN event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 41 = 0 THEN 0 WHEN event_id % 59 = 0 THEN size - 1 ELSE size END AS n, event_id * 13 % 50 * 10 AS first, CASE WHEN event_id % 37 = 0 THEN i * 30 + 45 WHEN event_id % 37 = 1 THEN 0 END AS total
  FROM (SELECT event_id, user_id % 150 AS run, row_number() OVER (PARTITION BY user_id % 150 ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 5 = 4 THEN 20 ELSE 30 END AS size FROM events) AS e)"""


@query("crawl_stops", f"""
WITH RECURSIVE b AS (SELECT *, list_transform(range(n), lambda k: concat('B', CAST(first + k AS VARCHAR))) AS ids FROM {_CRAWL} AS x),
s AS (
  SELECT DISTINCT run, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR[]) AS prev, CAST(0 AS BIGINT) AS stale, CAST(NULL AS BIGINT) AS total, CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS added, CAST(NULL AS VARCHAR) AS reason FROM b
  UNION ALL
  SELECT run, i, pos, CASE WHEN took THEN list_concat(seen, fresh) ELSE seen END, ids, CASE WHEN NOT took THEN stale ELSE streak END, said, requests + CASE WHEN took THEN 1 ELSE 0 END, added + CASE WHEN took THEN len(fresh) ELSE 0 END,
    CASE WHEN early IS NOT NULL THEN early WHEN n < size THEN 'short' WHEN pos + size >= 500 THEN 'window' WHEN pos + n >= said THEN 'total' WHEN streak >= 2 THEN 'stale' END
  FROM (SELECT *, early IS NULL AS took, CASE WHEN len(fresh) = 0 THEN stale + 1 ELSE 0 END AS streak FROM (
    SELECT b.run, b.i, b.pos, b.ids, b.n, b.size, s.seen, s.stale, s.requests, s.added, coalesce(nullif(b.total, 0), s.total) AS said, list_filter(b.ids, lambda x: NOT list_contains(s.seen, x)) AS fresh,
      CASE WHEN b.pos >= 500 THEN 'window' WHEN b.pos >= s.total THEN 'total' WHEN b.status <> 200 AND n = 0 THEN CASE WHEN s.requests > 0 AND b.status = 503 THEN 'status' ELSE 'error' END WHEN n = 0 THEN 'empty' WHEN b.ids = s.prev THEN 'repeat'
        WHEN b.products <> 200 THEN CASE WHEN s.requests > 0 AND b.products = 429 THEN 'products' ELSE 'products error' END END AS early
    FROM s JOIN b ON b.run = s.run AND b.i = s.i + 1 WHERE s.reason IS NULL))),
last AS (SELECT run, max(i) AS i FROM s GROUP BY run)
SELECT run, pos AS stop_at, coalesce(reason, 'end') AS reason, requests, added FROM s JOIN last USING (run, i)""")  # fmt: skip
def crawl_stops(spark, d):
    """The replay of landed batches: where each run stops, and by which rule."""
    rows = keep(crawl.reached(sql(spark, d, f"SELECT * FROM {_CRAWL} AS x", "events").withColumnRenamed("pos", "at")), "crawl-reached")
    ids = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.concat(F.lit("B"), (F.col("first") + k).cast("string"))))
    return crawl.stops(rows.withColumn("ids", ids)).withColumnRenamed("at", "stop_at")


@query("round_deltas", "SELECT role, turn, n, n - coalesce(lag(n) OVER (PARTITION BY role ORDER BY turn), 0) AS delta FROM (SELECT role, turn, count(*) AS n FROM conversations GROUP BY ALL)")
def round_deltas(spark, d):
    c = table(spark, d, "conversations").groupBy("role", "turn").agg(F.count("*").alias("n"))
    return c.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("role").orderBy("turn")), F.lit(0)))


@query("prompt_chunks", "SELECT c_mktsegment, (rn - 1) // 50 AS chunk, count(*) AS n, CAST(max((rn - 1) % 50 + 1) AS INTEGER) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) GROUP BY ALL")
def prompt_chunks(spark, d):
    c = sinks.chunked(table(spark, d, "customer"), "c_mktsegment", ["c_custkey"], 50)
    return c.groupBy("c_mktsegment", "chunk").agg(F.count("*").alias("n"), F.max("local_id").alias("last_id"))


@query("json_extract_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_extract_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@query("html_title_links", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("html_tiles", """
WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href, trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS label FROM t, unnest(range(1, len(h) + 1)) AS u(i)""")  # fmt: skip
def html_tiles(spark, d):
    """Links and labels by a tolerant parser; tests hold it against known pages."""
    return landed.read_tiles(table(spark, d, "pages"))


#: A search page and a page of offers for each part.
_TILE_PAGE = """concat('<div class="grid"><div><a data-csa-c-type="productTile" data-csa-c-content-id="B', lpad(CAST(p_partkey AS STRING), 9, '0'), '" href="/grocery/product/x?n=', CAST(p_partkey AS STRING), '"><div class="flex flex-col gap-2"><img src="i.png">',
  CASE WHEN p_size % 4 > 0 THEN concat('<span class="bds--body-2">', p_brand, '</span>') ELSE '' END, CASE WHEN p_size % 7 > 0 THEN concat('<span class="bds--heading-5"> ', p_name, ' <br>', '&amp; more</span>') ELSE '' END, '</div><span class="x bds--body-6">', p_type, '</span>',
  CASE WHEN p_size % 3 = 0 THEN '<span>Prime <b>off</b></span><span>10% off</span>' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN concat('<p>Join Prime to buy this item at $', CAST(p_size AS STRING), '.50/lb now</p>') ELSE '' END,
  '<div class="flex flex-wrap gap-2"><span class="bds--heading-5">$0</span></div><div class="flex flex-wrap gap-2"><span class="bds--heading-5">$', CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN '/lb' ELSE '' END, '</span><s><span class="line-through">$99</span></s></div></a></div>')"""
_OFFER_PAGE = """concat('<a data-test="multistory-2" href="/c/', CAST(p_partkey AS STRING), '">* zz ', p_type, ' | 20% <b>off</b> </a><div data-test="offer-card-9"><button aria-label="Show items for ', p_name, '"></button><div class="h OfferCardValue-x">',
  CASE p_size % 3 WHEN 0 THEN concat('$', CAST(p_size AS STRING), '.99') WHEN 1 THEN 'Buy 1  get 1' ELSE 'free' END, '</div><p>exp. 1/2</p><a href="http://www.target.com/p/', CAST(p_size AS STRING), '">x</a></div>')"""


def _lateral(spark, d, page: str, function: str):
    from shelfwise.sources import cards

    pages = cards.dealt_out(table(spark, d, "part"))
    cards.register(spark)
    return spark.sql(f"SELECT p.p_partkey, t.* FROM {{pages}} p, LATERAL {function}(p.html) t", pages=pages.selectExpr("p_partkey", f"{page} AS html"))


@query("search_tiles", """
SELECT p_partkey, 0 AS pos, concat('B', lpad(CAST(p_partkey AS STRING), 9, '0')) AS asin, concat(p_name, ' & more') AS name, CASE WHEN p_size % 4 > 0 THEN p_brand END AS brand, p_type AS variation, 'i.png' AS image, concat('https://www.wholefoodsmarket.com/grocery/product/x?n=', CAST(p_partkey AS STRING)) AS url,
  concat('$', CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN '/lb' ELSE '' END) AS current_price, '$99' AS basis_price, CASE WHEN p_size % 5 = 0 THEN concat('$', CAST(p_size AS STRING), '.50/lb') END AS prime_price,
  CASE WHEN p_size % 3 = 0 THEN '10% off' END AS discount, CASE WHEN p_size % 2 = 0 THEN concat('$', CAST(p_size AS STRING), '/lb') END AS unit_price FROM part WHERE p_size % 7 > 0""")
def search_tiles(spark, d):
    """Fields of search tiles: the last row of prices, the sentence of the prime price, the unit price."""
    return _lateral(spark, d, _TILE_PAGE, "search_tiles")


@query("offer_cards", """
WITH c AS (SELECT p_partkey, p_size, p_name AS name, CASE p_size % 3 WHEN 0 THEN concat('$', CAST(p_size AS STRING), '.99') WHEN 1 THEN 'Buy 1 get 1' END AS v FROM part WHERE p_size % 3 < 2)
SELECT p_partkey, 0 AS pos, concat('target:', substr(sha1(concat(name, '|', v, '|exp. 1/2')), 1, 16)) AS id, name, CAST(NULL AS VARCHAR) AS image, concat('https://www.target.com/p/', CAST(p_size AS STRING)) AS url, CASE WHEN p_size % 3 = 0 THEN v END AS current_price,
  CASE WHEN p_size % 3 = 1 THEN v END AS discount, 'exp. 1/2' AS expires, v AS value_text FROM c
UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END, concat('target:', substr(sha1(concat('zz ', p_type, '|20% off|')), 1, 16)), concat('zz ', p_type), NULL, concat('https://www.target.com/c/', CAST(p_partkey AS STRING)), NULL, '20% off', NULL, '20% off' FROM part""")
def offer_cards(spark, d):
    """Offers of cards and of deal links, whose words are told into a value and a name."""
    return _lateral(spark, d, _OFFER_PAGE, "offer_cards")


@query("page_listing_dedupe", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def page_listing(spark, d):
    return merge.first_rows(table(spark, d, "pages"), ["url"], ["page_id"]).select("url", "page_id")


@query("run_plan_grid", "SELECT n_name, r_name, n_nationkey * 100 + r_regionkey AS run FROM nation CROSS JOIN region WHERE NOT (n_regionkey = r_regionkey AND n_nationkey % 2 = 0)")
def run_plan_grid(spark, d):
    """Filters times sorts, without the runs that may be skipped: the plan of a crawl, a few rows by nature."""
    grid = table(spark, d, "nation").crossJoin(table(spark, d, "region"))
    return grid.filter("NOT (n_regionkey = r_regionkey AND n_nationkey % 2 = 0)").select("n_name", "r_name", (F.col("n_nationkey") * 100 + F.col("r_regionkey")).alias("run"))


@query("upsert_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 50 = 0")
def upsert_merge(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")).unionByName(old.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return merge.upsert(old, new, ["c_custkey"])

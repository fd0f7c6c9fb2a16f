"""Queries of the taxonomy, of labels made valid, of landed API payloads, and of a client's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.dialect import DUCK
from shelfwise.functions.text import text_key
from shelfwise.operators import record, state, taxonomy
from shelfwise.sources import items

from .adapters import duck, sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


#: A taxonomy of regions and nations; two categories share the subcategory 'Other'.
_PAIRS = "(SELECT r_name AS category, n_name AS subcategory, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'Other', 100 + r_regionkey FROM region WHERE r_regionkey < 2)"


def known_pairs(spark, d):
    return sql(spark, d, f"SELECT * FROM {_PAIRS} AS x", "nation", "region")


@query("taxonomy_pairs", f"SELECT category, subcategory FROM {_PAIRS} AS x")
def taxonomy_pairs(spark, d):
    """The tree of categories as pairs."""
    tree = known_pairs(spark, d).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "subcategory"))), lambda x: x["subcategory"]).alias("subcategories"))
    return taxonomy.pairs(tree)


@query("unique_subcategories", f"SELECT lower(subcategory) AS sub_key, min(category) AS category, min(subcategory) AS subcategory FROM (SELECT category, subcategory FROM {_PAIRS} AS x) GROUP BY 1 HAVING count(*) = 1")
def unique_subcategories(spark, d):
    return taxonomy.unique_subcategories(known_pairs(spark, d)).withColumn("sub_key", F.lower("subcategory"))


_ANSWERS = """(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(r_name) WHEN c_custkey % 4 = 1 THEN 'nowhere' ELSE r_name END AS category,
  CASE WHEN c_custkey % 9 = 0 THEN 'Other' WHEN c_custkey % 9 = 1 THEN 'unheard of' ELSE concat(' ', lower(n_name)) END AS subcategory,
  CASE c_custkey % 5 WHEN 0 THEN '1.7' WHEN 1 THEN 'sure' WHEN 2 THEN '0.123456' WHEN 3 THEN '0.9' END AS confidence, concat(c_name, repeat(' and so on', CAST(c_custkey % 30 AS INT))) AS reason
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_VALID = f"""SELECT a.*, CASE WHEN x.subcategory IS NOT NULL THEN x.category ELSE u.category END AS c, coalesce(x.subcategory, u.subcategory) AS s FROM {_ANSWERS} a
LEFT JOIN {_PAIRS} x ON {DUCK.key('x.category')} = {DUCK.key('a.category')} AND {DUCK.key('x.subcategory')} = {DUCK.key('a.subcategory')}
LEFT JOIN (SELECT min(category) AS category, min(subcategory) AS subcategory, {DUCK.key('subcategory')} AS k FROM {_PAIRS} AS y GROUP BY k HAVING count(*) = 1) u ON u.k = {DUCK.key('a.subcategory')}"""


def answers(spark, d):
    return sql(spark, d, f"SELECT * FROM {_ANSWERS} AS x", "customer", "nation", "region")


@query("model_results", f"""
SELECT c_custkey, c AS category, s AS subcategory, CAST(round(CASE confidence WHEN '1.7' THEN 1.0 WHEN '0.123456' THEN 0.1235 WHEN '0.9' THEN 0.9 ELSE 0.0 END, 4) AS DOUBLE) AS confidence,
  CASE WHEN length(reason) > 180 THEN concat(rtrim(left(reason, 177)), '...') ELSE reason END AS reason FROM ({_VALID}) WHERE s IS NOT NULL""")  # fmt: skip
def model_results(spark, d):
    """Answers that the taxonomy knows, spelt as it spells them."""
    rows = taxonomy.valid_labels(answers(spark, d), known_pairs(spark, d))
    return rows.withColumns({"confidence": taxonomy.confidence(F.col("confidence"), 0.0), "reason": taxonomy.reason(F.col("reason"))})


@query("silver_labels", f"SELECT c_custkey, c AS category, s AS subcategory, CAST(CASE confidence WHEN '1.7' THEN 0.92 WHEN '0.123456' THEN 0.55 WHEN '0.9' THEN 0.9 ELSE 0.82 END AS DOUBLE) AS confidence, 'silver' AS label_source FROM ({_VALID}) WHERE s IS NOT NULL")
def silver_labels(spark, d):
    """Labels of a model: confidence held between two bounds."""
    rows = taxonomy.valid_labels(answers(spark, d).drop("reason"), known_pairs(spark, d))
    return rows.withColumns({"confidence": taxonomy.confidence(F.col("confidence"), 0.82, 0.55, 0.92), "label_source": F.lit("silver")})


@query("reviewed_labels", f"SELECT c_custkey, c AS category, s AS subcategory, 1.0::DOUBLE AS confidence, 'manual-review' AS source FROM ({_VALID}) WHERE s IS NOT NULL AND c_custkey % 7 > 0")
def reviewed_labels(spark, d):
    """Rows that a person has reviewed in both fields, as labels; pairs that the taxonomy does not know go."""
    rows = answers(spark, d).select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("category")).otherwise("").alias("category"), "subcategory").filter("category <> '' AND subcategory <> ''")
    return taxonomy.valid_labels(rows, known_pairs(spark, d)).withColumns({"confidence": F.lit(1.0), "source": F.lit("manual-review")})


@query("taxonomy_positions", f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS p FROM {_PAIRS} AS x), c AS (SELECT category, row_number() OVER (ORDER BY min(ord)) - 1 AS i FROM k GROUP BY category)
SELECT c_custkey, CAST(c.i AS INTEGER) AS category_index, CAST(k.p AS INTEGER) AS pair_index FROM {_ANSWERS} a LEFT JOIN c ON lower(c.category) = lower(a.category)
LEFT JOIN k ON {DUCK.key('k.category')} = {DUCK.key('a.category')} AND {DUCK.key('k.subcategory')} = {DUCK.key('a.subcategory')}""")  # fmt: skip
def taxonomy_positions(spark, d):
    return taxonomy.positions(answers(spark, d).select("c_custkey", "category", "subcategory"), known_pairs(spark, d)).select("c_custkey", "category_index", "pair_index")


@query("effective_categories", f"""
SELECT coalesce(nullif(a.category, 'nowhere'), p.category, 'Pantry') AS category, count(*) AS n FROM {_ANSWERS} a LEFT JOIN (SELECT min(category) AS category, subcategory FROM {_PAIRS} AS y GROUP BY 2) p ON lower(p.subcategory) = trim(a.subcategory) GROUP BY 1""")  # fmt: skip
def effective_categories(spark, d):
    parents = taxonomy.small(known_pairs(spark, d).groupBy("subcategory").agg(F.min("category").alias("parent")).withColumn("k", F.lower("subcategory")).drop("subcategory"))
    rows = answers(spark, d).withColumn("category", F.when(F.col("category") != "nowhere", F.col("category")).otherwise("")).withColumn("k", F.trim("subcategory"))
    return rows.join(parents, "k", "left").groupBy(taxonomy.effective_category(F.col("category"), F.col("parent")).alias("category")).agg(F.count("*").alias("n"))


@query("version_gate", """
SELECT usable, count(*) AS n FROM (SELECT o_orderkey % 5 > 1 AND o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 AS usable FROM orders) GROUP BY 1""")
def version_gate(spark, d):
    """Stored taxonomies that may be used again: of the version, and not made up from an old catalog."""
    k = F.col("o_orderkey")
    version = F.when(k % 5 == 0, "bootstrap-1").when(k % 5 == 1, "fixed-taxonomy-v4").otherwise("fixed-taxonomy-v5")
    model, mode = F.when(k % 3 == 0, "bootstrap-existing-catalog"), F.when(k % 7 == 0, "bootstrap").otherwise("fixed")
    return table(spark, d, "orders").groupBy(taxonomy.usable(version, model, mode, "fixed-taxonomy-v5").alias("usable")).agg(F.count("*").alias("n"))


@query("chosen_options", """
WITH m AS (SELECT n_nationkey + 1 AS ord, n_name AS option FROM nation), a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 40 AS VARCHAR) WHEN c_custkey % 4 = 1 THEN concat(' ', lower(n_name)) WHEN c_custkey % 4 = 2 THEN left(lower(n_name), 8) ELSE '' END AS typed
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN typed <> '' THEN coalesce((SELECT option FROM m WHERE CAST(ord AS VARCHAR) = a.typed), (SELECT option FROM m WHERE regexp_replace(lower(option), '[^a-z0-9]+', ' ', 'g') = trim(regexp_replace(a.typed, '[^a-z0-9]+', ' ', 'g'))),
  (SELECT CASE WHEN count(*) = 1 THEN min(option) END FROM m WHERE contains(regexp_replace(lower(option), '[^a-z0-9]+', ' ', 'g'), trim(regexp_replace(a.typed, '[^a-z0-9]+', ' ', 'g'))))) END AS option FROM a""")  # fmt: skip
def chosen_options(spark, d):
    """What a reviewer has typed, as one option: its number, its name, or a part that one name alone has."""
    k = F.col("c_custkey")
    nations = table(spark, d, "nation")
    typed = F.when(k % 4 == 0, (k % 40).cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), F.lower("n_name"))).when(k % 4 == 2, F.left(F.lower("n_name"), F.lit(8))).otherwise("")
    asked = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", typed.alias("typed"))
    return taxonomy.chosen_option(asked, nations.select((F.col("n_nationkey") + 1).alias("ord"), F.col("n_name").alias("option"))).select("c_custkey", "option")


@query("suggested_pairs", """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 > 0 AND p_size % 2 = 0 THEN concat('model:', p_type, '/', p_name) END, CASE WHEN p_size % 3 > 0 THEN concat('current:', p_brand, '/', p_name) END], lambda x: x IS NOT NULL), ',') AS suggestions FROM part""")
def suggested_pairs(spark, d):
    """Where a suggestion comes from: the model's pair if it agrees with itself, then the present one."""
    c = F.col
    model = F.struct(c("p_type").alias("category"), F.when(c("p_size") % 5 > 0, c("p_name")).otherwise("").alias("subcategory"), F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("?").alias("subcategory_category"))
    current = F.struct(F.when(c("p_size") % 3 == 1, c("p_brand")).when(c("p_size") % 3 == 2, c("p_brand")).alias("category"), c("p_name").alias("subcategory"))
    found = table(spark, d, "part").select("p_partkey", taxonomy.suggested(model, current).alias("s"))
    return found.select("p_partkey", F.array_join(F.transform("s", lambda x: F.concat(x["origin"], F.lit(":"), x["category"], F.lit("/"), x["subcategory"])), ",").alias("suggestions"))


@query("prompt_texts", f"SELECT category, concat('a photo of ', lower(category), ' (', CAST(count(*) AS VARCHAR), ' kinds): ', string_agg(subcategory, '; ' ORDER BY subcategory)) AS prompt FROM {_PAIRS} AS x GROUP BY category")
def prompt_texts(spark, d):
    """One line a category for a prompt."""
    one = known_pairs(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("subcategory")), "; ").alias("subs"))
    return one.select("category", F.format_string("a photo of %s (%d kinds): %s", F.lower("category"), "n", "subs").alias("prompt"))


@query("typed_index_last", "SELECT concat(f, ':', v) AS k, max(doc_id) AS doc_id, arg_max(quality, doc_id) AS quality FROM (SELECT unnest(['doc', 'mod']) AS f, unnest([CAST(doc_id AS VARCHAR), CAST(doc_id % 37 AS VARCHAR)]) AS v, doc_id, quality FROM labels WHERE toxic IS NOT NULL) GROUP BY 1")
def typed_index_last(spark, d):
    """Labels by ``field:value`` keys, the last one of each."""
    from shelfwise.operators import labels as lab

    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.col("doc_id").alias("doc"), (F.col("doc_id") % 37).alias("mod"))
    return lab.typed_index(rows, ["doc", "mod"], "doc_id", ["doc_id", "quality"], F.col("toxic").isNotNull()).withColumnRenamed("key", "k")


@query("audit_retained", """
SELECT vec_id AS row_id, 'retained' AS origin, 0.5 AS score, CASE WHEN vec_id % 10 = 0 THEN 'failed' END AS error FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 1000000, 'new', round(embedding[1]::DOUBLE, 4), NULL FROM embeddings WHERE NOT (vec_id % 3 = 0 AND vec_id % 10 > 0)""")
def audit_retained(spark, d):
    """An audit that goes on from the one before: results of products that are still there stay as they are, products that are gone
    lose theirs, and products without a result, failed ones too, are audited."""
    from shelfwise.operators import incremental

    rows = table(spark, d, "embeddings").select(F.col("vec_id"), F.get(F.col("embedding").cast("array<double>"), F.lit(0)).alias("x"))
    named = lambda df, shift: df.select((F.col("vec_id") + shift).alias("row_id"), F.concat(F.lit("A"), F.col("vec_id").cast("string")).alias("asin"), F.lit("").alias("name"), "x")
    old = named(rows.filter("vec_id % 3 = 0"), 0).unionByName(named(rows.filter("vec_id % 3 = 1"), 0).withColumn("asin", F.concat(F.lit("gone"), "asin")))
    old = old.select("row_id", "asin", "name", F.lit(0.5).alias("score"), F.when(F.col("row_id") % 10 == 0, "failed").alias("error"))
    audit = lambda df: df.select("row_id", "asin", "name", F.round("x", 4).alias("score"), F.lit(None).cast("string").alias("error"))
    return incremental.carried_on(named(rows, 1_000_000), old, audit, ["asin", "name"]).select("row_id", "origin", "score", "error")


@query("api_items", """
SELECT concat('B', CAST(p_partkey AS VARCHAR)) AS asin, p_brand AS brand, p_name AS name, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN concat('u', CAST(p_size AS VARCHAR)) ELSE concat('m', CAST(p_size AS VARCHAR)) END AS image,
  concat('$', CAST(CAST(p_size AS DECIMAL(10, 2)) AS VARCHAR)) AS current_price, CASE WHEN p_size % 2 = 0 THEN concat('$', CAST(CAST(p_size + 1 AS DECIMAL(10, 2)) AS VARCHAR)) END AS basis_price,
  CASE WHEN p_size % 5 = 0 THEN '20% off' END AS discount FROM part WHERE p_partkey % 4 > 0""")  # fmt: skip
def api_items(spark, d):
    """Landed API items as flat records; those without an id go."""
    body = """to_json(named_struct('asin', CASE WHEN p_partkey % 4 > 0 THEN concat('B', p_partkey) ELSE '' END, 'brandName', p_brand, 'name', p_name,
      'productImages', CASE p_size % 3 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('url', concat('u', p_size), 'medium', 'x')) ELSE array(named_struct('url', '', 'medium', concat('m', p_size))) END,
      'offerDetails', named_struct('price', named_struct('priceAmount', p_size, 'basisPriceAmount', CASE WHEN p_size % 2 = 0 THEN p_size + 1 END, 'savings', named_struct('percentSavings', CASE WHEN p_size % 5 = 0 THEN '20% off' END)))))"""
    rows = sql(spark, d, f"SELECT {body} AS body FROM part", "part")
    return items.api_items(rows, "body").select("asin", "brand", "name", "image", "current_price", "basis_price", "discount")


@query("search_counts", """
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN conv_id + 5 WHEN conv_id % 3 = 1 THEN 7 END AS total, CAST(conv_id % 4 AS INTEGER) AS ids FROM (SELECT DISTINCT conv_id FROM conversations)""")
def search_counts(spark, d):
    """Ids of a landed search result, and the first count above zero, whether a number or a text."""
    body = """concat('{"mainResultSet":{', CASE conv_id % 3 WHEN 0 THEN concat('"availableTotalResultCount":0,"totalResultCount":"', conv_id + 5, '",') WHEN 1 THEN '"totalResultCount":"many","numberOfResults":7,' ELSE '"totalResultCount":-1,' END,
      '"searchResults":[', array_join(transform(sequence(0, CAST(conv_id % 4 AS INT)), i -> IF(i = 0, '{"x":1}', concat('{"asin":"B', i, '"}'))), ','), ']}}')"""
    rows = sql(spark, d, f"SELECT conv_id, {body} AS body FROM conversations", "conversations").distinct()
    return rows.select("conv_id", items.result_count("body").alias("total"), F.size(items.result_ids("body")).alias("ids"))


@query("profiles_made_valid", """
WITH u AS (SELECT user_id, list_sort(list(DISTINCT CAST(event_id % 3 AS VARCHAR))) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(s) = 1 THEN s[1] ELSE '' END AS store, n % 4 > 0 AS filtered FROM u""")  # fmt: skip
def profiles_made_valid(spark, d):
    """Several chosen stores count as none; whether any filter is set."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 3).cast("string")).alias("s"), F.count("*").alias("n"))
    query_, sub = F.when(F.col("n") % 4 == 1, "tea").otherwise(""), F.when(F.col("n") % 4 == 2, "x")
    least = F.when(F.col("n") % 4 == 3, "15").otherwise("0")
    return u.select("user_id", F.array_join(state.selected_stores("s"), ",").alias("store"), state.active_filters(query_, F.lit(None).cast("string"), sub, least).alias("filtered"))


@query("shelves_moved", """
WITH s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS o FROM customer GROUP BY 1),
w AS (SELECT c_nationkey, CASE WHEN list_contains(o, 'MACHINERY') THEN list_concat(['MACHINERY'], list_filter(o, lambda x: x <> 'MACHINERY')) ELSE o END AS o FROM s),
p AS (SELECT *, coalesce(list_position(o, 'BUILDING'), 0) AS i, c_nationkey % 2 = 0 AS up FROM w), t AS (SELECT *, CASE WHEN up THEN i - 1 ELSE i + 1 END AS j FROM p)
SELECT c_nationkey, array_to_string(CASE WHEN i > 0 AND j >= 1 AND j <= len(o) THEN list_transform(range(1, len(o) + 1), lambda k: CASE WHEN k = i THEN o[j] WHEN k = j THEN o[i] ELSE o[k] END) ELSE o END, ',') AS shelves FROM t""")  # fmt: skip
def shelves_moved(spark, d):
    """A shelf and its neighbour in each other's place; saved shelves that are shown come first."""
    shown = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("o"))
    order = state.working_order(F.array(F.lit("GONE"), F.lit("MACHINERY")), F.col("o"))
    return shown.select("c_nationkey", F.array_join(state.moved(order, F.lit("BUILDING"), F.col("c_nationkey") % 2 == 0), ",").alias("shelves"))


@query("local_patches", "SELECT CASE WHEN c_custkey % 9 = 0 THEN 'gold' ELSE 'model' END AS status, CASE WHEN c_custkey % 9 = 0 THEN 'Fixed' ELSE c_mktsegment END AS category, count(*) AS n FROM customer GROUP BY ALL")
def local_patches(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), F.lit("s").alias("subcategory"), F.lit("model").alias("status"))
    patches = rows.filter("c_custkey % 9 = 0").select("c_custkey", F.lit("Fixed").alias("category"), F.lit("t").alias("subcategory"))
    return state.patched(rows, patches, "c_custkey").groupBy("status", "category").agg(F.count("*").alias("n"))


@query("retailer_facet", "SELECT 0 AS place, 'All' AS retailer UNION ALL SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'FURNITURE') GROUP BY ALL")
def retailer_facet(spark, d):
    """Retailers that are there, in a fixed order, after 'All'."""
    from shelfwise.operators import lookups

    return lookups.facet(table(spark, d, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING", "FURNITURE", "NOWHERE"]).withColumnRenamed("value", "retailer")


_EVENTS = """(SELECT o_custkey AS product, o_orderkey AS ord, CASE o_orderkey % 8 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Acme Organic' WHEN 2 THEN '' WHEN 3 THEN 'Bolt' WHEN 4 THEN 'Acme Organic Dairy' WHEN 5 THEN 'acme' END AS brand,
  CASE WHEN o_orderkey % 3 > 0 THEN 'derived' ELSE 'source' END AS brand_source, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('name ', CAST(o_orderkey % 11 AS STRING)) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 10 END AS discount_percent,
  CASE WHEN o_orderkey % 13 = 0 THEN 'Fresh Produce' ELSE o_orderpriority END AS category, concat('S', CAST(o_orderkey % 3 AS STRING)) AS source, CAST(o_orderkey % 4 AS STRING) AS store FROM orders)"""


@query("entity_fold", f"""
WITH RECURSIVE e AS (SELECT product, row_number() OVER (PARTITION BY product ORDER BY ord) AS i, nullif(brand, '') AS brand, CASE WHEN brand <> '' THEN brand_source END AS bs, nullif(name, '') AS name, category, source, store FROM {_EVENTS} AS x),
f AS (
  SELECT product, i, brand, bs, name, CASE WHEN category IS NULL THEN [] ELSE [category] END AS cats, [source] AS sources, [store] AS stores FROM e WHERE i = 1
  UNION ALL
  SELECT product, i, CASE WHEN cleared THEN NULL WHEN take THEN brand ELSE fb END, CASE WHEN cleared THEN NULL WHEN take THEN 'source' ELSE fs END, CASE WHEN take AND name IS NOT NULL THEN concat(upper(name[1]), name[2:]) ELSE coalesce(held, name) END,
    CASE WHEN fresh THEN list_sort(list_distinct(list_append(cats, category))) WHEN len(cats) = 0 AND category IS NOT NULL THEN [category] ELSE cats END,
    CASE WHEN list_contains(sources, source) THEN sources ELSE list_append(sources, source) END, CASE WHEN list_contains(stores, store) THEN stores ELSE list_append(stores, store) END
  FROM (SELECT *, fresh AND NOT (take OR coalesce(fs = 'source', false)) AS cleared FROM (
    SELECT *, bs IS NOT NULL AND bs = 'source' AND (coalesce(fs <> 'source', true) OR starts_with(lower(brand), concat(lower(fb), ' '))) AS take FROM (
      SELECT e.product, e.i, e.brand, e.bs, e.name, e.category, e.source, e.store, f.name AS held, f.cats, f.sources, f.stores, coalesce(f.brand, e.brand) AS fb, CASE WHEN f.brand IS NULL THEN e.bs ELSE f.bs END AS fs, coalesce(e.category = 'Fresh Produce', false) AS fresh
      FROM f JOIN e ON e.product = f.product AND e.i = f.i + 1)))),
last AS (SELECT product, max(i) AS i FROM f GROUP BY product)
SELECT product, name, brand, bs AS brand_source, array_to_string(cats, ',') AS categories, array_to_string(sources, ',') AS sources, len(sources) AS source_count, array_to_string(stores, ',') AS stores FROM f JOIN last USING (product, i)""")  # fmt: skip
def entity_fold(spark, d):
    """The merged record of an entity: brands that sources name and that fresh rows clear, names shown again, lists in order."""
    rows = sql(spark, d, f"SELECT * FROM {_EVENTS} AS x", "orders")
    none = F.lit(None).cast("string")
    missing = {c: none for c in ("raw_name", "source_brand", "retailer", *record.OFFERED) if c != "discount_percent"}
    rows = rows.withColumns(missing | {"source_categories": F.array_compact(F.array("category")), "store_id": F.col("store")})
    out = record.merged_records(rows, "product", "ord")
    lists = lambda c, name: F.array_join(c, ",").alias(name)
    return out.select("product", "name", "brand", "brand_source", lists("source_categories", "categories"), lists("sources", "sources"), "source_count", lists("available_store_ids", "stores"))


@query("flyer_fallback", "SELECT p_partkey, 'landed' AS origin FROM part WHERE p_size = 3 UNION ALL SELECT p_partkey, 'fallback' FROM part WHERE p_size = 4 AND NOT EXISTS (SELECT 1 FROM part WHERE p_size = 3)")
def flyer_fallback(spark, d):
    """The landed rows, or those of another source where there are none."""
    parts = table(spark, d, "part")
    landed = parts.filter("p_size = 3").select("p_partkey", F.lit("landed").alias("origin"))
    return items.or_else(landed, parts.filter("p_size = 4").select("p_partkey", F.lit("fallback").alias("origin")))


@query("store_config", """
SELECT s_suppkey, CAST(s_suppkey + k AS VARCHAR) AS store_id, concat(s_name, '-', CAST(k AS VARCHAR)) AS name FROM supplier, range(2) AS r(k) WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, v.store_id, v.name FROM supplier CROSS JOIN (VALUES ('10259', 'one'), ('10260', 'two')) AS v(store_id, name) WHERE s_suppkey % 4 > 0""")
def store_config(spark, d):
    """Stores of each supplier's configuration, or the built-in ones where that is empty, broken or missing."""
    entry = lambda k: F.concat(F.lit('{"store_id": "'), (F.col("s_suppkey") + k).cast("string"), F.lit('", "name": "'), "s_name", F.lit(f'-{k}"}}'))
    body = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("["), entry(0), F.lit(", "), entry(1), F.lit("]"))).when(F.col("s_suppkey") % 4 == 1, "[]").when(F.col("s_suppkey") % 4 == 2, '{"store_id": "x"')
    return items.configured_rows(table(spark, d, "supplier").withColumn("body", body), "s_suppkey", "body", "store_id string, name string", [("10259", "one"), ("10260", "two")])


@query("keyed_state", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'remote' WHEN c_custkey % 3 = 1 THEN 'local' ELSE 'default' END AS payload FROM customer")
def keyed_state(spark, d):
    """Stored state by key: the remote one, else the local one, else the default."""
    keys = table(spark, d, "customer").select("c_custkey")
    of = lambda keep, name: keys.filter(keep).select("c_custkey", F.lit(name).alias("payload"))
    return items.first_stored(keys, [of("c_custkey % 3 = 0", "remote"), of("c_custkey % 3 < 2", "local")], "c_custkey", "payload", "default")


@query("seen_samples", f"""
WITH s AS (SELECT p_type, p_name FROM part), k AS (SELECT p_type, {DUCK.key('p_type')} AS k, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_name))[1:3], '|') AS samples FROM s GROUP BY 1)
SELECT p_type AS brand, k AS key, CASE WHEN k IN ('small', 'mini') THEN 'Small' END AS seed, k AS first_token, CASE WHEN k = 'promo' THEN 0 ELSE 1 END AS token_count, n, samples FROM k WHERE k <> 'promo'
UNION ALL SELECT p_type, k, NULL, '', 0, n, samples FROM k WHERE k = 'promo'""")
def seen_samples(spark, d):
    """Observations of a name with what it is told apart by."""
    from shelfwise.operators import brands

    words = brands.BrandVocabulary(aliases={"Small": ("mini",)}, connectors=frozenset(["promo"]))
    seen = brands.observations(table(spark, d, "part"), "p_type", "p_name", words)
    return seen.select("brand", "key", "seed", "first_token", "token_count", "n", F.array_join("samples", "|").alias("samples"))


@query("default_payloads", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '7' ELSE '' END AS stores, CASE WHEN c_custkey % 5 < 2 THEN 2 ELSE 0 END AS liked, CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END AS saved, CASE WHEN c_custkey % 5 = 0 THEN 'Dairy' ELSE '' END AS category,
  CASE WHEN c_custkey % 5 = 1 THEN '15' ELSE '0' END AS least FROM customer""")
def default_payloads(spark, d):
    """Stored profiles made valid; what is missing, broken or of another kind is as in an empty one."""
    k = F.col("c_custkey") % 5
    body = F.when(k == 0, '{"selected_store_ids": [" 7 ", ""], "liked": ["a", "b"], "saved": "no list", "filters": {"category": "Dairy"}}').when(
        k == 1, '{"selected_store_ids": ["1", "2"], "liked": ["a", "b"], "saved": ["c"], "filters": {"min_discount": "15"}}').when(k == 2, "broken").when(k == 3, "{}")
    p = table(spark, d, "customer").select("c_custkey", state.normal_profile(body).alias("p"))
    return p.select("c_custkey", F.array_join("p.selected_store_ids", ",").alias("stores"), F.size("p.liked").alias("liked"), F.size("p.saved").alias("saved"), "p.filters.category", F.col("p.filters.min_discount").alias("least"))


_BATCHES = """(SELECT c_custkey AS chunk, 3 AS expected, CASE c_custkey % 6
  WHEN 0 THEN 'Here: {"items": [{"id": 2, "index": 4, "confidence": 0.5, "reason": "b"}, {"id": "1", "index": "3", "confidence": 7}, {"id": 3, "index": 1}]} thanks'
  WHEN 1 THEN '[{"index": 1, "confidence": 0.25}, {"index": 2, "reasoning": "r"}, {"index": 3}]' WHEN 2 THEN '{"results": [{"id": 1, "index": 9}, {"id": 2, "index": 2}, {"id": 3, "index": 1}]}'
  WHEN 3 THEN '[{"index": 1}]' WHEN 4 THEN 'no answer' END AS body FROM customer)"""


@query("batch_answers", """
SELECT c_custkey AS chunk, a.local_id, a.index, a.confidence::DOUBLE AS confidence, a.reason FROM customer JOIN (VALUES (0, 1, 3, 1.0, ''), (0, 2, 4, 0.5, 'b'), (0, 3, 1, 0.0, ''), (1, 1, 1, 0.25, ''), (1, 2, 2, 0.0, 'r'), (1, 3, 3, 0.0, ''))
  AS a(kind, local_id, index, confidence, reason) ON c_custkey % 6 = a.kind""")  # fmt: skip
def batch_answers(spark, d):
    """Answers of landed batches, by id or else by place; batches that miss one give none."""
    return taxonomy.batch_answers(sql(spark, d, f"SELECT * FROM {_BATCHES} AS x", "customer"), "chunk", "body", "expected", 5)


@query("unanswered_batches", "SELECT c_custkey % 6 AS kind, count(*) AS n FROM customer WHERE c_custkey % 6 > 1 GROUP BY 1")
def unanswered_batches(spark, d):
    chunks = sql(spark, d, f"SELECT * FROM {_BATCHES} AS x", "customer")
    left = taxonomy.unanswered(chunks, taxonomy.batch_answers(chunks, "chunk", "body", "expected", 5), "chunk")
    return left.groupBy((F.col("chunk") % 6).alias("kind")).agg(F.count("*").alias("n"))


_LADDER = "(SELECT p_partkey, concat(p_brand, CASE p_size % 5 WHEN 1 THEN ' Foods' WHEN 2 THEN ' Foods Bio' WHEN 3 THEN ' Tea' ELSE '' END) AS brand FROM part WHERE p_size % 5 <> 4 AND NOT (p_brand = 'Brand#13' AND p_size % 5 = 0))"


@query("brand_fixpoint", f"""
WITH r AS (SELECT * FROM {_LADDER} AS x), b AS (SELECT DISTINCT brand FROM r)
SELECT r.p_partkey, (SELECT arg_min(b.brand, length(b.brand)) FROM b WHERE b.brand = r.brand OR starts_with(r.brand, concat(b.brand, ' '))) AS brand FROM r""")  # fmt: skip
def brand_fixpoint(spark, d):
    """Each brand gives way to the longest one that it goes on from, until the set of brands stays."""
    from shelfwise.operators import brands

    def step(rows):
        words = F.split("brand", " ")
        known = rows.select("brand").distinct()
        shorter = known.filter(F.size(words) > 1).select("brand", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("root"))
        best = shorter.join(known.withColumnRenamed("brand", "root"), "root").groupBy("brand").agg(F.max_by("root", F.length("root")).alias("root"))
        return rows.join(best, "brand", "left").select("p_partkey", F.coalesce("root", "brand").alias("brand"))

    rows, _ = brands.to_fixpoint(sql(spark, d, f"SELECT * FROM {_LADDER} AS x", "part"), "brand", step)
    return rows


@query("cluster_report", f"""
WITH RECURSIVE r AS (SELECT * FROM {_LADDER} AS x), b AS (SELECT brand, count(*) AS n FROM r GROUP BY 1), c AS (SELECT brand, n, (SELECT arg_min(y.brand, length(y.brand)) FROM b y WHERE y.brand = b.brand OR starts_with(b.brand, concat(y.brand, ' '))) AS root FROM b)
SELECT root AS canonical, string_agg(brand, '|' ORDER BY brand) AS members, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY root HAVING count(*) >= 2""")  # fmt: skip
def cluster_report(spark, d):
    """Families of two brands and more with their members and how often they are seen, most first."""
    before = sql(spark, d, f"SELECT * FROM {_LADDER} AS x", "part")
    after = brand_fixpoint(spark, d).withColumnRenamed("brand", "canonical")
    members = before.join(after, "p_partkey").groupBy("canonical", "brand").agg(F.count("*").alias("n"))
    out = members.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("brand")), "|").alias("members"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return out.filter("k >= 2").drop("k").orderBy(F.desc("n"), F.lower("canonical"))

"""Queries of labels, rules, classification and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.functions.dialect import DUCK
from shelfwise.operators import labels as lab
from shelfwise.operators import cascade, fuzzy, models, ranks, rule_table, rules

from .adapters import duck, sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return add


#: Products and labels over documents: ids, links and names, some of them empty.
_ROWS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('A', CAST(doc_id AS STRING)) END AS asin, CASE WHEN doc_id % 2 = 0 THEN concat('u', CAST(doc_id % 50 AS STRING)) ELSE '' END AS url, concat(lang, CAST(doc_id % 9 AS STRING)) AS name FROM documents"
_LABELS = "SELECT doc_id AS label_no, CASE WHEN doc_id % 2 = 0 THEN concat('A', CAST(doc_id AS STRING)) END AS asin, CASE WHEN doc_id % 5 = 0 THEN concat('u', CAST(doc_id % 50 AS STRING)) END AS url, CASE WHEN doc_id % 11 = 0 THEN concat('en', CAST(doc_id % 9 AS STRING)) END AS name, quality, toxic FROM labels"
_FIELDS = ["asin", "url", "name"]
_KEYS = """
rk AS (SELECT doc_id, 0 AS p, concat('asin:', asin) AS k FROM r WHERE asin <> '' UNION ALL SELECT doc_id, 1, concat('url:', url) FROM r WHERE url <> '' UNION ALL SELECT doc_id, 2, concat('name:', name) FROM r WHERE name <> ''),
lk AS (SELECT k, max(label_no) AS label_no FROM (SELECT concat('asin:', asin) AS k, label_no FROM l WHERE asin <> '' UNION ALL SELECT concat('url:', url), label_no FROM l WHERE url <> '' UNION ALL SELECT concat('name:', name), label_no FROM l WHERE name <> '') GROUP BY k)"""
_WITH = f"WITH r AS ({_ROWS}), l AS ({_LABELS}), {_KEYS}"


@query("label_priority_lookup", f"{_WITH}, m AS (SELECT doc_id, arg_min(label_no, p) AS label_no FROM rk JOIN lk USING (k) GROUP BY doc_id) SELECT doc_id, m.label_no, quality FROM m JOIN l ON l.label_no = m.label_no")
def label_priority_lookup(spark, d):
    return lab.lookup(sql(spark, d, _ROWS, "documents"), "doc_id", _FIELDS, sql(spark, d, _LABELS, "labels"), _FIELDS, "label_no", ["label_no", "quality"])


@query("label_coverage_semi", f"{_WITH} SELECT DISTINCT doc_id FROM rk JOIN lk USING (k)")
def label_coverage(spark, d):
    return lab.covered(sql(spark, d, _ROWS, "documents"), "doc_id", _FIELDS, sql(spark, d, _LABELS, "labels"), _FIELDS).select("doc_id")


@query("label_missing_anti", f"{_WITH} SELECT doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM rk JOIN lk USING (k))")
def label_missing(spark, d):
    return lab.covered(sql(spark, d, _ROWS, "documents"), "doc_id", _FIELDS, sql(spark, d, _LABELS, "labels"), _FIELDS, "left_anti").select("doc_id")


_IDENTITY = """
{n}k AS (SELECT id, min(p) AS p, k FROM (SELECT id, unnest([0, 1, 2, 3]) AS p, unnest([asin, url, name, extra]) AS k FROM {n}) WHERE k <> '' GROUP BY id, k)"""
_PRODUCTS = f"SELECT doc_id AS id, asin, url, name, concat('X', CAST(doc_id % 40 AS STRING)) AS extra FROM ({_ROWS}) AS r"
_GOLD = f"SELECT label_no AS id, asin, url, name, concat('X', CAST(label_no % 60 AS STRING)) AS extra FROM ({_LABELS}) AS l WHERE label_no % 2 = 0"
_CLIP = "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN concat('A', CAST(vec_id AS STRING)) END AS asin, '' AS url, concat('u', CAST(label AS STRING)) AS name, CASE WHEN vec_id % 3 = 0 THEN concat('X', CAST(vec_id AS STRING)) ELSE '' END AS extra FROM embeddings"


@query("identity_three_way", f"""
WITH p AS ({_PRODUCTS}), g AS ({_GOLD}), c AS ({_CLIP}), {_IDENTITY.format(n='p')}, {_IDENTITY.format(n='g')}, {_IDENTITY.format(n='c')},
pg AS (SELECT a.id, arg_min(b.last, (a.p, a.k)) AS gold FROM pk a JOIN (SELECT k, max(id) AS last FROM gk GROUP BY k) b USING (k) GROUP BY a.id),
pc AS (SELECT a.id, arg_min(b.last, (a.p, a.k)) AS clip FROM pk a JOIN (SELECT k, max(id) AS last FROM ck GROUP BY k) b USING (k) GROUP BY a.id)
SELECT p.id, gold, clip FROM p LEFT JOIN pg USING (id) LEFT JOIN pc USING (id)""")  # fmt: skip
def identity_three_way(spark, d):
    """Products with the gold label and the model's row that share any of their values, whatever field these stand in."""
    fields = ["asin", "url", "name"]
    of = lambda text, name: sql(spark, d, text, name).withColumn("extra", F.array("extra"))
    products = of(_PRODUCTS, "documents")
    gold = lab.identity_match(products, "id", of(_GOLD, "labels").withColumnRenamed("id", "gold"), "gold", fields, "extra")
    clip = lab.identity_match(products, "id", of(_CLIP, "embeddings").withColumnRenamed("id", "clip"), "clip", fields, "extra")
    return products.select("id").join(gold, "id", "left").join(clip, "id", "left")


@query("prior_review_carryover", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 0 THEN l.quality END, -1) AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)")
def prior_review(spark, d):
    """Reviews of before are carried over where they are complete."""
    done = table(spark, d, "labels").filter("toxic = 0").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("reviewed"))


@query("label_upsert_ordered", "SELECT doc_id, quality, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE generation END AS generation FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality, 0 AS generation FROM labels)")
def label_upsert(spark, d):
    """New labels win over old ones of their key."""
    from shelfwise.operators.merge import upsert

    old = table(spark, d, "labels").select("doc_id", "quality", F.lit(0).alias("generation"))
    return upsert(old, old.filter("doc_id % 4 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(1).alias("generation")), ["doc_id"])


_QUEUE = """
WITH x AS (SELECT doc_id, lang, CAST(doc_id % 100 AS DOUBLE) / 100 AS conf, quality, toxic, CAST((doc_id * 7) % 100 AS DOUBLE) / 100 AS clip FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT doc_id, conf, clip, CASE WHEN lang = 'en' THEN 20 ELSE 30 END AS priority FROM x WHERE conf <= 0.35 UNION ALL SELECT doc_id, conf, clip, 10 FROM x WHERE clip >= 0.75 AND conf <= 0.75 AND quality <> toxic)
SELECT doc_id, min(priority) AS priority, conf, clip FROM c GROUP BY doc_id, conf, clip"""


@query("review_queue", _QUEUE)
def review_queue(spark, d):
    """Candidates of two rules; a row that both find has the lower priority number."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").selectExpr("doc_id", "lang", "CAST(doc_id % 100 AS DOUBLE) / 100 AS conf", "quality", "toxic", "CAST((doc_id * 7) % 100 AS DOUBLE) / 100 AS clip")
    low = x.filter("conf <= 0.35").select("doc_id", "conf", "clip", F.when(F.col("lang") == "en", 20).otherwise(30).alias("priority"))
    apart = x.filter("clip >= 0.75 AND conf <= 0.75 AND quality <> toxic").select("doc_id", "conf", "clip", F.lit(10).alias("priority"))
    return low.unionByName(apart).groupBy("doc_id", "conf", "clip").agg(F.min("priority").alias("priority"))


@query("gold_sanity_queue", "SELECT doc_id, CASE WHEN quality <> label % 2 THEN 1 ELSE 2 END AS priority FROM labels JOIN embeddings ON doc_id = vec_id WHERE vec_id % 10 >= 2 AND (quality <> label % 2 OR toxic <> label % 3)")
def gold_sanity(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "embeddings").selectExpr("vec_id AS doc_id", "label"), "doc_id")
    return both.filter("doc_id % 10 >= 2 AND (quality <> label % 2 OR toxic <> label % 3)").select("doc_id", F.when(F.col("quality") != F.col("label") % 2, 1).otherwise(2).alias("priority"))


_SET = "list_distinct(string_split({}, ' '))"


@query("fuzzy_best_match_overlap", f"""
WITH b AS (SELECT item_id, {_SET.format(DUCK.key('text'))} AS t FROM benchmark),
bt AS (SELECT item_id, unnest(t) AS w, len(t) AS n FROM b), dt AS (SELECT DISTINCT doc_id, unnest(string_split({DUCK.key('text')}, ' ')) AS w FROM documents),
m AS (SELECT item_id, doc_id, count(*) AS common, min(n) AS n FROM bt JOIN dt USING (w) WHERE w <> '' GROUP BY ALL),
x AS (SELECT item_id, arg_min(doc_id, (-common, doc_id)) AS doc_id, max(common) * 1.0 / min(n) AS score FROM m GROUP BY item_id)
SELECT item_id, CASE WHEN x.score >= 0.72 THEN x.doc_id END AS doc_id, round(coalesce(x.score, 0), 3) AS score, coalesce(x.score >= 0.72, false) AS matched FROM b LEFT JOIN x USING (item_id)""")  # fmt: skip
def fuzzy_best(spark, d):
    """For each name the candidate that holds most of its words, ties to the smaller id; below 0.72 the score alone."""
    words = lambda name, own, as_: table(spark, d, name).select(F.col(own).alias(as_), fuzzy.words_of(text.text_key("text")).alias("words"))
    best = fuzzy.best_by_words(words("benchmark", "item_id", "id"), words("documents", "doc_id", "ord"))
    score = F.coalesce(F.col("common") / F.col("n"), F.lit(0.0))
    out = table(spark, d, "benchmark").select(F.col("item_id")).join(best, F.col("item_id") == F.col("id"), "left")
    return out.select("item_id", F.when(score >= fuzzy.LEAST, F.col("ord")).alias("doc_id"), F.round(score, 3).alias("score"), (score >= fuzzy.LEAST).alias("matched"))


@query("fuzzy_best_match_ratio", None)
def fuzzy_ratio(spark, d):
    """The best part name of each brand's name, of all part names, by ratio and words together. SQL has no such ratio: a test
    holds all pairs by hand."""
    from .entities import brand_rows

    names = brand_rows(spark, d).select("brand", "k")
    asked = ranks.numbered(names, ["brand"], name="id").select("id", "brand", F.col("k").alias("text"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("text"))
    best = fuzzy.best_matches(asked, known, text.text_key("text"))
    return asked.select("id", "brand").join(best, "id").select("brand", F.col("ord").alias("p_partkey"), "score", "matched")


PROFILES = {
    "Produce": {"strong": ["fresh fruit", "berry", "the"], "medium": ["fruit", "salad"], "weak": ["lemon", "in"], "exclude": ["juice", "by"]},
    "Snacks": {"strong": ["potato chips", "cookie", "of"], "medium": ["bar", "that"], "weak": ["salt", "and"], "exclude": ["soap"]},
    "Pantry": {"strong": ["olive oil", "is"], "medium": ["rice", "with"], "weak": ["can"], "exclude": ["frozen", "on"]},
}
HINTS = [("Beverages", ["coffee", "de la"], ["wine", "que"]), ("Frozen", ["ice cream", "und"], [])]


def _phrase(p: str) -> str:
    return "(" + " OR ".join(f"contains(h, ' {v} ')" for v in text.variants(p)) + ")"


_SCORES = ", ".join("{} AS s{}".format(" + ".join(f"CASE WHEN {_phrase(p)} THEN {rules.WEIGHTS[k]} ELSE 0 END" for k, ps in prof.items() for p in ps), i) for i, prof in enumerate(PROFILES.values()))
_HAY = f"SELECT doc_id, concat(' ', {DUCK.key('text')}, ' ') AS h FROM documents"


@query("category_score_top2", f"SELECT doc_id, o[1][2] AS best, -o[1][1] AS best_score, o[2][2] AS second, -o[2][1] AS second_score FROM (SELECT doc_id, list_sort([{', '.join(f'row(-s{i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(PROFILES))}]) AS o FROM (SELECT doc_id, {_SCORES} FROM ({_HAY})))")
def category_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.text_key("text").alias("h"))
    r = docs.withColumn("o", rules.ranked({c: rules.profile_score("h", p) for c, p in PROFILES.items()}))
    return r.select("doc_id", F.col("o")[0]["name"].alias("best"), (-F.col("o")[0]["s"]).alias("best_score"), F.col("o")[1]["name"].alias("second"), (-F.col("o")[1]["s"]).alias("second_score"))


_HINT_SQL = " ".join("WHEN ({}) {} THEN '{}'".format(" OR ".join(map(_phrase, i)), f"AND NOT ({' OR '.join(map(_phrase, e))})" if e else "", c) for c, i, e in HINTS)


@query("category_details", f"""SELECT doc_id, CASE WHEN hint IS NOT NULL THEN hint WHEN -o[1][1] <= 0 THEN 'Pantry' ELSE o[1][2] END AS category,
  CASE WHEN h = '  ' THEN 0.2 WHEN hint IS NOT NULL THEN 0.93 WHEN -o[1][1] <= 0 THEN 0.25 ELSE round(least(0.99, greatest(0.3, 0.35 + -o[1][1] / 40.0 + greatest(0, o[2][1] - o[1][1]) / 30.0)), 2) END AS confidence
FROM (SELECT doc_id, h, CASE {_HINT_SQL} END AS hint, list_sort([{', '.join(f'row(-s{i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(PROFILES))}]) AS o FROM (SELECT doc_id, h, {_SCORES} FROM ({_HAY})))""")  # fmt: skip
def category_details(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.text_key("text").alias("h"))
    return rules.with_category_details(docs, "h", PROFILES, HINTS).select("doc_id", "category", "confidence")


#: A rule table made of benchmark items: five rules an item, of phrases, whole words, second groups and exclusions; the fourth of each in a block of its own, which is called in place 155.
_ITEM_RULES = f"""r AS (SELECT item_id, k, w, CASE WHEN k = 3 THEN 'packaged' END AS block, item_id * 10 + k AS ord, concat('C', CAST(item_id % 7 AS STRING)) AS category, concat('S', CAST(k AS STRING)) AS subcategory
  FROM (SELECT item_id, string_split({DUCK.key('text')}, ' ') AS w FROM benchmark), range(5) AS n(k)),
t AS (SELECT block, ord, 0 AS grp, false AS whole, w[4 * k + 1] || ' ' || w[4 * k + 2] AS term FROM r UNION ALL SELECT block, ord, 0, true, CASE WHEN length(w[4 * k + 3]) >= 7 THEN w[4 * k + 3] END FROM r
  UNION ALL SELECT block, ord, 1, true, w[9] FROM r WHERE k = 1 UNION ALL SELECT block, ord, -1, true, w[2] FROM r WHERE k = 2)"""
_VALID = "NOT (category = 'C3' AND subcategory = 'S1') AND NOT (category = 'C2' AND subcategory = 'S3')"


def item_rules(spark, d):
    """The same table for ``rule_table``."""
    w = F.split(text.text_key("text"), " ")
    at = lambda n: F.try_element_at("w", n)
    items = table(spark, d, "benchmark").select("item_id", w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    term = lambda grp, whole, t: F.struct(F.lit(grp).alias("grp"), F.lit("text").alias("field"), F.lit(whole).alias("whole"), t.alias("term"))
    long_word = F.when(F.length(at(4 * F.col("k") + 3)) >= 7, at(4 * F.col("k") + 3))
    terms = F.array(
        term(0, False, F.concat(at(4 * F.col("k") + 1), F.lit(" "), at(4 * F.col("k") + 2))), term(0, True, long_word), F.when(F.col("k") == 1, term(1, True, at(F.lit(9)))), F.when(F.col("k") == 2, term(-1, True, at(F.lit(2)))),
    )
    none = F.lit(None)
    rows = items.select(
        (F.col("item_id") * 10 + F.col("k")).alias("ord"), F.when(F.col("k") == 3, "packaged").alias("block"), none.cast("string").alias("calls"), F.concat(F.lit("C"), (F.col("item_id") % 7).cast("string")).alias("category"),
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("subcategory"), F.lit(0.99).alias("confidence"), none.cast("string").alias("reason"), F.array_compact(terms).alias("terms"),
    )
    call = rows.limit(1).select(F.lit(155).cast("long").alias("ord"), none.cast("string").alias("block"), F.lit("packaged").alias("calls"), *(F.col(c) for c in ("category", "subcategory", "confidence", "reason")), F.array().cast(rows.schema["terms"].dataType).alias("terms"))
    pairs = rows.select("category", "subcategory").distinct().filter(_VALID)
    return rule_table.read_rules(rows.unionByName(call), pairs)


@query("rule_cascade", f"""
WITH {_ITEM_RULES}, d AS (SELECT doc_id, {DUCK.key('text')} AS h FROM documents),
g AS (SELECT block, ord, count(DISTINCT grp) FILTER (grp >= 0) AS n FROM t GROUP BY ALL),
hit AS (SELECT DISTINCT doc_id, block, ord, grp FROM d JOIN t ON term <> '' AND CASE WHEN whole THEN contains(concat(' ', h, ' '), concat(' ', term, ' ')) ELSE contains(h, term) END),
ok AS (SELECT doc_id, hit.block, hit.ord FROM hit JOIN g ON g.ord = hit.ord AND g.block IS NOT DISTINCT FROM hit.block GROUP BY ALL HAVING count(*) FILTER (grp >= 0) = min(n) AND count(*) FILTER (grp < 0) = 0),
firsts AS (SELECT doc_id, block, min(ord) AS ord FROM ok GROUP BY ALL),
inner_ AS (SELECT f.*, category, subcategory FROM firsts f JOIN r ON r.ord = f.ord AND r.block = f.block WHERE f.block = 'packaged' AND {_VALID}),
main AS (SELECT doc_id, ord AS place, CAST(NULL AS VARCHAR) AS block, ord FROM ok WHERE block IS NULL UNION ALL SELECT doc_id, 155, block, ord FROM inner_),
best AS (SELECT doc_id, arg_min(row(block, ord), place) AS b FROM main GROUP BY doc_id),
named AS (SELECT doc_id, b[1] AS block, b[2] AS ord FROM best)
SELECT d.doc_id, n.block, n.ord, n.category, n.subcategory FROM d LEFT JOIN (
  SELECT n.doc_id, n.block, n.ord, category, subcategory FROM named n JOIN r ON r.ord = n.ord AND r.block IS NOT DISTINCT FROM n.block WHERE {_VALID}) n ON n.doc_id = d.doc_id""")  # fmt: skip
def rule_cascade(spark, d):
    """The rule that decides each document, of some hundreds, with a block called midway and outcomes that the taxonomy lacks."""
    docs = table(spark, d, "documents").select("doc_id", text.text_key("text").alias("h"))
    found = rule_table.with_rule(docs, item_rules(spark, d), {"text": "h"})
    return found.select("doc_id", *(F.col(f"rule.{c}").alias(c) for c in ("block", "ord", "category", "subcategory")))


SUBS = {"Fruits": ["the", "fresh fruit"], "Vegetables": ["of the", "and"], "Herbs": ["is", "de la"]}
PENALTY = {"Fruits": (["by", "with"], 6)}
_SUBS = ", ".join("row(-({}{}), '{}')".format(" + ".join(f"CASE WHEN {_phrase(p)} THEN {4 if ' ' in p else 2} ELSE 0 END" for p in ps), f" - CASE WHEN {' OR '.join(map(_phrase, PENALTY[n][0]))} THEN {PENALTY[n][1]} ELSE 0 END" if n in PENALTY else "", n) for n, ps in SUBS.items())


@query("subcategory_score", f"SELECT sub, count(*) AS n FROM (SELECT CASE WHEN o[1][1] < 0 THEN o[1][2] END AS sub FROM (SELECT list_sort([{_SUBS}]) AS o FROM ({_HAY}))) GROUP BY sub")
def subcategory(spark, d):
    docs = table(spark, d, "documents").select(text.text_key("text").alias("h"))
    return docs.groupBy(rules.best_subcategory("h", SUBS, PENALTY).alias("sub")).agg(F.count("*").alias("n"))


@query("produce_guard", f"SELECT CASE WHEN src AND NOT b THEN 'Produce' WHEN c = 'Produce' AND (b OR NOT t) THEN 'Pantry' ELSE c END AS category, count(*) AS n FROM (SELECT doc_id % 7 = 0 AS src, CASE WHEN doc_id % 2 = 0 THEN 'Produce' ELSE 'Snacks' END AS c, contains(h, 'tea') OR contains(h, 'licens') AS b, {_phrase('the')} OR {_phrase('und')} AS t FROM ({_HAY})) GROUP BY 1")
def produce_guard(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.text_key("text").alias("h"))
    category = F.when(F.col("doc_id") % 2 == 0, "Produce").otherwise("Snacks")
    return docs.groupBy(rules.guarded(category, "h", ["tea", "licens"], ["the", "und"], F.col("doc_id") % 7 == 0).alias("category")).agg(F.count("*").alias("n"))


_NAMED = "SELECT p_partkey, CASE WHEN p_size = 50 THEN '' ELSE lower(p_name) END AS name, p_brand AS brand, p_type AS kind FROM part"
#: Fingerprints of the row's own values, and of what the cache holds: a third of its rows were made of another brand.
_PRINT = "sha256(concat_ws(chr(31), name, {brand}, kind))"
_LETTERS = "SELECT p_partkey, unnest(string_split(name, ' ')) AS token, kind FROM n WHERE name <> ''"


@query("classification_cascade", f"""
WITH n AS ({_NAMED}),
m AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), pr AS (SELECT label, i, avg(x) AS x FROM m GROUP BY ALL),
co AS (SELECT m.vec_id, pr.label, sum(m.x * pr.x) / (sqrt(sum(m.x * m.x)) * sqrt(sum(pr.x * pr.x))) AS c FROM m JOIN pr USING (i) GROUP BY ALL),
im AS (SELECT vec_id, arg_max(label, c) AS label, max(e) / sum(e) AS p FROM (SELECT *, exp(20 * (c - max(c) OVER (PARTITION BY vec_id))) AS e FROM co) GROUP BY vec_id),
w AS ({_LETTERS}), t AS (SELECT * FROM w WHERE p_partkey % 2 = 1),
dl AS (SELECT kind, count(DISTINCT p_partkey) AS nd, count(*) AS nt FROM t GROUP BY kind), wl AS (SELECT kind, token, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT count(DISTINCT token) AS v FROM t),
s AS (SELECT w.p_partkey, dl.kind, sum(ln((coalesce(wl.n, 0) + 1) * 1.0 / (dl.nt + v.v))) + min(ln(dl.nd * 1.0 / (SELECT sum(nd) FROM dl))) AS score
  FROM w CROSS JOIN dl CROSS JOIN v LEFT JOIN wl ON wl.kind = dl.kind AND wl.token = w.token GROUP BY w.p_partkey, dl.kind),
ml AS (SELECT p_partkey, arg_max(kind, score) AS kind, round(max(e) / sum(e), 4) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY p_partkey)) AS e FROM s) GROUP BY p_partkey),
r AS (SELECT * FROM (SELECT name, n_nationkey, row_number() OVER (PARTITION BY name ORDER BY n_nationkey) AS k FROM (SELECT DISTINCT name FROM n) JOIN nation ON contains(name, concat(chr(97 + n_nationkey), 'i'))) WHERE k = 1),
x AS (SELECT n.*, quality, toxic, im.label, im.p AS ip, ml.kind AS guess, ml.p AS mp, r.n_nationkey, c.fingerprint IS NOT NULL AS hit
  FROM n LEFT JOIN labels ON doc_id = n.p_partkey LEFT JOIN im ON vec_id = n.p_partkey LEFT JOIN ml USING (p_partkey) LEFT JOIN r USING (name)
  LEFT JOIN (SELECT DISTINCT {_PRINT.format(brand="CASE WHEN p_partkey % 9 = 0 THEN concat(brand, '-old') ELSE brand END")} AS fingerprint FROM n WHERE p_partkey % 3 = 0) c ON c.fingerprint = sha256(concat_ws(chr(31), n.name, n.brand, n.kind))),
o AS (SELECT *, CASE WHEN toxic = 1 THEN 'gold' WHEN hit THEN 'cache' WHEN quality = 0 THEN 'silver' WHEN ip >= 0.55 THEN 'image' WHEN n_nationkey <> 17 THEN 'rules' WHEN mp >= 0.2 AND guess <> 'PROMO' THEN 'model'
  WHEN ip >= 0.4 THEN 'image rescue' WHEN mp >= 0 AND guess <> 'PROMO' THEN 'model rescue' ELSE 'default' END AS stage FROM x)
SELECT p_partkey, stage, CASE stage WHEN 'gold' THEN 'Gold' WHEN 'cache' THEN 'Cached' WHEN 'silver' THEN 'Silver' WHEN 'image' THEN concat('I', CAST(label % 3 AS STRING)) WHEN 'image rescue' THEN concat('I', CAST(label % 3 AS STRING))
    WHEN 'rules' THEN concat('N', CAST(n_nationkey AS STRING)) WHEN 'default' THEN 'Pantry' ELSE guess END AS category,
  CASE stage WHEN 'gold' THEN 1.0 WHEN 'cache' THEN 0.5 WHEN 'silver' THEN 0.55 WHEN 'image' THEN 0.78 WHEN 'image rescue' THEN 0.62 WHEN 'rules' THEN 0.99 WHEN 'default' THEN 0.25 ELSE mp END AS confidence FROM o""")  # fmt: skip
def classification_cascade(spark, d):
    """Gold, cache, silver, image score, rules, model, weaker image score, weaker model, default: each asked for what is open.

    The image scores are of vectors against their labels' prototypes, the rules a table of two letters a nation (one outcome
    of which the taxonomy lacks), the model token votes of names, trained on every other product. A cache of another model
    version stands before the right one and is dropped.
    """
    rows = sql(spark, d, _NAMED, "part")
    key = ["name", "brand", "kind"]
    rows = rows.withColumn("fingerprint", lab.fingerprint(key))
    gave = lambda df, key, category, confidence: df.select(key, F.lit(category).alias("category"), F.lit("-").alias("subcategory"), F.lit(confidence).alias("confidence"))
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "p_partkey")
    old = sql(spark, d, _NAMED, "part").filter("p_partkey % 3 = 0").withColumn("brand", F.expr("CASE WHEN p_partkey % 9 = 0 THEN concat(brand, '-old') ELSE brand END"))
    before = gave(old.withColumn("fingerprint", lab.fingerprint(key)), "fingerprint", "Cached", 0.5)
    version = {k: "1" for k in cascade.CACHE_KEYS}
    stale = gave(rows, "fingerprint", "Stale", 0.5)
    vectors = table(spark, d, "embeddings")
    images = models.label_arrays(vectors, "vec_id", "embedding", models.prototypes(vectors, "label", "embedding"), "label", 20.0)
    best = F.get("scores", F.lit(0))
    image = F.struct(F.concat(F.lit("I"), (best["label"] % 3).cast("string")).alias("category"), F.lit("-").alias("subcategory"), best["p"].alias("score")).alias("image")
    rows = rows.join(images.select(F.col("vec_id").alias("p_partkey"), image), "p_partkey", "left")
    term = F.array(F.struct(F.lit(0).alias("grp"), F.lit("text").alias("field"), F.lit(False).alias("whole"), F.concat(F.chr(97 + F.col("n_nationkey")), F.lit("i")).alias("term")))
    none = F.lit(None).cast("string")
    nations = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("ord"), none.alias("block"), none.alias("calls"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("category"), F.lit("-").alias("subcategory"), F.lit(0.99).alias("confidence"), none.alias("reason"), term.alias("terms")
    )
    rules_ = rule_table.read_rules(nations, nations.filter("ord <> 17").select("category", "subcategory"))
    words = lambda df: df.filter("name <> ''").select("p_partkey", F.explode(F.split("name", " ")).alias("token"), "kind")
    votes = models.token_votes(words(rows.filter("p_partkey % 2 = 1")), "kind", "p_partkey")
    kinds = sorted(r["kind"] for r in rows.select("kind").distinct().limit(1_000).collect())  # the taxonomy
    pair = lambda c: (F.when(c != "PROMO", c), F.lit("-"))
    stages = [
        cascade.known("gold", gave(labels.filter("toxic = 1"), "p_partkey", "Gold", 1.0), "p_partkey"),
        cascade.cached(stale, version | {"model_version": "0"}, version), cascade.cached(before, version, version),
        cascade.known("silver", gave(labels.filter("quality = 0"), "p_partkey", "Silver", 0.55), "p_partkey"),
        cascade.by_image("image", *cascade.IMAGE), cascade.by_rules(rules_, {"text": "name"}),
        cascade.by_votes(votes, "kind", kinds, pair, "p_partkey", lambda df: words(df).select("p_partkey", "token")),
        cascade.by_image("image rescue", *cascade.IMAGE_RESCUE), cascade.model_rescue("kind", pair),
    ]
    found = cascade.classified(rows, stages, cascade.outcome(F.lit("Pantry"), F.lit("-"), F.lit(0.25)))
    return found.select("p_partkey", "stage", "category", "confidence")


@query("fingerprint_cache_incremental", "SELECT doc_id, sha256(concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS fingerprint FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def fingerprint_cache(spark, d):
    """Rows whose fingerprint is not in the cache of before: only these are classified anew."""
    now = table(spark, d, "documents").withColumn("fingerprint", lab.fingerprint(["lang", "source", "text"]))
    before = table(spark, d, "documents").withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("-old"))).otherwise(F.col("source"))).filter("doc_id % 3 = 0").select("doc_id", lab.fingerprint(["lang", "source", "text"]).alias("fingerprint"))
    return now.select("doc_id", "fingerprint").join(before, ["doc_id", "fingerprint"], "left_anti")


_WORDS = f"SELECT doc_id, unnest(string_split({DUCK.key('text')}, ' ')) AS token FROM documents"
_TRAIN = f"WITH w AS ({_WORDS}), t AS (SELECT w.*, quality FROM w JOIN labels USING (doc_id)), dl AS (SELECT quality, count(DISTINCT doc_id) AS nd, count(*) AS nt FROM t GROUP BY quality), wl AS (SELECT quality, token, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT count(DISTINCT token) AS v FROM t)"


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(text.text_key("text"), " ")).alias("token"))


def votes(spark, d):
    """The model of tokens, from the documents that have a quality."""
    words = table(spark, d, "documents").select("doc_id", F.split(text.text_key("text"), " ").alias("words"))
    return models.token_votes(models.labelled_words(words, table(spark, d, "labels"), "doc_id", "quality"), "quality", "doc_id")


@query("token_vote_counts", f"{_TRAIN} SELECT quality, token, n FROM wl")
def token_vote_counts(spark, d):
    return votes(spark, d)[1]


@query("naive_bayes_predict", f"""{_TRAIN}, p AS (SELECT w.doc_id, dl.quality, sum(ln((coalesce(wl.n, 0) + 1) * 1.0 / (dl.nt + v.v))) + min(ln(dl.nd * 1.0 / (SELECT sum(nd) FROM dl))) AS score
  FROM w CROSS JOIN dl CROSS JOIN v LEFT JOIN wl ON wl.quality = dl.quality AND wl.token = w.token GROUP BY w.doc_id, dl.quality)
SELECT doc_id, arg_max(quality, score) AS quality, round(max(score), 3) AS score FROM p GROUP BY doc_id""")  # fmt: skip
def naive_bayes(spark, d):
    p = models.predict_votes(tokens(spark, d), "doc_id", votes(spark, d), "quality", [0, 1])
    return p.groupBy("doc_id").agg(F.max_by("quality", "score").alias("quality"), F.round(F.max("score"), 3).alias("score"))


@query("naive_bayes_allowed", f"""{_TRAIN}, p AS (SELECT w.doc_id, dl.quality, sum(ln((coalesce(wl.n, 0) + 1) * 1.0 / (dl.nt + v.v))) + min(ln(dl.nd * 1.0 / (SELECT sum(nd) FROM dl))) AS score
  FROM w CROSS JOIN dl CROSS JOIN v LEFT JOIN wl ON wl.quality = dl.quality AND wl.token = w.token GROUP BY w.doc_id, dl.quality)
SELECT doc_id, arg_max(quality, score) AS quality, round(max(score), 3) AS score FROM p JOIN documents USING (doc_id) WHERE lang = 'en' OR (lang <> 'de' AND quality = 1) GROUP BY doc_id""")  # fmt: skip
def naive_bayes_allowed(spark, d):
    """The best label of those that a language allows; one of them allows none."""
    scores = models.predict_votes(tokens(spark, d), "doc_id", votes(spark, d), "quality", [0, 1])
    docs = table(spark, d, "documents").select("doc_id", "lang")
    allowed = docs.select("lang").distinct().filter("lang <> 'de'").select("lang", F.explode(F.when(F.col("lang") == "en", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("quality"))
    return models.best_allowed(scores, "doc_id", "quality", docs, "lang", allowed).select("doc_id", "quality", F.round("score", 3).alias("score"))


@query("training_weights", "SELECT lang, quality, CAST(sum(CASE WHEN toxic = 1 THEN 8 WHEN quality = 1 THEN 3 ELSE 1 END) AS BIGINT) AS weight, count(*) AS n FROM (SELECT DISTINCT text, lang, quality, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def training_weights(spark, d):
    """Distinct examples with a weight by the source of their label, in place of copies."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("text", "lang", "quality", "toxic").distinct()
    return rows.groupBy("lang", "quality").agg(F.sum(F.when(F.col("toxic") == 1, 8).when(F.col("quality") == 1, 3).otherwise(1)).alias("weight"), F.count("*").alias("n"))


@query("tfidf_logistic", None)
def tfidf(spark, d):
    """Not bit-equal between engines: tests hold label validity and accuracy."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("double").alias("quality"))
    rows = models.counted_texts(rows, "text")
    return models.tfidf_classifier(rows, "text", "quality").transform(rows).select("doc_id", "quality", "prediction")


_PROTO = "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT x.vec_id, m.label, sum(x.x * m.x) / (sqrt(sum(x.x * x.x)) * sqrt(sum(m.x * m.x))) AS cosine FROM x JOIN m USING (i) GROUP BY ALL), e AS (SELECT *, exp(100 * (cosine - max(cosine) OVER (PARTITION BY vec_id))) AS e FROM c), p AS (SELECT vec_id, label, cosine, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM e)"


def scored(spark, d):
    vectors = table(spark, d, "embeddings")
    return models.label_arrays(vectors, "vec_id", "embedding", models.prototypes(vectors, "label", "embedding"), "label")


@query("embedding_softmax_topk", f"{_PROTO} SELECT vec_id, label, round(cosine, 4) AS cosine, round(p, 4) AS p, rank FROM p WHERE rank <= 3")
def embedding_softmax(spark, d):
    top = scored(spark, d).select("vec_id", F.explode(F.slice("scores", 1, 3)).alias("s"))
    return top.select("vec_id", "s.label", F.round("s.cosine", 4).alias("cosine"), F.round("s.p", 4).alias("p"), F.col("s.rank").cast("long").alias("rank"))


@query("embedding_locked_pair", f"{_PROTO}, g AS (SELECT vec_id, label % 3 AS category, arg_max(label, p) AS label, sum(p) AS total FROM p GROUP BY ALL), best AS (SELECT vec_id, arg_max(category, total) AS category FROM g GROUP BY vec_id) SELECT best.vec_id, best.category, g.label FROM best JOIN g ON g.vec_id = best.vec_id AND g.category = best.category")
def embedding_locked(spark, d):
    """The best label inside the best category."""
    return scored(spark, d).select("vec_id", models.locked_pair("scores", lambda x: x % 3).alias("b")).select("vec_id", "b.category", "b.label")

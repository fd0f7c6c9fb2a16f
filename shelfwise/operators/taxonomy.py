"""The taxonomy as tables: pairs and lookups of a tree, labels made valid, version gate, effective labels, reviewed rows.

A taxonomy is small by nature (some hundred pairs), but it is data: it is broadcast only where its rows were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import blank_to_null, text_key

BROADCAST_PAIRS = 100_000
#: What a bootstrap taxonomy is called.
BOOTSTRAP_PREFIX, BOOTSTRAP_MODEL, BOOTSTRAP_MODE = "bootstrap-", "bootstrap-existing-catalog", "bootstrap"


def small(df: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """To be broadcast, if a look at no more than ``most + 1`` rows shows that it is small enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pairs(tree: DataFrame) -> DataFrame:
    """``category, subcategory`` of a tree of one row a category with an array ``subcategories``."""
    return tree.select("category", F.explode("subcategories").alias("subcategory"))


def unique_subcategories(known: DataFrame) -> DataFrame:
    """``sub_key, category, subcategory`` of names that one category alone has."""
    keyed = known.withColumn("sub_key", text_key("subcategory"))
    one = keyed.groupBy("sub_key").agg(F.count("*").alias("n"), F.min("category").alias("category"), F.min("subcategory").alias("subcategory"))
    return one.filter("n = 1").drop("n")


def valid_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with ``category`` and ``subcategory`` as the taxonomy spells them; rows that it does not know go.

    A pair is looked up by its keys; a subcategory that stands elsewhere, under one category only, takes that category.
    """
    exact = small(known.select(text_key("category").alias("c_"), text_key("subcategory").alias("s_"), F.col("category").alias("c1_"), F.col("subcategory").alias("s1_")))
    alone = small(unique_subcategories(known).select(F.col("sub_key").alias("u_"), F.col("category").alias("c2_"), F.col("subcategory").alias("s2_")))
    keyed = rows.withColumns({"ck_": text_key("category"), "sk_": text_key("subcategory")})
    both = keyed.join(exact, (F.col("ck_") == F.col("c_")) & (F.col("sk_") == F.col("s_")), "left").join(alone, F.col("sk_") == F.col("u_"), "left")
    found = both.withColumns({"category": F.when(F.col("s1_").isNotNull(), F.col("c1_")).otherwise(F.col("c2_")), "subcategory": F.coalesce("s1_", "s2_")})
    return found.filter(F.col("subcategory").isNotNull()).select(*rows.columns)


def confidence(x: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A number between ``low`` and ``high``, to four places; null, 0 and what is no number are the default."""
    number = F.nullif(x.try_cast("double"), F.lit(0.0))
    return F.round(F.greatest(F.lit(low), F.least(F.coalesce(number, F.lit(default)), F.lit(high))), 4)


def reason(text: Column, most: int = 180) -> Column:
    """At most ``most`` characters; longer ones end in three dots."""
    own = F.coalesce(text, F.lit(""))
    return F.when(F.length(own) > most, F.concat(F.rtrim(F.left(own, F.lit(most - 3))), F.lit("..."))).otherwise(own)


def positions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with ``category_index`` and ``pair_index``: places, from 0, of their labels in the taxonomy's order (``ord``)."""
    categories = known.groupBy("category").agg(F.min("ord").alias("o_")).withColumn("category_index", F.row_number().over(Window.orderBy("o_")) - 1)
    numbered = known.withColumn("pair_index", F.row_number().over(Window.orderBy("ord")) - 1)  # one row a pair
    by_category = small(categories.select(text_key("category").alias("c_"), "category_index"))
    by_pair = small(numbered.select(text_key("category").alias("pc_"), text_key("subcategory").alias("ps_"), "pair_index"))
    out = rows.join(by_category, text_key("category") == F.col("c_"), "left")
    return out.join(by_pair, (text_key("category") == F.col("pc_")) & (text_key("subcategory") == F.col("ps_")), "left").drop("c_", "pc_", "ps_")


def is_bootstrap(version: Column, model: Column, mode: Column) -> Column:
    return F.coalesce(F.startswith(version, F.lit(BOOTSTRAP_PREFIX)) | (model == BOOTSTRAP_MODEL) | (mode == BOOTSTRAP_MODE), F.lit(False))


def usable(version: Column, model: Column, mode: Column, wanted: str) -> Column:
    """Whether a stored taxonomy may be used again: of the wanted version, and no bootstrap."""
    return F.coalesce(version == wanted, F.lit(False)) & ~is_bootstrap(F.coalesce(version, F.lit("")), F.coalesce(model, F.lit("")), F.coalesce(mode, F.lit("")))


def effective_category(category: Column, parent: Column, default: str = "Pantry") -> Column:
    """The category, else that of the subcategory, else the default."""
    return F.coalesce(blank_to_null(category), blank_to_null(parent), F.lit(default))


def chosen_option(asked: DataFrame, options: DataFrame) -> DataFrame:
    """``asked`` (with ``typed``) and the option (``ord`` from 1, ``option``) that it means: a number, a name, or part of one name only.

    Options are few, a menu; the comparison of parts is with them alone.
    """
    menu = options.agg(F.array_sort(F.collect_list(F.struct("ord", "option", text_key("option").alias("k")))).alias("menu"))
    both = asked.crossJoin(F.broadcast(menu))  # one row
    key, typed = text_key("typed"), F.trim("typed")
    number = F.filter("menu", lambda m: (m["ord"] == typed.try_cast("int")) & typed.rlike("^[0-9]+$"))
    exact = F.filter("menu", lambda m: m["k"] == key)
    part = F.filter("menu", lambda m: (key != "") & F.contains(m["k"], key))
    pick = F.when(F.size(number) > 0, F.get(number, F.lit(0))["option"]).when(F.size(exact) > 0, F.element_at(exact, -1)["option"]).when(F.size(part) == 1, F.get(part, F.lit(0))["option"])
    return both.withColumn("option", pick).drop("menu")


#: Where a batch of answers may hold its list.
ANSWER_FIELDS = ("classifications", "products", "items", "results")
_ANSWER = "array<struct<id:string,index:string,confidence:string,reason:string,reasoning:string>>"


def json_block(text: Column) -> Column:
    """What stands from the first brace or bracket of a text on; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)[{\[].*", 0), F.lit(""))


def batch_answers(chunks: DataFrame, chunk: str, body: str, expected: str, choices: int) -> DataFrame:
    """``chunk, local_id, index, confidence, reason`` of landed batches of answers, one JSON text a chunk.

    An answer's index must be 1 to ``choices``. Where the valid answers' ids are 1 to ``expected``, all of them, they are taken
    by id, the last of an id; where they have none such, but there are ``expected`` answers and all are valid, by place.
    Other chunks have not been answered and give no rows; ``unanswered`` finds them.
    """
    block = json_block(F.col(body))
    lists = [F.from_json(F.get_json_object(block, f"$.{f}"), _ANSWER) for f in ANSWER_FIELDS]
    found = F.coalesce(F.when(F.startswith(block, F.lit("[")), F.from_json(block, _ANSWER)), *lists)
    rows = chunks.select(chunk, F.col(expected).alias("expected_"), F.posexplode(found).alias("pos", "x"))
    number = lambda c: F.col(f"x.{c}").try_cast("int")
    rows = rows.withColumns({"index": number("index"), "id_": F.trim("x.id").try_cast("int"), "confidence": confidence(F.col("x.confidence"), 0.0), "reason": reason(F.coalesce("x.reason", "x.reasoning"), 160)})
    rows = rows.withColumn("ok_", F.coalesce(F.col("index").between(1, choices), F.lit(False)))
    good = rows.filter("ok_ AND id_ BETWEEN 1 AND expected_").groupBy(chunk, "expected_", F.col("id_").alias("local_id"))
    by_id = good.agg(*(F.max_by(c, "pos").alias(c) for c in ("index", "confidence", "reason")))
    sizes = rows.groupBy(chunk).agg(F.count("*").alias("n_"), F.count_if("ok_").alias("valid_"), F.count_distinct(F.when(F.col("ok_") & F.expr("id_ BETWEEN 1 AND expected_"), F.col("id_"))).alias("ids_"))
    columns = [chunk, "local_id", "index", "confidence", "reason"]
    whole = by_id.join(sizes, chunk).filter("ids_ = expected_").select(*columns)
    placed = rows.join(sizes, chunk).filter("ids_ <> expected_ AND n_ = expected_ AND valid_ = expected_").withColumn("local_id", F.col("pos") + 1)
    return whole.unionByName(placed.select(*columns))


def unanswered(chunks: DataFrame, answers: DataFrame, chunk: str) -> DataFrame:
    return chunks.join(answers.select(chunk).distinct(), chunk, "left_anti")


def suggested(model: Column, current: Column) -> Column:
    """``array<struct<origin, category, subcategory>>``: the model's pair where its subcategory is of its category, then the present one.

    ``model``: struct of ``category, subcategory, subcategory_category``; ``current``: of ``category, subcategory``. What lacks either of
    a pair, or is null, is none.
    """
    filled = lambda *c: [x.isNotNull() & (x != "") for x in c]
    made = lambda origin, x: F.struct(F.lit(origin).alias("origin"), x["category"].alias("category"), x["subcategory"].alias("subcategory"))
    both = filled(model["category"], model["subcategory"])
    first = F.when(both[0] & both[1] & (model["subcategory_category"] == model["category"]), made("model", model))
    have = filled(current["category"], current["subcategory"])
    return F.array_compact(F.array(first, F.when(have[0] & have[1], made("current", current))))

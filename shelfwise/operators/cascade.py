"""The classification cascade: stages in order, each asked for the rows that no earlier one knew.

A stage takes the open rows and adds ``candidate``, ``struct<category, subcategory, confidence>``, null where it does not know.
Stages that look up or compare run in one pass. Before a stage that is ``apart`` - a fitted model, say - the rows are written,
so that it scores open rows only and nothing is computed twice. Columns that a stage adds stay for later stages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import models, rule_table
from shelfwise.working import keep

#: Least image scores and what confidence they give, first and as a rescue; least probabilities of the model.
IMAGE, IMAGE_RESCUE, MODEL, MODEL_RESCUE = (0.55, 0.78), (0.40, 0.62), 0.2, 0.0
#: What a cache must agree in to be used.
CACHE_KEYS = (
    "taxonomy_version", "prompt_version", "model_name", "model_version", "gold_labels_digest", "silver_labels_digest", "clip_audit_digest", "clip_primary_min_score", "clip_rescue_min_score",
)
OUTCOME = "struct<category: string, subcategory: string, confidence: double>"


@dataclass(frozen=True)
class Stage:
    name: str
    of: Callable[[DataFrame], DataFrame]
    apart: bool = False


def outcome(category: Column, subcategory: Column, confidence: Column) -> Column:
    return F.struct(category.alias("category"), subcategory.alias("subcategory"), confidence.cast("double").alias("confidence")).cast(OUTCOME)


def classified(rows: DataFrame, stages: Sequence[Stage], default: Column, guard: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``rows`` with ``stage, category, subcategory, confidence`` of the first stage that knows each.

    ``default`` is the outcome of rows that none knows (stage ``default``). ``guard`` takes stage and outcome and gives the outcome
    that stands. ``rows`` has none of the columns that are added, nor ``candidate`` and ``found``.
    """
    columns = rows.columns
    none = F.lit(None).cast(f"struct<stage: string, outcome: {OUTCOME}>")
    done: list[DataFrame] = []
    open_ = rows.withColumn("found", none)
    for stage in stages:
        if stage.apart:
            held = keep(open_, f"cascade-{stage.name}".replace(" ", "-"))
            done.append(held.filter("found IS NOT NULL").select(*columns, "found"))
            open_ = held.filter("found IS NULL")
        candidate = F.when(F.col("candidate").isNotNull(), F.struct(F.lit(stage.name).alias("stage"), F.col("candidate").cast(OUTCOME).alias("outcome")))
        open_ = stage.of(open_).withColumn("found", F.coalesce("found", candidate)).drop("candidate")
    done.append(open_.select(*columns, "found"))
    found = reduce(DataFrame.unionByName, done).withColumn("found", F.coalesce("found", F.struct(F.lit("default").alias("stage"), default.cast(OUTCOME).alias("outcome"))))
    kept = guard(F.col("found.stage"), F.col("found.outcome")) if guard else F.col("found.outcome")
    return found.withColumn("kept", kept).select(*columns, "found.stage", "kept.category", "kept.subcategory", "kept.confidence")


def known(name: str, table: DataFrame, key: str) -> Stage:
    """Rows whose ``key`` has a row in ``table`` (``key, category, subcategory, confidence``); of several the last by category, subcategory and confidence."""
    one = table.groupBy(key).agg(F.max(outcome(*(F.col(c) for c in ("category", "subcategory", "confidence")))).alias("candidate"))
    return Stage(name, lambda rows: rows.join(one, key, "left"))


def cached(table: DataFrame, has: Mapping[str, object], needs: Mapping[str, object], key: str = "fingerprint") -> Stage:
    """Results of before by fingerprint. All are dropped if any of ``CACHE_KEYS`` differs between what the cache has and what is needed."""
    usable = all(has.get(k) == needs.get(k) for k in CACHE_KEYS)
    return known("cache", table if usable else table.limit(0), key)


def by_image(name: str, least: float, confidence: float, taken: str = "image") -> Stage:
    """The pair of a column ``image`` (``struct<category, subcategory, score>``, null without one) whose score is ``least`` or more."""
    image = F.col(taken)
    return Stage(name, lambda rows: rows.withColumn("candidate", F.when(image["score"] >= least, outcome(image["category"], image["subcategory"], F.lit(confidence)))))


def by_rules(rules: rule_table.RuleSet, fields: Mapping[str, str], name: str = "rules") -> Stage:
    def of(rows: DataFrame) -> DataFrame:
        rule = F.col("rule_found")
        found = rule_table.with_rule(rows, rules, fields, "rule_found")
        return found.withColumn("candidate", F.when(rule.isNotNull(), outcome(rule["category"], rule["subcategory"], rule["confidence"]))).drop("rule_found")

    return Stage(name, of)


def by_votes(votes, label: str, labels: Sequence, pair_of: Callable[[Column], tuple[Column, Column]], key: str, words: Callable[[DataFrame], DataFrame], least: float = MODEL, name: str = "model") -> Stage:
    """A token-vote model on the open rows: the best label and its probability, kept as ``model`` for a later rescue.

    ``words`` gives ``key, token`` of rows; a row without tokens is not known. ``pair_of`` turns a label into category and
    subcategory, null for a label that the taxonomy lacks. Rows of one ``key`` have the same outcome.
    """

    def of(rows: DataFrame) -> DataFrame:
        scores = models.predict_votes(words(rows), key, votes, label, list(labels))
        best = models.best_with_probability(scores, key, label)
        joined = rows.join(best.select(key, F.struct(label, "p").alias("model")), key, "left")
        return joined.withColumn("candidate", _of_model(label, pair_of, least))

    return Stage(name, of, apart=True)


def model_rescue(label: str, pair_of: Callable[[Column], tuple[Column, Column]], least: float = MODEL_RESCUE, name: str = "model rescue") -> Stage:
    """What the model said of a row, at a lower threshold. Comes after ``by_votes``."""
    return Stage(name, lambda rows: rows.withColumn("candidate", _of_model(label, pair_of, least)))


def _of_model(label: str, pair_of, least: float) -> Column:
    category, subcategory = pair_of(F.col("model")[label])
    return F.when((F.col("model.p") >= least) & category.isNotNull(), outcome(category, subcategory, F.col("model.p")))

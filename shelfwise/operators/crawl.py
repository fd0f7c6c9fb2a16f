"""Where the replay of a paged crawl ends: landed batches, the attempt that counts, and the first rule that stops a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page, sizes that are tried behind its end, places that a search shows, statuses that end a run, stale batches.
PAGE, TAILS, RESULTS, ENDS, STALE = 30, (20, 15, 10), 500, (404, 429, 500, 502, 503, 504), 2


def attempts_that_count(attempts: DataFrame, page: int = PAGE) -> DataFrame:
    """Of the attempts ``run, at, size, status, ids`` at one offset ``at`` the one that is taken: sizes from ``page`` down to the first
    that answers with ids, or answers at all at the full size; else the last, whatever it gave. At offset 0 only ``page`` is tried."""
    tried = attempts.filter((F.col("at") > 0) | (F.col("size") == page))
    good = (F.col("status") == 200) & ((F.size(F.coalesce("ids", F.array().cast("array<string>"))) > 0) | (F.col("size") == page))
    best = F.struct(F.when(good, 0).otherwise(1).alias("a"), F.when(good, -F.col("size")).otherwise(F.col("size")).alias("b"))
    columns = [c for c in attempts.columns if c not in ("run", "at")]
    return tried.groupBy("run", "at").agg(F.min_by(F.struct(*columns), best).alias("x")).select("run", "at", *(F.col(f"x.{c}").alias(c) for c in columns))


def reached(batches: DataFrame, results: int = RESULTS) -> DataFrame:
    """Of ``batches`` (``run, at``, more) those that a run can come to: all before ``results``, and the first there or behind, where every
    run ends. Partial minima, so a run is gathered nowhere, however long it goes on."""
    behind = F.coalesce(F.col("at") >= results, F.lit(False))
    first = batches.filter(behind).groupBy("run").agg(F.min_by(F.struct(*batches.columns), "at").alias("first_")).select("first_.*")
    return batches.filter(~behind).unionByName(first)


def stops(batches: DataFrame, results: int = RESULTS, most: int = 400, stale: int = STALE) -> DataFrame:
    """``run, at, reason, requests, added``: the offset at which each run stops, why, how many batches it took, and new ids.

    ``batches``: ``run, at`` (offset, a run's batches ascend), ``size`` asked for, ``status``, ``products`` (the second status), ``ids``
    and ``total`` (null or 0: not said). A rule is looked at in each batch, in this order, and the first that holds ends the run:

    before it is asked for: ``rounds`` (``most`` batches), ``window`` (offset at ``results``), ``total`` (offset at the total said before);
    of the answer: ``status`` (none, with a status of ``ENDS`` after a success), ``error`` (none, otherwise), ``empty``, ``repeat`` (the ids
    of the batch before), ``products`` and ``products error`` likewise; and once it is taken: ``short``, ``window`` (the next is
    behind it), ``total`` (reached), ``stale`` (``stale`` batches in a row without a new id). ``end``: the batches end.

    What a rule needs of earlier batches is a running total or the batch before, as all of these were taken: windows over one
    row a batch, and ids only to find each one's first batch. Of each run a window holds the batches that it can come to.
    """
    batches = reached(batches, results)
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    rows = batches.select("run", "at", "size", "status", "products", ids.alias("ids"), F.nullif(F.col("total"), F.lit(0)).alias("total"))
    first = rows.select("run", "at", F.explode("ids").alias("id")).groupBy("run", "id").agg(F.min("at").alias("at"))
    rows = rows.join(first.groupBy("run", "at").agg(F.count("*").alias("new")), ["run", "at"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    w = Window.partitionBy("run").orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "place": F.row_number().over(w), "said": F.last("total", ignorenulls=True).over(so_far), "said_before": F.last("total", ignorenulls=True).over(earlier),
        "before": F.lag("ids").over(w), "fresh": F.sum(F.when(F.col("new") > 0, 1).otherwise(0)).over(so_far),
    })
    streak = F.sum(F.when(F.col("new") == 0, 1).otherwise(0)).over(Window.partitionBy("run", "fresh").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    n, at, size, said = F.size("ids"), F.col("at"), F.col("size"), F.col("said")
    ends = lambda c: F.when((F.col("place") > 1) & F.col(c).isin(*ENDS), True).otherwise(False)
    nothing = (F.col("status") != 200) & (n == 0)
    reason = (
        F.when(F.col("place") > most, "rounds").when(at >= results, "window").when(at >= F.col("said_before"), "total")
        .when(nothing & ends("status"), "status").when(nothing, "error").when(n == 0, "empty").when(F.col("ids") == F.col("before"), "repeat")
        .when((F.col("products") != 200) & ends("products"), "products").when(F.col("products") != 200, "products error")
        .when(n < size, "short").when(at + size >= results, "window").when(at + n >= said, "total").when(F.col("streak") >= stale, "stale")
    )
    taken = F.col("products").eqNullSafe(F.lit(200)) & (n > 0)
    untaken = F.col("reason").isin("rounds", "status", "error", "empty", "repeat", "products", "products error") | ((F.col("reason") == "window") & (at >= results)) | ((F.col("reason") == "total") & (at >= F.col("said_before")))
    rows = rows.withColumn("streak", streak).withColumn("reason", reason)
    stop = rows.groupBy("run").agg(F.min(F.when(F.col("reason").isNotNull(), F.col("at"))).alias("stop"), F.max("at").alias("last"))
    kept = rows.join(stop, "run").filter("stop IS NULL OR at <= stop")
    counted = taken & ~F.coalesce(untaken, F.lit(False))
    return kept.groupBy("run").agg(
        F.coalesce(F.first("stop"), F.first("last")).alias("at"), F.coalesce(F.max("reason"), F.lit("end")).alias("reason"), F.count_if(counted).alias("requests"), F.coalesce(F.sum(F.when(counted, F.col("new"))), F.lit(0)).alias("added")
    )

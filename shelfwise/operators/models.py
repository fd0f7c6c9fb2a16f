"""Token votes (multinomial naive Bayes), label scores of embeddings, and a TF-IDF classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.working import keep


def _times(tokens: DataFrame) -> Column:
    return F.col("times") if "times" in tokens.columns else F.lit(1).cast("long")


#: Rows of a lookup that are broadcast, and numbers of a model; more are joined.
MOST_ROWS, MOST_NUMBERS = 2_000_000, 4_000_000


def labelled_words(documents: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """``doc, label, token``: a row a word of ``documents`` (``doc, words``) that have a label. Documents meet labels before their words
    are rows, and are not shuffled where labels are at most ``MOST_ROWS``."""
    labels = labels.select(doc, label)
    labels = F.broadcast(labels) if labels.limit(MOST_ROWS + 1).count() <= MOST_ROWS else labels
    return documents.join(labels, doc).select(doc, label, F.explode("words").alias("token"))


def token_votes(tokens: DataFrame, label: str, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From one row a token of a labelled document, or a row a distinct one with how many ``times`` it is there: documents and tokens a
    label, tokens a label and word, size of the vocabulary. Counts of words are written once."""
    words = keep(tokens.groupBy(label, "token").agg(F.sum(_times(tokens)).alias("n")), "vote-words")
    n_docs = tokens.groupBy(label).agg(F.count_distinct(doc).alias("n_docs"))
    totals = words.groupBy(F.col(label).alias("label_")).agg(F.sum("n").alias("n_tokens"))
    docs = n_docs.join(totals, F.col(label).eqNullSafe(F.col("label_"))).drop("label_")
    return docs, words, words.agg(F.count_distinct("token").alias("vocabulary"))


def predict_votes(rows: DataFrame, doc: str, votes: tuple[DataFrame, DataFrame, DataFrame], label: str, labels: list) -> DataFrame:
    """``doc, label, score``: log prior and the add-one log likelihood of each token, for every label.

    A label without a document in training scores as one. Words come with the logarithms of all labels as columns, so a token meets
    the model once, and where it stands: the most frequent words are broadcast, as many as ``MOST_NUMBERS`` allows, so
    what is shuffled is a row a document and task, and words of a larger vocabulary are shuffled by themselves.
    """
    docs, words, vocabulary = votes
    totals = docs.crossJoin(vocabulary).agg(F.sum("n_docs").alias("all_docs"), F.first("vocabulary").alias("vocabulary"), *(F.max(F.when(F.col(label) == v, F.col("n_docs"))).alias(f"d_{i}") for i, v in enumerate(labels)), *(F.max(F.when(F.col(label) == v, F.col("n_tokens"))).alias(f"t_{i}") for i, v in enumerate(labels)))
    totals = keep(totals, "vote-totals")  # one row
    log = lambda i, n: F.log((n + 1) / (F.coalesce(f"t_{i}", F.lit(0)) + F.greatest("vocabulary", F.lit(1))))
    wide = words.groupBy("token").agg(F.sum("n").alias("all_"), *(F.sum(F.when(F.col(label) == v, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, v in enumerate(labels)))
    wide = keep(wide.crossJoin(F.broadcast(totals)).select("token", "all_", *(log(i, F.col(f"n_{i}")).alias(f"l_{i}") for i in range(len(labels)))), "vote-model")
    most = max(1, MOST_NUMBERS // (len(labels) + 6))
    times = _times(rows).alias("times")
    logs = [f"l_{i}" for i in range(len(labels))]
    if wide.limit(most + 1).count() <= most:
        known = rows.select(doc, "token", times).join(F.broadcast(wide.drop("all_")), "token", "left")
    else:
        often = keep(wide.orderBy(F.col("all_").desc(), "token").limit(most).drop("all_"), "vote-often")
        near = rows.select(doc, "token", times).join(F.broadcast(often), "token")
        rest = wide.drop("all_").join(F.broadcast(often.select("token")), "token", "left_anti")
        far = rows.select(doc, "token", times).join(F.broadcast(often.select("token")), "token", "left_anti")
        far = keep(far.groupBy(doc, "token").agg(F.sum("times").alias("times")), "vote-rare")
        known = near.select(doc, "token", "times", *logs).unionByName(far.join(rest, "token", "left").select(doc, "token", "times", *logs))
    one = known.crossJoin(F.broadcast(totals))
    prior = lambda i: F.log(F.greatest(F.coalesce(f"d_{i}", F.lit(1)), F.lit(1)) / F.col("all_docs"))
    out = one.groupBy(doc).agg(*((F.sum(F.col("times") * F.coalesce(f"l_{i}", log(i, F.lit(0)))) + F.first(prior(i))).alias(f"s_{i}") for i in range(len(labels))))
    return out.select(doc, F.explode(F.array(*(F.struct(F.lit(v).alias(label), F.col(f"s_{i}").alias("score")) for i, v in enumerate(labels)))).alias("x")).select(doc, "x.*")


def best_allowed(scores: DataFrame, doc: str, label: str, groups: DataFrame, group: str, allowed: DataFrame) -> DataFrame:
    """``doc, label, score`` of the best label that a row's group allows; of equal scores the smaller label.

    ``groups``: ``doc, group``. ``allowed``: ``group, label``, a table of some hundred rows. A group without any allows none.
    """
    some = scores.join(groups.select(doc, group), doc).join(allowed.select(group, label).distinct(), [group, label])
    best = F.min_by(F.struct(label, "score"), F.struct(-F.col("score"), label))
    return some.groupBy(doc).agg(best.alias("x")).select(doc, f"x.{label}", "x.score")


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label."""
    parts = vectors.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("proto"))


def label_arrays(vectors: DataFrame, id_col: str, vector: str, protos: DataFrame, label: str, temperature: float = 100.0, most: int = 10_000) -> DataFrame:
    """``id, scores``: for each vector an array of ``struct<label, cosine, p, rank>`` of all labels, best first, ties to the smaller label.

    ``p`` is the softmax of cosine times temperature, shifted by the largest. ``protos`` has one row a label, a taxonomy of some
    hundreds; it comes as one row beside the vectors, so nothing is shuffled. Raises above ``most`` labels, which are no taxonomy.
    A vector that is null, or of which no cosine exists, has an empty array.
    """
    if protos.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    proto = F.col("proto").cast("array<double>")
    held = protos.select(F.struct(F.col(label).alias("label"), proto.alias("proto"), F.sqrt(dot(proto, proto)).alias("norm")).alias("one"))
    one = held.agg(F.collect_list("one").alias("protos_"))  # of checked size
    v = F.col("v_")
    rows = vectors.select(id_col, F.col(vector).cast("array<double>").alias("v_")).crossJoin(F.broadcast(one)).withColumn("norm_", F.sqrt(dot(v, v)))
    cosines = F.transform("protos_", lambda t: F.struct((-F.try_divide(dot(v, t["proto"]), F.col("norm_") * t["norm"])).alias("less"), t["label"].alias("label")))
    ordered = rows.select(id_col, F.array_sort(F.filter(cosines, lambda t: t["less"].isNotNull())).alias("c_"))
    weighed = ordered.select(id_col, F.transform("c_", lambda t: F.struct(t["label"].alias("label"), (-t["less"]).alias("cosine"), F.exp(temperature * (F.get("c_", F.lit(0))["less"] - t["less"])).alias("e"))).alias("w_"))
    total = F.aggregate("w_", F.lit(0.0), lambda s, t: s + t["e"])
    return weighed.withColumn("total_", total).select(
        id_col, F.transform("w_", lambda t, i: F.struct(t["label"].alias("label"), t["cosine"].alias("cosine"), (t["e"] / F.col("total_")).alias("p"), (i + 1).alias("rank"))).alias("scores")
    )


def label_scores(vectors: DataFrame, id_col: str, vector: str, protos: DataFrame, label: str, temperature: float = 100.0, top: int | None = None) -> DataFrame:
    """``id, label, cosine, p, rank`` of the ``top`` labels of each vector, or all, as ``label_arrays`` has them."""
    scored = label_arrays(vectors, id_col, vector, protos, label, temperature)
    best = F.col("scores") if top is None else F.slice("scores", 1, top)
    return scored.select(id_col, F.explode(best).alias("s")).select(id_col, F.col("s.label").alias(label), "s.cosine", "s.p", "s.rank")


def locked_pair(scores: Column | str, category_of) -> Column:
    """``struct<category, label>``: the category whose labels weigh most together, ties to the larger, and its best label."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    of = lambda c: F.filter(scores, lambda s: category_of(s["label"]) == c)
    weighed = F.transform(
        F.array_distinct(F.transform(scores, lambda s: category_of(s["label"]))),
        lambda c: F.struct(F.aggregate(of(c), F.lit(0.0), lambda t, s: t + s["p"]).alias("total"), c.alias("category"), F.get(of(c), F.lit(0))["label"].alias("label")),
    )
    best = F.array_max(weighed)
    return F.struct(best["category"].alias("category"), best["label"].alias("label"))


def best_with_probability(scores: DataFrame, doc: str, label: str) -> DataFrame:
    """``doc, label, p`` of the label with the largest log score, ties to the smaller label; ``p`` is its share, rounded to four places."""
    own = scores.groupBy(doc).agg(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col(label).alias("label"))).alias("all"))  # one for each label of the model
    best = F.array_min("all")
    share = F.lit(1.0) / F.aggregate("all", F.lit(0.0), lambda t, s: t + F.exp(best["less"] - s["less"]))
    return own.select(doc, best["label"].alias(label), F.round(share, 4).alias("p"))


def counted_texts(rows: DataFrame, text: str, name: str = "tf_") -> DataFrame:
    """``rows`` with what ``tfidf_classifier`` counts of a text as ``name``, written once: fits and predictions read that table.

    Counting is much work for little data, so rows are dealt out anew, however few splits the input has.
    """
    from .grams import WordGrams

    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 2_000))
    return keep(WordGrams(inputCol=text, outputCol=name).transform(rows.repartition(parts)), "tfidf-counts")


def tfidf_classifier(train: DataFrame, text: str, label: str, weight: str | None = None, least_rows: int = 8):
    """Words, pairs of words, and runs of three to five characters within words (with a blank at either end), TF-IDF, logistic
    regression: a fitted ``pyspark.ml`` pipeline. None where there are fewer than two labels or ``least_rows`` rows.

    Without ``weight`` labels count alike: each row weighs ``rows / (labels * rows of its label)``. Texts are counted once for
    all fits; rows of ``counted_texts`` are not counted again, here and when the model is applied.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    from .grams import WordGrams

    counts = train.groupBy(label).agg(F.count("*").alias("of_label_"))
    labels, rows = counts.agg(F.count("*"), F.coalesce(F.sum("of_label_"), F.lit(0))).first()
    if labels < 2 or rows < least_rows:
        return None
    if "tf_" not in train.columns:
        train = counted_texts(train.select(text, label, *([weight] if weight else [])), text)
    if weight is None:
        weight = "weight_"
        train = train.join(F.broadcast(counts), label).withColumn(weight, F.lit(float(rows)) / (F.lit(float(labels)) * F.col("of_label_")))  # a row a label
    fitted = Pipeline(stages=[IDF(inputCol="tf_", outputCol="x_"), LogisticRegression(featuresCol="x_", labelCol=label, weightCol=weight, maxIter=20)]).fit(train)
    return PipelineModel([WordGrams(inputCol=text, outputCol="tf_"), *fitted.stages])

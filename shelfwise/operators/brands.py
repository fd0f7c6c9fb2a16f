"""Brand families: the whole merge predicate within blocks, and the whole choice of the name; vocabularies are parameters."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.functions.similarity import can_reach, sequence_ratio
from shelfwise.working import keep

from . import graph

#: Last words of a name that was cut off.
SUFFIXES = ("of", "the", "and", "&", "by")


@dataclass(frozen=True)
class BrandVocabulary:
    """``aliases``: canonical brand to its other names; a later entry of one name counts."""

    aliases: Mapping[str, Collection[str]] = field(default_factory=dict)
    connectors: Collection[str] = frozenset()
    generic: Collection[str] = frozenset()
    descriptors: Collection[str] = frozenset()


def _in(words: Collection[str]):
    held = [w.lower() for w in sorted(words)]
    return lambda t: t.isin(held) if held else F.lit(False)


def observed(brands: DataFrame, vocabulary: BrandVocabulary) -> DataFrame:
    """``brand, n, ord`` (one row a brand, ``ord`` its place) with key, significant words, trigrams, seed and block."""
    names = [(name, c, i) for i, (c, name) in enumerate((c, x) for c, known in vocabulary.aliases.items() for x in (*known, c))]
    seeds = brands.sparkSession.createDataFrame(names, "name string, seed string, i int").withColumn("k", text.brand_key("name")).groupBy("k").agg(F.max_by("seed", "i").alias("seed"))
    connector = _in(vocabulary.connectors)
    rows = brands.withColumn("k", text.brand_key("brand")).withColumn("toks", F.filter(F.split("k", " "), lambda t: (t != "") & ~connector(t)))
    compact = F.replace(F.col("k"), F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(compact) - 2, F.lit(1))), lambda i: F.substr(compact, i, F.lit(3)))
    rows = rows.withColumn("grams", F.array_distinct(grams)).withColumn("first", F.coalesce(F.get("toks", F.lit(0)), F.lit("")))
    rows = rows.withColumn("block", F.when(F.col("first") != "", F.col("first")).otherwise(F.substring("k", 1, 1)))
    return rows.join(F.broadcast(seeds), "k", "left")


def _prefixed(vocabulary: BrandVocabulary) -> Column:
    """The longer key goes on from the shorter: with one or two words without digits after two significant ones, or with known words only."""
    swap = F.length("x.k") > F.length("y.k")
    short, long = F.when(swap, F.col("y.k")).otherwise(F.col("x.k")), F.when(swap, F.col("x.k")).otherwise(F.col("y.k"))
    toks = F.when(swap, F.col("y.toks")).otherwise(F.col("x.toks"))
    rest = F.split(F.substr(long, F.length(short) + 2), " ")
    known = _in({*vocabulary.descriptors, *vocabulary.generic})
    plain = (F.size(toks) >= 2) & (F.size(rest) <= 2) & ~F.exists(rest, lambda t: F.rlike(t, F.lit("[0-9]")))
    return F.startswith(long, F.concat(short, F.lit(" "))) & (plain | F.forall(rest, known))


def prefixes_of(words: Column) -> Column:
    """Every start of a key but itself, by words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))


def by_grams(rows: DataFrame, share: float) -> DataFrame:
    """``a, b`` of brands of one block whose trigrams can have ``share`` in common.

    Two such sets share one of the rarest ``n - ceil(share n) + 1`` of either, so a join on these finds them, and no block is
    squared.
    """
    grams = rows.select("brand", "block", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = grams.groupBy("block", "g").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("brand").orderBy("times", "g")
    shown = keep(grams.join(often, ["block", "g"]).withColumn("at", F.row_number().over(rarest)).filter(f"at <= n - ceil({share} * n) + 1"), "brand-grams")
    met = shown.alias("x").join(shown.alias("y"), F.expr(f"x.block = y.block AND x.g = y.g AND x.brand < y.brand AND least(x.n, y.n) >= {share} * greatest(x.n, y.n)"))
    return met.selectExpr("x.brand AS a", "y.brand AS b").distinct()


def by_prefix(rows: DataFrame) -> DataFrame:
    """``a, b`` of brands of one block of which one's key goes on from the other's."""
    words = F.split("k", " ")
    longer = rows.filter(F.size(words) > 1).select("brand", "block", F.explode(prefixes_of(words)).alias("k"))
    on = rows.alias("x").join(longer.alias("y"), F.expr("x.block = y.block AND x.k = y.k AND x.brand <> y.brand"))
    return on.selectExpr("least(x.brand, y.brand) AS a", "greatest(x.brand, y.brand) AS b").distinct()


def linked_pairs(rows: DataFrame, vocabulary: BrandVocabulary) -> DataFrame:
    """``a, b`` of brands to merge, the one seen first before: same seed; prefix; like words and trigrams; or two first words in
    common and a like sequence. Candidates come from joins on what each rule needs to be equal, not from all pairs of a block.
    """
    rows = keep(rows.filter("k <> ''"), "brand-rows")
    seeded = rows.filter("seed IS NOT NULL").select("brand", "block", "seed")
    same_seed = seeded.alias("x").join(seeded.alias("y"), F.expr("x.block = y.block AND x.seed = y.seed AND x.brand < y.brand")).selectExpr("x.brand AS a", "y.brand AS b")
    pairs_of = rows.filter("size(toks) >= 2").selectExpr("brand", "block", "slice(toks, 1, 2) AS t", "length(k) AS n")
    two = pairs_of.alias("x").join(pairs_of.alias("y"), F.expr("x.block = y.block AND x.t = y.t AND x.brand < y.brand AND 2 * least(x.n, y.n) >= 0.8 * (x.n + y.n)")).selectExpr("x.brand AS a", "y.brand AS b")
    some = same_seed.unionByName(two).unionByName(by_grams(rows, 0.72)).unionByName(by_prefix(rows)).distinct()
    share = lambda c: F.coalesce(F.size(F.array_intersect(f"x.{c}", f"y.{c}")) / F.nullif(F.size(F.array_union(f"x.{c}", f"y.{c}")), F.lit(0)), F.lit(0.0))
    same = (F.col("x.first") != "") & F.expr("x.first = y.first")
    seed, prefix = F.coalesce(F.expr("x.seed = y.seed"), F.lit(False)), _prefixed(vocabulary)
    like = same & (share("toks") >= 0.66) & (share("grams") >= 0.72)
    both = some.join(rows.alias("x"), F.expr("a = x.brand")).join(rows.alias("y"), F.expr("b = y.brand"))
    first = F.expr("x.ord < y.ord")
    ordered = (F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    heads = F.expr("size(x.toks) >= 2 AND size(y.toks) >= 2 AND slice(x.toks, 1, 2) = slice(y.toks, 1, 2)")
    both = keep(both.select(*ordered, F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), first.alias("in_order"), (seed | prefix | like).alias("sure"), heads.alias("two")).filter("sure OR two"), "brand-pairs")
    left = both.filter("NOT sure").selectExpr("a", "b", "IF(in_order, ka, kb) AS ka", "IF(in_order, kb, ka) AS kb")
    ratio = left.filter(can_reach("ka", "kb", 0.8)).withColumn("ratio", sequence_ratio("ka", "kb")).filter("ratio >= 0.8")
    return both.filter("sure").select("a", "b").unionByName(ratio.select("a", "b"))


def families(brands: DataFrame, vocabulary: BrandVocabulary) -> DataFrame:
    """``canonical, members, n`` of every family of two brands or more; brands with equal scores give way to the one seen first."""
    rows = observed(brands, vocabulary)
    generic, known = _in(vocabulary.generic), _in({*vocabulary.descriptors, *vocabulary.generic})
    of = lambda words, test: F.size(F.filter(words, test))
    score = F.struct(
        F.col("seed").isNotNull().cast("int").alias("seeded"), (-of(F.slice("toks", 3, 1 << 30), known)).alias("descriptors"), (-F.element_at(F.split("k", " "), -1).isin(*SUFFIXES).cast("int")).alias("suffix"),
        (-F.size("toks")).alias("words"), (-of(F.col("toks"), generic)).alias("generic"), "n", (-F.length("k")).alias("length"), (-F.col("ord")).alias("ord"),
    )
    found = graph.connected_components(linked_pairs(rows, vocabulary))
    return rows.join(found, rows["brand"] == found["node"]).groupBy("label").agg(F.max_by("brand", score).alias("canonical"), F.sort_array(F.collect_list("brand")).alias("members"), F.sum("n").alias("n")).drop("label")


def to_fixpoint(rows: DataFrame, column: str, step, most: int = 4) -> tuple[DataFrame, int]:
    """``step`` again and again, until the set of values of ``column`` stays, or ``most`` times; the rows, and the rounds made.

    The set is told by the number and a sum of hashes of its values: two numbers a round come to the driver. Every round is
    a written table.
    """
    seen = lambda df: tuple(df.select(F.coalesce(column, F.lit("")).alias("b")).distinct().agg(F.count("*"), F.sum(F.xxhash64("b").cast("decimal(38,0)"))).first())
    rows = keep(rows, "fixpoint")
    before, rounds = seen(rows), 0
    while rounds < most:
        rows, rounds = keep(step(rows), "fixpoint"), rounds + 1
        now = seen(rows)
        if now == before:
            break
        before = now
    return rows, rounds


def prefix_map(sources: DataFrame, derived: DataFrame, vocabulary: BrandVocabulary) -> DataFrame:
    """``brand, root`` of the derived brands (column ``brand`` of each table, distinct) that go on from another with a word that describes.

    A brand goes back to the shortest source's brand that it goes on from; without one to the longest derived brand, which itself
    goes back to no source's. Shorter is fewer words, then fewer characters of the key, then the smaller brand. Starts of a key are
    made of its words, so they meet by equality.
    """
    known = _in({*vocabulary.descriptors, *vocabulary.generic})
    words = F.split("k", " ")
    rank = F.struct(F.size(words), F.length("k"), "brand")
    of = lambda df: df.select("brand").distinct().withColumn("k", text.text_key("brand")).filter("k <> ''").select("brand", "k", rank.alias("rank"))
    own, roots = of(derived), of(sources)
    starts = own.filter(F.size(words) > 1).select("brand", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("start"), F.get(words, i).alias("next")))).alias("s"))
    starts = keep(starts.filter(known(F.col("s.next"))).select("brand", F.col("s.start").alias("k")), "brand-starts")
    by_source = keep(starts.join(roots.select("k", F.col("brand").alias("root"), "rank"), "k").groupBy("brand").agg(F.min_by("root", "rank").alias("root")), "brand-sources")
    free = own.join(by_source.select("brand"), "brand", "left_anti").select("k", F.col("brand").alias("root"), "rank")
    among = starts.join(by_source.select("brand"), "brand", "left_anti").join(free, "k").groupBy("brand").agg(F.max_by("root", "rank").alias("root"))
    return by_source.unionByName(among)


def family_map(derived: DataFrame, vocabulary: BrandVocabulary) -> DataFrame:
    """``brand, root`` of every member of a family but the one that names it. ``derived``: ``brand, n, ord``."""
    found = families(derived, vocabulary).select("canonical", F.explode("members").alias("brand"))
    return found.filter("brand <> canonical").select("brand", F.col("canonical").alias("root"))


def normalised(rows: DataFrame, vocabulary: BrandVocabulary, order: str, most: int = 4) -> tuple[DataFrame, int]:
    """``rows`` with their brands brought together, and the rounds it took: at most ``most``, or until the set of brands stays.

    ``rows`` have ``brand, source_brand, brand_source`` and ``order``, by which brands are seen first. Brands that a source names are
    its own name for them; of the others each round maps those that go on from another (``prefix_map``), and families by all
    rules (``family_map``) over that. A brand of generic words alone becomes null, as an empty one does.
    """
    generic, joins = _in(vocabulary.generic), _in(vocabulary.connectors)
    by_source = F.coalesce(F.col("brand_source") == "source", F.lit(False))
    named = F.coalesce(F.nullif("source_brand", F.lit("")), F.nullif("brand", F.lit("")))
    rows = rows.withColumn("brand", F.when(by_source, named).otherwise(F.nullif("brand", F.lit(""))))

    def step(rows: DataFrame) -> DataFrame:
        derived = rows.filter(~by_source & F.col("brand").isNotNull()).groupBy("brand").agg(F.count("*").alias("n"), F.min(order).alias("ord"))
        derived = keep(derived, "brand-derived")
        by_prefix_ = prefix_map(rows.filter(by_source & F.col("brand").isNotNull()).select("brand"), derived, vocabulary)
        over = family_map(derived, vocabulary)
        both = keep(over.unionByName(by_prefix_.join(over.select("brand"), "brand", "left_anti")), "brand-map")
        joined = rows.join(both, "brand", "left")
        brand = F.when(by_source, F.col("brand")).otherwise(F.coalesce("root", "brand"))
        words = F.filter(F.split(text.text_key(brand), " "), lambda w: ~joins(w))
        return joined.withColumn("brand", F.when(by_source | ~F.forall(words, generic), brand)).drop("root")

    return to_fixpoint(rows, "brand", step, most)


def observations(rows: DataFrame, brand: str, sample: str, vocabulary: BrandVocabulary, samples: int = 3) -> DataFrame:
    """What is known of each brand that is seen: ``brand, seed, key, tokens, first_token, token_count, n, samples``.

    Samples are the first distinct ones by value, and found by a rank over distinct pairs, so a brand's rows are not gathered.
    """
    seen = rows.filter(F.col(brand).isNotNull() & (F.col(brand) != ""))
    counts = seen.groupBy(F.col(brand).alias("brand")).agg(F.count("*").alias("n")).withColumn("ord", F.lit(0))
    first = seen.filter(F.col(sample).isNotNull()).select(F.col(brand).alias("brand"), F.col(sample).alias("sample")).distinct()
    first = first.withColumn("rn_", F.row_number().over(Window.partitionBy("brand").orderBy("sample"))).filter(F.col("rn_") <= samples)
    held = first.groupBy("brand").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    out = observed(counts, vocabulary).join(held, "brand", "left")
    return out.select("brand", "seed", F.col("k").alias("key"), F.col("toks").alias("tokens"), F.col("first").alias("first_token"), F.size("toks").alias("token_count"), "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))

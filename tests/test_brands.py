"""Brand families: none is left out, and ties are broken."""

from shelfwise.catalogue import QUERIES
from shelfwise.operators.brands import BrandVocabulary, families, linked_pairs, observed

PART = "p_partkey long, p_brand string, p_size int, p_type string"


def test_canonical_ties(spark, tmp_path):
    """Acme: two members tie behind the first. Bolt: two tie for first place."""
    rows = [(1, "Acme", 4, "x"), (2, "Acme", 2, "PLAIN"), (3, "Acme", 2, "GREEN"), (4, "Bolt-X", 4, "x"), (5, "Bolt X", 4, "x"), (6, "Solo", 4, "x")]
    spark.createDataFrame(rows, PART).write.parquet(f"{tmp_path}/part.parquet")
    found = sorted(map(tuple, QUERIES["brand_canonical"](spark, str(tmp_path)).select("canonical", "members", "n").collect()))
    assert found == [("Acme", 3, 3), ("Bolt X", 2, 2), ("Solo", 1, 1)]


VOCABULARY = BrandVocabulary(aliases={"Oak Farms": ("oak dairy", "Oak's")}, connectors={"the", "and", "of"}, generic={"milk", "organic"}, descriptors={"vanilla"})


def made(spark, *brands):
    return spark.createDataFrame([(b, 1, i) for i, b in enumerate(brands)], "brand string, n long, ord int")


def pairs(spark, *brands):
    return sorted(map(tuple, linked_pairs(observed(made(spark, *brands), VOCABULARY), VOCABULARY).collect()))


def test_predicate(spark):
    """Expected by hand from the rules of the reference."""
    assert pairs(spark, "Oak Dairy", "OAK'S", "Oaks", "Oak Tools") == [("OAK'S", "Oaks")]  # a seed counts within its block only
    assert pairs(spark, "Oak Farms", "Oak Dairy") == [("Oak Farms", "Oak Dairy")]  # same seed
    assert pairs(spark, "Acme", "Acme Vanilla", "Acme Steel") == [("Acme", "Acme Vanilla")]  # after one word only known words
    assert pairs(spark, "Acme Steel", "Acme Steel Big Works", "Acme Steel 700 2000 3000") == [("Acme Steel", "Acme Steel Big Works")]  # no digits
    assert pairs(spark, "Blue Ridge Creameries", "Blue Ridge Creamery X") == [("Blue Ridge Creameries", "Blue Ridge Creamery X")]  # sequence
    assert pairs(spark, "The", "The Of", "Teal") == []  # block of a first character: other words than known ones follow
    assert pairs(spark, "The", "The Milk", "Organic", "The Organic") == []  # words of their own blocks
    assert pairs(spark, "of", "O Milk", "o") == [("O Milk", "o")]
    assert pairs(spark, "The And", "The-And", "t milk") == []  # no significant word: neither rule holds
    assert pairs(spark, "", "--", "x") == []


def test_families(spark):
    def chosen(*brands):
        return sorted(map(tuple, families(made(spark, *brands), VOCABULARY).collect()))

    assert chosen("Acme Milk", "Acme", "Solo") == [("Acme", ["Acme", "Acme Milk"], 2)]
    assert chosen("Oak", "Oak's", "Oak Milk", "Oaks") == [("Oak", ["Oak", "Oak Milk"], 2), ("Oak's", ["Oak's", "Oaks"], 2)]
    assert chosen("Bolt-X", "Bolt X") == [("Bolt-X", ["Bolt X", "Bolt-X"], 2)]  # a tie: seen first
    assert chosen("Blue Ridge of", "Blue Ridge Farm", "Blue Ridge Farm Milk") == [("Blue Ridge Farm", ["Blue Ridge Farm", "Blue Ridge Farm Milk", "Blue Ridge of"], 3)]  # a cut-off name comes after

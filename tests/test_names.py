from pyspark.sql import functions as F

from shelfwise.functions import names

V = names.Vocabulary(generic=frozenset(["organic", "milk"]), descriptors=frozenset(["classic"]), stops=frozenset(["fresh"]), families={"Annie's": ("annie's homegrown", "annies")})


def test_title_case(spark):
    cases = {"organic mac & cheese, 6 oz": "Organic Mac & Cheese, 6 Oz", "the BEST of o'neil's half-and-half": "The BEST of O'Neil's Half-And-Half", "vitamin b12 DHA": "Vitamin B12 DHA", "(new) tea": "(New) Tea"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    for r in df.select("want", names.title_case(F.col("x")).alias("got")).collect():
        assert r.got == r.want


def test_display_name(spark):
    cases = {"®  almond  butter (16 oz) | sale": "Almond Butter", "oat milk, gluten-free, 32 oz": "Oat Milk", "tea - supports energy": "Tea", "honey+lemon": "Honey + Lemon", "plain, salted": "Plain, Salted"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    for r in df.select("want", names.display_name(F.col("x")).alias("got")).collect():
        assert r.got == r.want


def test_brands(spark):
    cases = [("ACME FOODS Classic Corn Chips", "ACME FOODS"), ("annies shells and cheddar", "Annie's"), ("Better Buzz Coffee Dark Roast whole beans", "Better Buzz Coffee Dark Roast"), ("organic whole milk", None), ("Organic Milk", None), (None, None), ("", None), ("Fresh Berries Mix", None)]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, name string")
    got = {r.i: r for r in names.with_brand(df, "name", V).collect()}
    for i, (n, want) in enumerate(cases):
        assert got[i].brand == want, n
    assert got[1].name_without_brand == "shells and cheddar"
    pairs = spark.createDataFrame([("Acme, 12 oz", "Acme"), ("Acme & Co sea salt crackers", "Acme"), ("Annies Annie's Homegrown mac and cheese", "Annie's"), ("Acmes sea salt", "Acme"), ("Acme beer", "Acme")], "n string, b string")
    got = [r[0] for r in pairs.select(names.strip_brand(F.col("n"), F.col("b"), V)).collect()]
    assert got == ["Acme, 12 oz", "sea salt crackers", "mac and cheese", "Acmes sea salt", "Acme beer"]


def test_longest_spelling(spark):
    v = names.Vocabulary(families={"Field": ("field",), "Field Day": ("field day", "fieldday")})
    df = spark.createDataFrame([("Field Day pasta sauce jar",), ("field greens in a bag",), ("FIELDDAY Field Day olive oil spray",)], "n string")
    got = [(r.brand, r.name_without_brand) for r in names.with_brand(df, "n", v).collect()]
    assert got == [("Field Day", "pasta sauce jar"), ("Field", "greens in a bag"), ("Field Day", "olive oil spray")]


def test_ten_thousand_families(spark):
    """The plan is that of a few, and so are the rows."""
    few = {"Field": ("field",), "Field Day": ("field day", "fieldday"), "Annie's": ("annie's homegrown", "annies")}
    many = few | {f"Brand {i} Farms": (f"brand{i}", f"the brand {i} of farms") for i in range(10_000)}
    named = ["Field Day pasta sauce jar", "field greens in a bag", "annies shells and cheddar", "ACME FOODS Classic Corn Chips", "organic whole milk", None, "", "Field Day pasta sauce jar"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(named)], "i int, n string")
    of = lambda families: names.with_brand(df, "n", names.Vocabulary(families=families))
    rows = lambda x: sorted((r.i, r.n, r.brand, r.name_without_brand) for r in x.collect())
    assert rows(of(many)) == rows(of(few))
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert size(of(many)) < 1.2 * size(of(few))
    more = spark.createDataFrame([(1, "the brand 77 of farms oat drink barista"), (2, "Brand77 oat drink barista")], "i int, n string")
    assert [(r.brand, r.name_without_brand) for r in names.with_brand(more, "n", names.Vocabulary(families=many)).orderBy("i").collect()] == [("Brand 77 Farms", "oat drink barista")] * 2

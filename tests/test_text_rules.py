"""Rows by hand for the ladders and tables of text rules, whose SQL is made from the same tables."""

from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import audit


def test_emoji(spark):
    cases = {
        "Avocado oil": "🥑", "Oat MILK": "🥛", "chicken of the sea": "🍗", "graham crackers": "🥩", "catfish": "🐟", "Shrimp": "🍤", "Strawberries": "🍓", "Pineapple": "🍎", "gingerbread": "🍞",
        "Croissants": "🥐", "cheesecake": "🧀", "lemonade": "🍋", "Orange juice": "🍊", "mango": "🥭", "Kiwi": "🥝", "broccoli": "🥦", "veggie": "🥚", "eggplant": "🥚", "Dates": "🌴", "quiche": "🥧",
        "bacon": "🥓", "potato chips": "🥔", "Sweet Potato fries": "🍠", "pancake mix": "🥞", "tomato juice": "🧃", "licorice": "🍚", "cupcake": "🍰", "chocolate": "🍫", "blueberry": "🫐", "popcorn": "🍿",
        "corn": "🌽", "steak": "🛒",
    }
    df = spark.createDataFrame(list(cases.items()), "name string, want string").withColumn("got", text.emoji("name"))
    assert [(r.name, r.got) for r in df.filter("got <> want").collect()] == []
    assert spark.createDataFrame([(None,), ("",)], "name string").select(text.emoji("name")).distinct().first()[0] == "🛒"


def test_tags(spark):
    rows = [
        ("Organic Vegan chips", "Acme", None, ["Flyer"], 1, "$2", ["flyer-only deal", "organic", "prime deal", "vegan"]),
        ("Gluten-Free protein bar", None, "Keto", ["Flyer", "All Deals"], 2, "", ["gluten-free", "high-protein", "keto", "multi-source deal"]),
        ("plain", "", "", ["All Deals"], 1, None, []),
        ("NON-GMO dairy free", "Paleo & Co", None, [], 0, None, ["dairy-free", "non-gmo", "paleo"]),
        ("vegetarian", None, None, None, 0, None, ["vegetarian"]),
    ]
    df = spark.createDataFrame(rows, "name string, brand string, category string, sources array<string>, n int, prime string, want array<string>")
    for r in df.select("want", text.tags("name", "brand", "category", F.col("sources"), F.col("n"), F.col("prime")).alias("got")).collect():
        assert r.got == r.want


def test_retailers(spark):
    rows = [
        ("WFM", None, None, "Whole Foods"), ("target", None, None, "Target"), ("H-Mart", "", None, "H Mart"), ("Corner Shop", "https://www.target.com/x", None, "Corner Shop"),
        ("unknown", "https://www.target.com/x", None, "Target"), (None, None, ["H Mart Deals"], "H Mart"), ("", "https://hmart.com", ["Target Deals"], "Target"), (None, None, ["Search Deals"], "Whole Foods"), (None, None, None, "Whole Foods"),
    ]
    df = spark.createDataFrame(rows, "v string, url string, sources array<string>, want string")
    for r in df.select("v", "want", text.retailer(F.col("v"), F.col("url"), F.col("sources")).alias("got")).collect():
        assert r.got == r.want, r


def test_haystack(spark):
    df = spark.createDataFrame([("Sparkling Water Beverage 12 FL OZ Cans", "", None), (None, None, None), ("Fruit Spread-Preserves", "red", "/p/1")], "n string, v string, u string")
    assert [r[0] for r in df.select(text.haystack("n", "v", "u")).collect()] == ["sparkling water 12  fluid ounce cans", "", "fruit spread red p 1"]


def test_suspicious(spark):
    rows = [("Produce", "green tea leaves", "Produce label with packaged/drink/supplement/personal-care words."), ("Produce", "teal lettuce", None), ("Pantry", "vitamin c", "Pantry label with likely wellness or personal-care words."), ("Beverages", "essential oil", "Beverage label with non-drink words."), ("Alcohol", "water", "Alcohol label with likely non-alcohol product words."), ("Other", "x", "Failed fallback bucket."), ("Frozen", "water", None), (None, "water", None)]
    df = spark.createDataFrame(rows, "c string, t string, want string").withColumn("got", audit.suspicious_reason(F.col("c"), F.col("t")))
    assert df.filter("NOT (got <=> want)").collect() == []

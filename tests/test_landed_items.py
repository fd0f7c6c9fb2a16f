import json

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import fields
from shelfwise.operators import brands, lookups, models, rules, taxonomy
from shelfwise.sources import items, landed, rule_tables, sinks, tiles


def test_product_tiles(spark):
    html = """<div><a href="/grocery/product/b000000001?x=1" data-csa-c-content-id="Oat  Milk *"><img src="i.png" alt="alt"><span class="brand big">Acme</span> $3.49/ea <b>20% off</b></a>
    <a href="/grocery/product/B000000002"><img src="j.png" alt="Tea"><span class="brand">Valid</span><span class="brand">Leaf</span></a><a href="/about">no tile</a>
    <a href="/grocery/product/B000000001" aria-label="again"></a><a href="/grocery/product/B000000003"></a><a href="/grocery/product/B000000004"><p>Plain name<p>$1"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = tiles.product_tiles(df)
    rows = [(r.pos, r.asin, r.name, r.brand, r.image, r.prices, r.discount) for r in got.collect()]
    assert rows == [(0, "B000000001", "Oat Milk", "Acme", "i.png", ["$3.49/ea"], "20% off"), (1, "B000000002", "Tea", "Leaf", "j.png", [], None), (2, "B000000001", "again", None, None, [], None), (3, "B000000004", "Plain name", None, None, ["$1"], None)]
    assert sorted(r.pos for r in tiles.first_tiles(got).collect()) == [0, 1, 3]
    assert got.first().url == "https://www.wholefoodsmarket.com/grocery/product/b000000001?x=1"


def test_feed_categories_and_order(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"asin": "A3"}, {"asin": "A4"}]))
    (tmp_path / "a.json").write_text(json.dumps([{"asin": "A1", "categories": ["Tea", "Drinks"]}, {"asin": "A2", "source_categories": ["Own"], "categories": ["x"]}]))
    rows = landed.read_feed(spark, str(tmp_path), "H Mart Deals").orderBy("ord").collect()
    assert [r.asin for r in rows] == ["A1", "A2", "A3", "A4"] and rows[0].source_categories == ["Tea", "Drinks"] and rows[1].source_categories == ["Own"]


def test_json_or_default(spark, tmp_path):
    default = spark.createDataFrame([("d", 0)], "version string, n int")
    path = tmp_path / "x.json"
    read = lambda: [tuple(r) for r in items.json_or(spark, str(path), "version string, n int", default).collect()]
    assert read() == [("d", 0)]
    path.write_text("{broken")
    assert read() == [("d", 0)]
    path.write_text('{"version": "v5", "n": 3}')
    assert read() == [("v5", 3)]


def test_cached_catalog(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "a")], "k int, v string")

    path = str(tmp_path / "c")
    for _ in range(2):
        assert [tuple(r) for r in items.cached_catalog(spark, path, build, "k int, v string").collect()] == [(1, "a")]
    assert len(built) == 1


def test_shapes_and_configuration(spark):
    df = spark.createDataFrame([('[{"asin":"A"},{"asin":"B"}]',), ('{"asin":"C"}',), ("nothing",), (None,)], "body string")
    assert [r.asin for r in items.shape_checked(df, "body", "asin:string").collect()] == ["A", "B"]
    for text in ("", "{", "[]", '{"a":1}'):
        assert [tuple(r) for r in items.configured(spark, text, "id string", [("built-in",)]).collect()] == [("built-in",)]


def test_small_tables(spark):
    df = spark.range(10)
    assert "broadcast" not in str(taxonomy.small(df, 5)._jdf.queryExecution().logical()).lower()
    assert "hint" in str(taxonomy.small(df, 10)._jdf.queryExecution().logical()).lower()


def test_fields(spark):
    row = spark.createDataFrame([("Join Prime to buy this item at $1.50/lb now", -3.0, "x" * 200)], "t string, s double, r string")
    got = row.select(fields.prime_price_text(F.col("t")), fields.duration(F.col("s")), fields.duration(F.lit(3725)), F.length(taxonomy.reason(F.col("r")))).first()
    assert tuple(got) == ("$1.50/lb", "0s", "1h 02m", 180)


def test_any_id_keeps_rows_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, None)], "k int, ids array<string>")
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert [r.k for r in lookups.with_any_id(rows, "ids", wanted, "k").collect()] == [1]
    assert sorted(r.k for r in lookups.with_any_id(rows, "ids", wanted, "k", anti=True).collect()) == [2, 3, 4]


def test_text_classifier_needs_rows(spark):
    few = spark.createDataFrame([("a", 0.0)] * 9, "text string, y double")
    assert models.tfidf_classifier(few, "text", "y") is None
    assert models.tfidf_classifier(few.limit(3), "text", "y") is None
    rows = spark.createDataFrame([("oranges", 1.0), ("orange", 1.0), ("oranje", 1.0), ("milk", 0.0), ("milky", 0.0), ("milks", 0.0), ("silk", 0.0), ("range", 1.0)], "text string, y double")
    asked = spark.createDataFrame([("orang",), ("mil",)], "text string")
    assert [r.prediction for r in models.tfidf_classifier(rows, "text", "y").transform(asked).collect()] == [1.0, 0.0]  # by runs of characters alone


def test_too_many_labels(spark):
    protos = spark.range(5).selectExpr("id AS label", "array(1D) AS proto")
    with pytest.raises(ValueError):
        models.label_arrays(protos.selectExpr("label AS id", "proto AS v"), "id", "v", protos, "label", most=4)


def test_checkpoints(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "id string, n int"
    assert sinks.resumed(spark, path, schema).collect() == []
    for run, rows in ((1, [("a", 1)]), (2, [("b", 2), ("c", 3)]), (2, [("b", 4)])):
        sinks.checkpoint(spark.createDataFrame(rows, schema), path, run)
    (tmp_path / "runs" / "run=3").mkdir()
    (tmp_path / "runs" / "run=3" / "part-0.parquet").write_text("half")
    assert sorted(map(tuple, sinks.resumed(spark, path, schema).collect())) == [("a", 1, 1), ("b", 4, 2)]


def test_overwrite(spark, tmp_path):
    path = str(tmp_path / "o")
    for kind in ("json", "parquet"):
        for n in (2, 1):
            sinks.overwrite(spark.range(n), f"{path}-{kind}", kind)
        assert spark.read.format(kind).load(f"{path}-{kind}").count() == 1


def test_fixpoint_ends(spark):
    rows = spark.createDataFrame([("aaaaaaaa",)], "b string")
    shorter = lambda df: df.selectExpr("IF(length(b) > 2, substr(b, 2), b) AS b")
    assert brands.to_fixpoint(rows, "b", shorter)[1] == 4
    done, rounds = brands.to_fixpoint(rows, "b", shorter, most=20)
    assert rounds == 7 and done.first().b == "aa"


def test_rule_tables(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("ord,terms,category,subcategory,confidence\n2,Tea|coffee,Beverages,Hot,0.9\n1,iced tea,Beverages,Cold,0.95\n3,,Pantry,None,0.5\n")
    found = rule_tables.first_match_rules(spark.read.option("header", True).csv(str(tmp_path / "rules.csv")))
    assert found == [(("iced tea",), "Beverages", "Cold", 0.95), (("tea", "coffee"), "Beverages", "Hot", 0.9)]
    df = spark.createDataFrame([("iced tea",), ("green tea",), ("steak",), ("rice",)], "t string")
    assert [r[0] for r in df.select(rules.first_rule("t", found)["subcategory"]).collect()] == ["Cold", "Hot", "Hot", None]
    table = spark.createDataFrame([("Produce", "Strong", "fresh fruit"), ("Produce", "exclude", "juice"), ("Pantry", "weak", "rice"), ("Pantry", "weak", " ")], "category string, kind string, phrase string")
    known = rule_tables.profiles(table)
    assert known == {"Produce": {"strong": ["fresh fruit"], "exclude": ["juice"]}, "Pantry": {"weak": ["rice"]}}
    got = rules.with_category_details(spark.createDataFrame([("fresh fruit",), ("rice",), ("",)], "h string"), "h", known, []).collect()
    assert [r.category for r in got] == ["Produce", "Pantry", "Pantry"]
    with pytest.raises(ValueError):
        rule_tables.profiles(table.withColumn("kind", F.lit("odd")))

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfwise import working
from shelfwise.functions import text
from shelfwise.operators import feed, graph, merge, models, rules
from shelfwise.sources import landed, sinks
from shelfwise.streaming.upserts import upsert_stream


def test_feed_scan(spark, tmp_path):
    rows = [{"asin": "A1", "name": "Milk", "brand": "Fresh Produce", "discount": "", "rank": 2, "asins": ["A1", "A2"]}, {"asin": "A2", "brand": "Acme", "retailer": "", "rank": None, "sale_price": "$2"}, {"asin": "A3", "rank": 1}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    got = landed.search_feed(landed.read_feed(spark, str(tmp_path / "f.json"), "Search Deals")).orderBy("asin").collect()
    assert got[0].brand is None and got[0].source_categories == ["Fresh Produce"] and got[0].discount is None and got[0].sources == ["Search Deals"]
    assert got[1].brand == "Acme" and got[1].retailer == "Whole Foods"
    assert [r.asin for r in landed.flyer_order(landed.read_feed(spark, str(tmp_path / "f.json"), "Flyer")).collect()] == ["A3", "A1", "A2"]
    assert landed.read_feed(spark, str(tmp_path / "none.json"), "Flyer").count() == 0


def test_pages(spark):
    html = '<a href="/p/1">One <b>two</b></a><p>x<a href=/2>Three</a><script id="__NEXT_DATA__" type="application/json">{"a": 1}</script><a href="x">open'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in landed.read_tiles(df).collect()] == [(1, 0, "/p/1", "One two"), (1, 1, "/2", "Three")]
    assert [r[0] for r in df.select(landed.embedded_json(F.col("html"))).collect()] == ['{"a": 1}', None]


def test_graph_offers(spark):
    rows = [("Product:1", ("Tea", None, None, "i1")), ("i1", (None, None, None, "s1")), ("s1", (None, None, None, "o1")), ("o1", (None, 3.0, 4.0, None)), ("Product:2", ("Rice", None, None, "i2")), ("i2", (None, None, None, "s2")), ("s2", (None, None, None, "o2")), ("o2", (None, 4.0, 4.0, None))]
    df = spark.createDataFrame(rows, "id string, obj struct<name:string,price:double,list:double,ref:string>")
    assert [tuple(r) for r in landed.graph_offers(df).collect()] == [("Product:1", "Tea", 3.0, 4.0)]


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "k int, n int, v string").schema
    for i, rows in enumerate(([(1, 1, "a"), (1, 2, "b")], [(2, 1, "c"), (1, 3, "d")])):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"k": k, "n": n, "v": v}) for k, n, v in rows))
        upsert_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["n"]).awaitTermination()
    assert sorted(map(tuple, sinks.read_table(spark, str(tmp_path / "t")).collect())) == [(1, 3, "d"), (2, 1, "c")]


def test_text_golden(spark):
    df = spark.createDataFrame([("365 by Whole Foods Market, Olive Oil (16 fl oz)",)], "t string")
    assert df.select(text.text_key("t")).first()[0] == "365 by whole foods market olive oil 16 fl oz"
    hay = spark.createDataFrame([("organic cherries pack",), ("paste tomato can",), ("steak",)], "h string")
    assert [r[0] for r in hay.select(text.has_phrase("h", "cherry")).collect()] == [True, False, False]
    assert [r[0] for r in hay.select(text.has_phrase("h", "tomato paste")).collect()] == [False, True, False]
    assert [tuple(r) for r in hay.select(text.has_any("h", ["tea"]), text.has_word("h", "tea")).collect()][2] == (True, False)


def test_arguments():
    assert feed.csv_values(" a, ,b ") == ["a", "b"] and feed.clamp("x", 120, 1000) == 120 and feed.clamp(-5, 1, 9) == 1 and feed.clamp("5000", 1, 1000) == 1000


def test_graph(spark):
    r = random.Random(2)
    edges = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(35)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == label


def test_label_validity(spark):
    rows = spark.createDataFrame([(i, "good fine text here" if i % 2 else "bad poor words there", float(i % 2)) for i in range(40)], "doc_id int, text string, quality double")
    out = models.tfidf_classifier(rows, "text", "quality").transform(rows).select("quality", "prediction").collect()
    assert all(r.prediction == r.quality for r in out)


def test_first_rule(spark):
    df = spark.createDataFrame([("a b",), ("b",), ("z",)], "t string")
    r = rules.first_rule("t", [(["a"], "A", "x", 0.9), (["b"], "B", "y", 0.8)])
    assert [x[0] and x[0].category for x in df.select(r).collect()] == ["A", "B", None]


@pytest.mark.parametrize("last,want", [(False, [(1, "x")]), (True, [(1, "z")])])
def test_rows(spark, last, want):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "z")], "k int, o int, v string")
    assert [tuple(r) for r in merge.first_rows(df, ["k"], ["o"], last=last).select("k", "v").collect()] == want


def test_upserts_after_faults(spark, tmp_path):
    path, put = tmp_path / "t", lambda rows: sinks.upsert_table(spark.createDataFrame(rows, "k int, v string"), str(tmp_path / "t"), ["k"])
    put([(1, "a")])
    put([(2, "b")])
    (path / "v2").mkdir()
    (path / "v2" / "part-0.parquet").write_text("half a file")  # a call that was lost on its way
    assert sorted(map(tuple, sinks.read_table(spark, str(path)).collect())) == [(1, "a"), (2, "b")]
    put([(3, "c")])
    assert sorted(map(tuple, sinks.read_table(spark, str(path)).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    (path / "v2" / "_SUCCESS").unlink()  # the last version is not complete: the one before is the table
    assert sorted(map(tuple, sinks.read_table(spark, str(path)).collect())) == [(1, "a"), (2, "b")]


def test_working_tables(spark):
    df = spark.range(3)
    kept = working.keep(df, "test")
    with working.working(spark):
        inside = working.keep(df, "test")
        path = inside.inputFiles()[0].split(":", 1)[1].replace("//", "/")
        assert os.path.exists(path.replace("//", "/"))
    assert not os.path.exists(path.replace("//", "/"))
    assert kept.count() == 3

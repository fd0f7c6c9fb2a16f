"""Arrays of every layout, cut anywhere, against the parsed file."""

import json

import pytest

from shelfwise.sources import arrays, landed

SCHEMA = "asin string, name string, offers array<struct<store: string, price: double>>, more struct<a: int>"


def records(n):
    return [{"asin": f"B{i}", "name": f'{{ "odd" }}, [{i}]\n  {{\n line é \\', "offers": [{"store": str(k), "price": k / 4} for k in range(i % 4)], "more": {"a": i} if i % 3 else None} for i in range(n)]


LAYOUTS = {
    "two": lambda x: json.dumps(x, indent=2), "four": lambda x: json.dumps(x, indent=4, ensure_ascii=False), "none": lambda x: json.dumps(x, indent=0), "tab": lambda x: json.dumps(x, indent="\t"),
    "lines": lambda x: "[\n" + ",\n".join(json.dumps(r) for r in x) + "\n]\n", "flat": json.dumps,
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(spark, tmp_path, layout):
    want = records(300 if layout != "none" else 1)
    if layout == "none":
        want[0]["offers"] = None  # without an indent nested objects look like those of the array
        want[0]["more"] = None
    (tmp_path / "a.json").write_text(LAYOUTS[layout](want), encoding="utf-8")
    (tmp_path / "b.json").write_text(LAYOUTS[layout]([]), encoding="utf-8")
    (tmp_path / "c.json").write_text(LAYOUTS[layout](want[:1]), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = arrays.array_records(spark, str(tmp_path))
        got = sorted((r.file, r.number, json.loads(r.record)) for r in rows.collect())
        tasks = spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x[2] for x in got if x[0] == "a.json"] == want and [x[1] for x in got if x[0] == "a.json"] == list(range(1, len(want) + 1))
    assert [x[2] for x in got if x[0] == "c.json"] == want[:1] and len(got) == len(want) + 1
    assert layout in ("flat", "none") or tasks > 5
    typed = arrays.read_array(spark, str(tmp_path / "a.json"), SCHEMA).orderBy("number_").collect()
    assert [(r.asin, r["name"], len(r.offers or []), r.more.a if r.more else None) for r in typed] == [(r["asin"], r["name"], len(r["offers"] or []), (r["more"] or {}).get("a")) for r in want]


def test_feed_order(spark, tmp_path):
    rows = [{"asin": f"B{i}", "name": "" if i % 2 else f"n{i}", "categories": ["x"]} for i in range(500)]
    (tmp_path / "feed.json").write_text(json.dumps(rows, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = landed.read_feed(spark, str(tmp_path / "feed.json"), "Flyer").orderBy("ord").select("asin", "name", "source_categories").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(f"B{i}", None if i % 2 else f"n{i}", ["x"]) for i in range(500)]


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    assert arrays.array_records(spark, str(tmp_path)).collect() == []

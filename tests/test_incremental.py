"""Runs of an audit one after another: only what changed changes."""

from pyspark.sql import functions as F

from shelfwise.operators import incremental

SCHEMA = "row_id long, asin string, url string, name string, asins array<string>, score double, error string"
FIELDS = ["asin", "url", "name"]


def products(spark, rows):
    return spark.createDataFrame(rows, "row_id long, asin string, url string, name string, asins array<string>")


def test_runs(spark, tmp_path):
    asked = []

    def audit(version):
        def f(rows):
            asked.append(sorted(r.row_id for r in rows.collect()))
            return rows.withColumn("error", F.when(F.col("name") == "broken", "image_load_failed")).withColumn("score", F.when(F.col("error").isNull(), F.lit(float(version))))

        return f

    path = str(tmp_path / "audit")
    first = [(1, "A1", "", "one", None), (2, None, "/u2", "two", ["X9", "X8"]), (3, "A3", None, "broken", []), (4, "A4", None, "four", None)]
    assert incremental.run_audit(spark, path, products(spark, first), audit(1), SCHEMA, FIELDS, "asins") == {"retained": 0, "refreshed": 3, "failures": 1, "reported": 3}
    # the first is known by another field, the second by one id of its list, the third failed, the fourth is gone, the fifth is new
    second = [(11, None, None, "A1", None), (12, "X8", None, "renamed", None), (13, "A3", None, "fixed", None), (15, "A5", None, "five", None)]
    assert incremental.run_audit(spark, path, products(spark, second), audit(2), SCHEMA, FIELDS, "asins") == {"retained": 2, "refreshed": 2, "failures": 1, "reported": 4}
    assert asked == [[1, 2, 3, 4], [13, 15]]
    from shelfwise.sources import sinks

    rows = {r.row_id: (r.score, r.error, r.origin) for r in sinks.read_table(spark, path).collect()}
    assert rows == {1: (1.0, None, "retained"), 2: (1.0, None, "retained"), 3: (None, "image_load_failed", "retained"), 13: (2.0, None, "new"), 15: (2.0, None, "new")}
    # a third run with nothing new changes nothing
    assert incremental.run_audit(spark, path, products(spark, second), audit(3), SCHEMA, FIELDS, "asins")["refreshed"] == 0
    assert {r.row_id: r.score for r in sinks.read_table(spark, path).collect()} == {k: v[0] for k, v in rows.items()}


def test_empty(spark, tmp_path):
    none = products(spark, [])
    audit = lambda rows: rows.withColumns({"score": F.lit(1.0), "error": F.lit(None).cast("string")})
    assert incremental.run_audit(spark, str(tmp_path / "a"), none, audit, SCHEMA, FIELDS) == {"retained": 0, "refreshed": 0, "failures": 0, "reported": 0}

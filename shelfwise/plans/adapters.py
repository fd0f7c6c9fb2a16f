"""The driver's tables as the domain's: a catalog of priced products and offers from five sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(x: str) -> str:
    return f"concat('$', CAST(CAST({x} AS DECIMAL(12, 2)) AS STRING))"


_P = "p_retailprice"
#: Price text of every shape, by part: regular, prime, current, promotion.
ZOO = {
    "regular": f"CASE p_partkey % 12 WHEN 1 THEN concat({_money(_P)}, '/lb') WHEN 3 THEN 'Regular prices vary' WHEN 8 THEN NULL WHEN 2 THEN concat({_money(_P)}, ' to ', {_money(_P + ' * 2')}) WHEN 6 THEN concat('Regular ', {_money(_P)}, ' to ', {_money(_P + ' * 2')}) WHEN 10 THEN concat({_money(_P)}, ' to ', {_money(_P + ' + 5')}) WHEN 11 THEN concat({_money(_P)}, ' to ', {_money(_P + ' + 9')}, '/lb') ELSE {_money(_P)} END",
    "prime": f"CASE p_partkey % 12 WHEN 0 THEN {_money(_P + ' * 0.8')} WHEN 1 THEN {_money(_P + ' * 0.75')} WHEN 2 THEN {_money(_P + ' * 0.5')} WHEN 3 THEN {_money(_P)} WHEN 4 THEN concat('2 for ', {_money(_P)}) WHEN 5 THEN 'Buy 2, Get 1 Free' WHEN 6 THEN concat('3 for ', {_money(_P)}) WHEN 7 THEN '20% off' WHEN 8 THEN {_money(_P)} WHEN 11 THEN 'buy 1 get 1 free' END",
    "cur": f"CASE WHEN p_partkey % 5 = 0 THEN {_money(_P + ' * 0.9')} WHEN p_partkey % 35 = 3 THEN '5% off' END",
    "promo": "CASE p_partkey % 12 WHEN 9 THEN '15% off' WHEN 10 THEN '25 % OFF today' WHEN 0 THEN 'save 10%' WHEN 8 THEN 'member 30% off' END",
}
CATALOG = f"(SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, {', '.join(f'{e} AS {n}' for n, e in ZOO.items())} FROM part)"

#: Offers of five feeds, in a fixed order of feeds; ``ord`` is a total order of the rows of a product.
_SOURCE = "CASE WHEN l_returnflag = 'R' THEN 'Flyer' WHEN l_returnflag = 'A' AND l_linenumber <= 3 THEN 'All Deals' WHEN l_returnflag = 'A' THEN 'Search Deals' WHEN l_linestatus = 'O' THEN 'Target Deals' ELSE 'H Mart Deals' END"
_RANK = "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' AND l_linenumber <= 3 THEN 2 WHEN l_returnflag = 'A' THEN 3 WHEN l_linestatus = 'O' THEN 4 ELSE 5 END"
_ORD = "concat(CAST({rank} AS STRING), '|', lpad(CAST(l_orderkey AS STRING), 12, '0'), '|', CAST(l_linenumber AS STRING), '|', lpad(CAST(l_suppkey AS STRING), 8, '0'), '|', CAST(l_extendedprice AS STRING), '|', CAST(l_quantity AS STRING))".format(rank=_RANK)
OFFERS = f"""(SELECT l_partkey AS product, l_suppkey AS store, {_SOURCE} AS source, {_ORD} AS ord, CAST(floor(l_discount * 100 + 0.5) AS INT) AS percent,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('$', CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS STRING)) END AS price,
  CASE WHEN l_linenumber % 4 = 1 THEN '' ELSE l_shipdate_text END AS expires
  FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS STRING) AS l_shipdate_text FROM lineitem))"""


def duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Spark SQL over the named tables, which are bound for this text alone: no view of the session is made or replaced."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {CATALOG}", "part")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {OFFERS}", "lineitem")

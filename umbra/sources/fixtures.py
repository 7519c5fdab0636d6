"""Views derived from the driver's TPC-H-style tables.

The census-style ``people`` table is a deterministic projection of ``customer``.
Each view is written once as SQL select-expressions so that the Spark plan and
the DuckDB oracle evaluate the very same expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from umbra.functions.noise import NoiseKey

# The noise key of the registered queries, known to their oracles: for fixtures only, never for a release.
FIXTURE = NoiseKey("umbra fixture secret", "fixture")

# The people mapping of the test plan (one expression per output column).
PEOPLE_EXPRS = [
    "c_custkey AS person_id",
    "CAST(17 + (c_custkey * 7 + c_nationkey) % 74 AS INT) AS age",
    "CASE WHEN c_custkey % 17 = 0 THEN ' ?' ELSE concat(' ', c_mktsegment) END AS workclass",
    "CAST(1 + (c_custkey * 3 + c_nationkey) % 16 AS INT) AS `education-num`",
    "CASE c_custkey % 3 WHEN 0 THEN ' Never-married' WHEN 1 THEN ' Divorced' ELSE ' Married-civ-spouse' END AS `marital-status`",
    "CASE WHEN c_custkey % 19 = 0 THEN ' ?' ELSE concat(' occ', CAST(c_nationkey % 5 AS STRING)) END AS occupation",
    "concat(' race', CAST(c_custkey % 2 AS STRING)) AS race",
    "CASE WHEN (c_custkey + c_nationkey) % 2 = 0 THEN ' Male' ELSE ' Female' END AS sex",
    "CASE c_nationkey % 8 WHEN 0 THEN ' United-States' WHEN 1 THEN ' Columbia' WHEN 2 THEN ' Trinadad&Tobago' "
    "WHEN 3 THEN ' Outlying-US(Guam-USVI-etc)' WHEN 4 THEN ' South' WHEN 5 THEN ' ?' WHEN 6 THEN ' Germany' "
    "ELSE ' England' END AS `native-country`",
    "CAST(floor(greatest(c_acctbal, 0)) AS INT) AS `capital-gain`",
    "CASE WHEN c_custkey % 4 = 0 THEN ' >50K.' WHEN c_custkey % 101 = 7 THEN ' unknown' ELSE ' <=50K' END AS income",
]

# Scale fixture for the anonymizers: three numeric QIs, one categorical QI, SA l_returnflag.
LINEITEM_QI_EXPRS = [
    "l_orderkey",
    "l_linenumber",
    "CAST(l_quantity AS INT) AS l_quantity",
    "CAST(month(l_shipdate) AS INT) AS ship_month",
    "l_linestatus",
    "l_returnflag",
]


# Fixture with generalization trees: two numeric QIs, a place below nation, region and *, a priority below its class and *.
ORDERS_QI_SQL = """SELECT CAST(month(o_orderdate) AS INT) AS order_month, CAST(floor(greatest(c_acctbal, 0) / 500) AS INT) AS balance,
  concat(n_name, '/', c_mktsegment) AS place, o_orderpriority AS priority, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
PLACE_EDGES_SQL = """SELECT DISTINCT concat(n_name, '/', c_mktsegment) AS child, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION SELECT r_name, '*' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)"""
PRIORITY_EDGES_SQL = """SELECT DISTINCT o_orderpriority AS child, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'normal' END AS parent FROM orders
UNION SELECT DISTINCT CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'normal' END, '*' FROM orders"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, dirty census-style records (leading blanks, ``?``, labels with ``.``)."""
    return table(spark, sf_dir, "customer").selectExpr(*PEOPLE_EXPRS)


def lineitem_qi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*LINEITEM_QI_EXPRS)


def sql_view(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """``query`` over the driver's tables."""
    names = [t for t in ("orders", "customer", "nation", "region", "lineitem") if t in query]
    return spark.sql(_braced(query, names), **{t: table(spark, sf_dir, t) for t in names})


def _braced(query: str, names: list[str]) -> str:
    """Table names as the parameters that ``spark.sql`` fills with frames."""
    return re.sub(r"(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 {\2}", query)


def _duck(exprs: list[str]) -> str:
    return ",\n  ".join(e.replace("`", '"') for e in exprs)


def people_sql() -> str:
    """The same view for DuckDB (backticks become double quotes)."""
    return f"SELECT\n  {_duck(PEOPLE_EXPRS)}\nFROM customer"


def lineitem_qi_sql() -> str:
    return f"SELECT\n  {_duck(LINEITEM_QI_EXPRS)}\nFROM lineitem"

"""Domain views over the driver's tables: bills, their lines, clauses and keys.

Money is whole cents throughout (BIGINT); rounding is half up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bill for each order: (bill_id, policy, admitted, started, sum_insured, category, grp)."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.expr("c_nationkey = n_nationkey"))
    joined = table(spark, sf_dir, "orders").join(customers, F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(
        "o_orderkey AS bill_id",
        "r_name AS policy",
        "CAST(o_orderdate AS DATE) AS admitted",
        "date_add(DATE'1995-01-01', CAST(o_custkey % 1500 AS INT)) AS started",
        "CAST((1 + o_custkey % 5) * 100000 AS BIGINT) AS sum_insured",
        "o_orderpriority AS category",
        "CAST(o_custkey % 7 AS INT) AS grp",
    )


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bill_id, line_no, item, cents, qty); line numbers count the lines of a bill in a fixed order."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"
    )
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return lines.select(
        F.col("l_orderkey").alias("bill_id"),
        F.row_number().over(order).alias("line_no"),
        F.col("p_name").alias("item"),
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) AS cents"),
        F.expr("CAST(l_quantity AS INT) AS qty"),
    )


def lines_of_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bill_lines(spark, sf_dir).join(bills(spark, sf_dir), "bill_id")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, clause_id, text): the documents as clauses of the policy that is their source."""
    return table(spark, sf_dir, "documents").selectExpr("source AS policy", "doc_id AS clause_id", "text")


#: The same views as SQL for the checks.
BILLS = """bills AS (
  SELECT o_orderkey AS bill_id, r_name AS policy, CAST(o_orderdate AS DATE) AS admitted,
    CAST(DATE '1995-01-01' + CAST(o_custkey % 1500 AS INTEGER) AS DATE) AS started,
    CAST((1 + o_custkey % 5) * 100000 AS BIGINT) AS sum_insured, o_orderpriority AS category, CAST(o_custkey % 7 AS INTEGER) AS grp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINES = """lines AS (
  SELECT l_orderkey AS bill_id, CAST(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS INTEGER) AS line_no,
    p_name AS item, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS INTEGER) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BOTH = f"{BILLS}, {LINES}, lb AS (SELECT * FROM lines JOIN bills USING (bill_id))"
CLAUSES = "clauses AS (SELECT source AS policy, doc_id AS clause_id, text FROM documents)"

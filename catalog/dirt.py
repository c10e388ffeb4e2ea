"""The tables as the queries read them, clean and with dirt put in, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank quantities, discounts and flags; NaN beside NULL in the tax; prices scaled up."""
    nan = F.lit(float("nan"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 100)
        .otherwise(F.col("l_extendedprice"))
        .alias("l_extendedprice"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 13 == 0, nan)
        .when(F.col("l_partkey") % 17 != 0, F.col("l_tax"))
        .alias("l_tax"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        "l_shipdate",
    )


LINEITEM = """d AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS l_discount,
    CASE WHEN l_partkey % 13 = 0 OR l_partkey % 17 = 0 THEN NULL ELSE l_tax END AS l_tax,
    CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag END AS l_returnflag,
    l_linestatus, l_shipdate
  FROM lineitem)"""

LINEITEM_NUMERIC = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types respelt: upper case, white space around, letters doubled; some blank."""
    t, k = F.col("event_type"), F.col("event_id") % 11
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(k == 0, F.concat(F.lit(" "), F.upper(t)))
        .when(k == 1, F.concat(t, F.lit("\t")))
        .when(k == 2, F.concat(t, F.lit("s")))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.initcap(t))
        .otherwise(t)
        .alias("event_type"),
        F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"),
        "props",
    )


EVENTS = """e AS (
  SELECT event_id, ts, user_id,
    CASE event_id % 11 WHEN 0 THEN ' ' || upper(event_type) WHEN 1 THEN event_type || chr(9)
      WHEN 2 THEN event_type || 's' WHEN 3 THEN NULL
      WHEN 4 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END AS event_type,
    CASE WHEN event_id % 9 <> 0 THEN value END AS value, props
  FROM events)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text in one format, with some junk; priorities partly blank."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 10
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.when(k == 0, F.lit("not-a-date")).when(k == 1, F.lit(None)).otherwise(text).alias("order_date"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS = """o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    CASE o_orderkey % 10 WHEN 0 THEN 'not-a-date' WHEN 1 THEN NULL
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""

# Similarity of two labels a, b of a table p(a, b): one cell of the LCS table per round.
LCS = """walk AS (
    SELECT a, b, 1 AS i, 0 AS j, list_transform_zero AS prev, [0] AS cur FROM (
      SELECT a, b, [0 FOR z IN range(0, length(b) + 1)] AS list_transform_zero FROM p)
    UNION ALL
    SELECT a, b, CASE WHEN j < length(b) THEN i ELSE i + 1 END,
      CASE WHEN j < length(b) THEN j + 1 ELSE 0 END,
      CASE WHEN j < length(b) THEN prev ELSE cur END,
      CASE WHEN j < length(b) THEN list_append(cur, CASE
          WHEN substr(a, i, 1) = substr(b, j + 1, 1) THEN prev[j + 1] + 1
          ELSE greatest(prev[j + 2], cur[j + 1]) END)
        ELSE [0] END
    FROM walk WHERE i <= length(a)),
  sim AS (
    SELECT a, b, 2.0::DOUBLE * prev[length(b) + 1] / (length(a) + length(b)) AS similarity
    FROM walk WHERE i = length(a) + 1 AND j = 0)"""

# Near-duplicate labels of a table labels_("column", value), by way of the similarity above.
NEAR = """SELECT l."column" AS "column", l.value AS value_a, r.value AS value_b,
  round(similarity, 3) AS similarity
FROM labels_ l JOIN labels_ r ON l."column" = r."column" AND l.value < r.value
  JOIN sim ON sim.a = lower(l.value) AND sim.b = lower(r.value)
WHERE similarity >= 0.85 - 1e-9"""
PAIRS = """p AS (SELECT DISTINCT lower(l.value) AS a, lower(r.value) AS b FROM labels_ l JOIN labels_ r
    ON l."column" = r."column" AND l.value < r.value AND lower(l.value) <> lower(r.value))"""

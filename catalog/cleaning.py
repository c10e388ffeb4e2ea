"""The cleaning actions, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.functions.dates import parse_date
from dqspark.operators.clean import clean

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(df, column):
    return df.select(*KEYS, F.round(column, 4).alias(column))


@query(
    "impute_mean",
    f"""WITH {dirt.LINEITEM} SELECT l_orderkey, l_linenumber, l_partkey,
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM d)), 4) AS l_quantity FROM d""",
)
def impute_mean(spark, sf_dir):
    return _lines(clean(dirt.lineitem(spark, sf_dir), "l_quantity", "impute_mean"), "l_quantity")


@query(
    "impute_median",
    f"""WITH {dirt.LINEITEM} SELECT l_orderkey, l_linenumber, l_partkey,
  round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM d)), 4) AS l_tax FROM d""",
)
def impute_median(spark, sf_dir):
    return _lines(clean(dirt.lineitem(spark, sf_dir), "l_tax", "impute_median"), "l_tax")


@query(
    "impute_mode",
    f"""WITH {dirt.ORDERS} SELECT o_orderkey, coalesce(o_orderpriority, (
    SELECT o_orderpriority FROM o WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
    ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM o""",
)
def impute_mode(spark, sf_dir):
    out = clean(dirt.orders(spark, sf_dir), "o_orderpriority", "impute_mode")
    return out.select("o_orderkey", "o_orderpriority")


@query(
    "impute_mode_numeric",
    f"""WITH {dirt.LINEITEM} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, (
    SELECT l_quantity FROM d WHERE l_quantity IS NOT NULL GROUP BY l_quantity
    ORDER BY count(*) DESC, l_quantity LIMIT 1)) AS l_quantity FROM d""",
)
def impute_mode_numeric(spark, sf_dir):
    return _lines(clean(dirt.lineitem(spark, sf_dir), "l_quantity", "impute_mode"), "l_quantity")


@query(
    "drop_rows",
    f"""WITH {dirt.LINEITEM} SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM d
WHERE l_tax IS NOT NULL""",
)
def drop_rows(spark, sf_dir):
    return clean(dirt.lineitem(spark, sf_dir), "l_tax", "drop_rows").select(*KEYS, "l_tax")


@query("drop_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_column(spark, sf_dir):
    df = clean(dirt.table(spark, sf_dir, "orders"), "o_orderdate", "drop_column")
    return clean(df, "o_orderpriority", "drop_column")


@query(
    "parse_dates",
    f"""WITH {dirt.ORDERS}
SELECT o_orderkey, strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS order_date FROM o""",
)
def parse_dates(spark, sf_dir):
    out = clean(dirt.orders(spark, sf_dir), "order_date", "parse_dates", format="%Y-%m-%d")
    return out.select("o_orderkey", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@query(
    "parse_dates_guessed",
    f"""WITH {dirt.ORDERS}
SELECT o_orderkey, strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS order_date FROM o""",
)
def parse_dates_guessed(spark, sf_dir):
    out = clean(dirt.orders(spark, sf_dir), "order_date", "parse_dates")
    return out.select("o_orderkey", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


DATE_TEXTS = {
    "%Y-%m-%dT%H:%M:%S%z": "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z')",
    "%Y-%m-%d %H:%M:%S%z": "concat(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), '+02:00')",
    "%m/%d/%Y %I:%M:%S %p": "date_format(o_orderdate, 'MM/dd/yyyy hh:mm:ss a')",
    "%y-%m-%d": "date_format(o_orderdate - INTERVAL '20' YEAR, 'yy-MM-dd')",
    "%A, %B %d, %Y": "date_format(o_orderdate, 'EEEE, MMMM d, yyyy')",
}


@query(
    "parse_dates_formats",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d0,
  strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS d1,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d2,
  strftime(o_orderdate - INTERVAL 20 YEAR, '%Y-%m-%d 00:00:00') AS d3,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS d4 FROM orders""",
)
def parse_dates_formats(spark, sf_dir):
    """Order dates written in several formats and parsed again."""
    orders = dirt.table(spark, sf_dir, "orders")
    texts = orders.select("o_orderkey", *[F.expr(e).alias(f"d{i}") for i, e in enumerate(DATE_TEXTS.values())])
    parsed = [
        F.date_format(parse_date(F.col(f"d{i}"), fmt), "yyyy-MM-dd HH:mm:ss").alias(f"d{i}") for i, fmt in enumerate(DATE_TEXTS)
    ]
    return texts.select("o_orderkey", *parsed)


@query(
    "cap_iqr",
    f"""WITH {dirt.LINEITEM}, q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(l_extendedprice,
  q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) AS l_extendedprice FROM d, q""",
)
def cap_iqr(spark, sf_dir):
    return _lines(clean(dirt.lineitem(spark, sf_dir), "l_extendedprice", "cap_outliers"), "l_extendedprice")


@query(
    "cap_percentile",
    f"""WITH {dirt.LINEITEM}, q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo,
    quantile_cont(l_quantity, 0.95) AS hi FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity IS NOT NULL
  THEN round(greatest(least(l_quantity, hi), lo), 4) END AS l_quantity FROM d, q""",
)
def cap_percentile(spark, sf_dir):
    out = clean(dirt.lineitem(spark, sf_dir), "l_quantity", "cap_outliers", cap_percentile=0.95)
    return _lines(out, "l_quantity")


@query("no_action", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def no_action(spark, sf_dir):
    return clean(dirt.table(spark, sf_dir, "customer"), "c_acctbal", "no_action")

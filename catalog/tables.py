"""Keyed reductions, conformance, sorting and sampling of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.lineage import scratch_path
from dqspark.operators.tables import (
    between,
    conformance,
    exists_in,
    first_rows,
    keep_best,
    one_of,
    quarantine,
    required,
    sort_by,
    upsert_latest,
    upsert_stored,
)

KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "keep_best_per_key",
    """WITH s AS (SELECT event_id, event_type, user_id, value / 20 AS score,
    list_sort(list_distinct([user_id % 5, user_id % 3])) AS cols FROM events)
SELECT event_id, event_type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, cols ORDER BY score DESC, event_id) AS r
  FROM s WHERE score >= 2.5) WHERE r = 1""",
)
def keep_best_per_key(spark, sf_dir):
    scored = dirt.table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        (F.col("value") / 20).alias("score"),
        F.array(F.col("user_id") % 5, F.col("user_id") % 3).alias("cols"),
    )
    as_set = F.array_sort(F.array_distinct("cols"))
    return keep_best(scored, ["event_type", as_set], "score", "event_id").drop("cols")


@query(
    "keep_best_nan",
    """SELECT event_id, user_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
  FROM events WHERE value >= 2.5 AND event_id % 5 <> 0) WHERE r = 1""",
)
def keep_best_nan(spark, sf_dir):
    """A score that is no number is never the best."""
    score = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    scored = dirt.table(spark, sf_dir, "events").select("event_id", "user_id", score.alias("value"))
    return keep_best(scored, ["user_id"], "value", "event_id")


@query(
    "validate_nan",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no_value,out_of_range'
  WHEN value > 150 THEN 'out_of_range' ELSE '' END AS reasons FROM events""",
)
def validate_nan(spark, sf_dir):
    """A required value that is no number is missing."""
    value = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    rows = dirt.table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    marked = conformance(rows, [required("value", "no_value"), between("value", -1e9, 150.0, "out_of_range")])
    return marked.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "upsert_latest",
    """WITH b AS (SELECT c_custkey, c_acctbal AS amount, c_custkey AS seq, 0 AS side FROM customer
  UNION ALL SELECT o_custkey, o_totalprice, o_orderkey, 1 FROM orders)
SELECT c_custkey, amount, seq, first_side, first_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY side DESC, seq DESC) AS r,
    first_value(side) OVER w AS first_side, first_value(seq) OVER w AS first_seq
  FROM b WINDOW w AS (PARTITION BY c_custkey ORDER BY side, seq)) WHERE r = 1""",
)
def upsert(spark, sf_dir):
    existing = dirt.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("seq")
    )
    incoming = dirt.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("seq"),
    )
    return upsert_latest(existing, incoming, ["c_custkey"], "seq")


@query(
    "upsert_table",
    """WITH t AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 5 = 2),
l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS amount, max(o_orderkey) AS seq FROM t GROUP BY 1)
SELECT c_custkey, coalesce(amount, c_acctbal) AS amount, coalesce(l.seq, c_custkey) AS seq, c_nationkey,
  c_nationkey % 5 <> 2 OR c_nationkey NOT IN (SELECT c_nationkey FROM l JOIN customer ON c_custkey = o_custkey) AS same_file
FROM customer LEFT JOIN l ON c_custkey = o_custkey""",
)
def upsert_table(spark, sf_dir):
    """Customers stored by nation; orders of some nations' customers replace their amounts. Files of other nations stay."""
    customer = dirt.table(spark, sf_dir, "customer")
    stored = customer.select("c_custkey", F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("seq"), "c_nationkey")
    path = scratch_path(spark, "customers")
    stored.write.partitionBy("c_nationkey").parquet(path)
    file = F.col("_metadata.file_path").alias("file")
    before = [r["file"] for r in spark.read.parquet(path).select(file).distinct().collect()]  # a name per partition
    nation = customer.where("c_nationkey % 5 = 2").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    incoming = dirt.table(spark, sf_dir, "orders").join(nation, "o_custkey").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"), "c_nationkey"
    )
    upsert_stored(spark, path, incoming, ["c_custkey"], "seq", "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", "amount", "seq", "c_nationkey", F.col("_metadata.file_path").isin(before).alias("same_file"))


def _rules(spark, sf_dir):
    active = dirt.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return [
        required("event_type", "no_type"),
        one_of("event_type", KINDS, "unknown_type"),
        between("value", 1.0, 200.0, "value_out_of_range"),
        exists_in("user_id", active, "c_custkey", "unknown_user"),
    ]


REASONS = f"""{dirt.EVENTS}, r AS (SELECT event_id, event_type, value, concat_ws(',',
    CASE WHEN event_type IS NULL THEN 'no_type' END,
    CASE WHEN coalesce(event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view'), true) THEN 'unknown_type' END,
    CASE WHEN coalesce(value NOT BETWEEN 1 AND 200, true) THEN 'value_out_of_range' END,
    CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'unknown_user' END
  ) AS reasons FROM e)"""


@query("validate_quarantine", f"WITH {REASONS} SELECT event_id, reasons FROM r")
def validate_quarantine(spark, sf_dir):
    marked = conformance(dirt.events(spark, sf_dir), _rules(spark, sf_dir))
    return marked.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("quarantine_accepted", f"WITH {REASONS} SELECT event_id, event_type, value FROM r WHERE reasons = ''")
def quarantine_accepted(spark, sf_dir):
    accepted, _ = quarantine(dirt.events(spark, sf_dir), _rules(spark, sf_dir))
    return accepted.select("event_id", "event_type", "value")


@query("quarantine_rejected", f"WITH {REASONS} SELECT event_id, reasons FROM r WHERE reasons <> ''")
def quarantine_rejected(spark, sf_dir):
    _, rejected = quarantine(dirt.events(spark, sf_dir), _rules(spark, sf_dir))
    return rejected.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("sort_missing_last", f"WITH {dirt.EVENTS} SELECT event_id, value FROM e ORDER BY value NULLS LAST")
def sort_missing_last(spark, sf_dir):
    return sort_by(dirt.events(spark, sf_dir), "value").select("event_id", "value")


@query(
    "first_rows",
    f"WITH {dirt.EVENTS} SELECT event_id, value FROM e ORDER BY value NULLS LAST, event_id LIMIT 5",
)
def sample_rows(spark, sf_dir):
    return first_rows(dirt.events(spark, sf_dir), ["value", "event_id"]).select("event_id", "value")

"""Recomputation checks, scorecard and audit trail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.lineage import cut, scratch_path
from dqspark.operators.charts import chart_data
from dqspark.operators.scorecard import scorecard
from dqspark.operators.verify import check_chart, recheck, scatter_count
from dqspark.plans.actions import Intent, vet_plan
from dqspark.sources.audit import append_log, merge_logs, read_log, vetting_log

BAR = Intent("bar", ("l_returnflag", "l_quantity"), "categorical", 4.0)


@query(
    "verify_recompute",
    f"""WITH {dirt.LINEITEM}, s AS (SELECT l_returnflag AS item, avg(l_quantity) AS again,
    CASE WHEN l_returnflag = 'N' THEN avg(l_quantity) + 1 ELSE avg(l_quantity) END AS shown
  FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT item, 'mean' AS measure, round(shown, 4) AS shown, round(again, 4) AS recomputed FROM s
WHERE abs(shown - again) > 1e-6""",
)
def verify_recompute(spark, sf_dir):
    """One shown mean is wrong, and only that one is found."""
    df = dirt.lineitem(spark, sf_dir)
    wrong = F.when(F.col("label") == "N", F.col("mean") + 1).otherwise(F.col("mean"))
    shown = chart_data(df, BAR).withColumn("mean", wrong)
    found = recheck(df, BAR, shown)
    return found.withColumn("shown", F.round("shown", 4)).withColumn("recomputed", F.round("recomputed", 4))


ALL = [
    Intent("histogram", ("l_extendedprice",), "distribution"),
    Intent("box", ("l_extendedprice", "l_returnflag"), "distribution"),
    Intent("box", ("l_tax",), "distribution"),
    Intent("bar", ("l_returnflag",), "categorical"),
    BAR,
    Intent("line", ("l_shipdate", "l_quantity"), "trend"),
    Intent("scatter", ("l_quantity", "l_discount"), "relationship"),
    Intent("heatmap", ("l_quantity", "l_extendedprice", "l_discount"), "relationship"),
    Intent("pie", ("l_returnflag", "l_quantity"), "categorical"),
]


ALL_SQL = " UNION ALL ".join(
    f"SELECT '{n}-{i.chart_type}' AS chart_id, '{i.chart_type}' AS chart_type, '{','.join(i.columns)}' AS columns,"
    f" '{i.category}' AS category, 'verified' AS status, 'recomputed values agree' AS notes WHERE (SELECT count(*) FROM lineitem) > 0"
    for n, i in enumerate(ALL, 1)
)


@query("verify_all_charts", ALL_SQL)
def verify_all_charts(spark, sf_dir):
    """Every chart made, computed a second time, and given its status."""
    df = dirt.lineitem(spark, sf_dir)
    rows = [check_chart(df, f"{n}-{i.chart_type}", i) for n, i in enumerate(ALL, 1)]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("columns", F.array_join("columns", ","))


# One injected fault for each shown column of each chart.
FAULTS = {
    Intent("histogram", ("l_extendedprice",)): ("bin_start", "bin_end", "n"),
    Intent("box", ("l_extendedprice", "l_returnflag")): (
        "q1", "median", "q3", "n", "min", "max", "whisker_low", "whisker_high", "n_outliers",
    ),
    Intent("bar", ("l_returnflag",)): ("n",),
    BAR: ("mean",),
    Intent("line", ("l_orderkey", "l_quantity")): ("x", "y"),
    Intent("scatter", ("l_quantity", "l_discount")): ("x", "y"),
    Intent("heatmap", ("l_quantity", "l_discount")): ("corr",),
    Intent("pie", ("l_returnflag", "l_quantity")): ("total", "share"),
}


@query(
    "verify_faults",
    " UNION ALL ".join(
        f"SELECT '{'-'.join((i.chart_type, *i.columns))}' AS chart_id, '{c}' AS fault, 'flagged' AS status WHERE (SELECT count(*) FROM lineitem) > 0"
        for i, columns in FAULTS.items()
        for c in columns
    ),
)
def verify_faults(spark, sf_dir):
    """Charts with one wrong column each; every one must be flagged."""
    df = dirt.lineitem(spark, sf_dir)
    rows = []
    for intent, columns in FAULTS.items():
        shown = cut(chart_data(df, intent))
        for c in columns:
            wrong = shown.withColumn(c, F.col(c) * 2 + 1)
            name = "-".join((intent.chart_type, *intent.columns))
            rows.append(check_chart(df, name, intent, wrong).select("chart_id", F.lit(c).alias("fault"), "status"))
    return reduce(DataFrame.unionByName, rows)


@query(
    "verify_scatter_count",
    f"""WITH {dirt.LINEITEM} SELECT count(*) AS n_shown, count(*) AS n_complete, true AS agrees FROM d
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL""",
)
def verify_scatter_count(spark, sf_dir):
    df = dirt.lineitem(spark, sf_dir)
    shown = chart_data(df, Intent("scatter", ("l_quantity", "l_discount")))
    return scatter_count(df, shown, "l_quantity", "l_discount")


@query(
    "verify_status",
    f"""WITH {dirt.LINEITEM}, a AS (SELECT l_returnflag, avg(l_quantity) AS shown,
    sum(l_quantity) / count(l_quantity) AS again FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT 'right' AS chart_id, CASE WHEN max(abs(shown - again)) < 1e-6 THEN 'verified' ELSE 'flagged' END AS status FROM a
UNION ALL
SELECT 'wrong', CASE WHEN max(abs(shown + 1 - again)) < 1e-6 THEN 'verified' ELSE 'flagged' END FROM a
UNION ALL
SELECT 'text', CASE WHEN max(try_cast(l_linestatus AS DOUBLE)) IS NULL THEN 'failed' ELSE 'verified' END FROM d""",
)
def verify_status(spark, sf_dir):
    df = dirt.lineitem(spark, sf_dir)
    shown = chart_data(df, BAR).withColumn("mean", F.col("mean") + 1)
    rows = [
        check_chart(df, "right", BAR),
        check_chart(df, "wrong", BAR, shown),
        check_chart(df, "text", Intent("histogram", ("l_linestatus",))),
    ]
    return reduce(DataFrame.unionByName, rows).select("chart_id", "status")


@query(
    "scorecard",
    """WITH c AS (SELECT o_custkey::VARCHAR AS run_id, count(*) AS total_charts,
    count(*) FILTER (o_orderstatus = 'F') AS verified_charts,
    count(*) FILTER (o_orderstatus = 'O') AS flagged_charts,
    count(*) FILTER (o_orderstatus = 'P') AS failed_charts FROM orders GROUP BY 1),
  d AS (SELECT user_id::VARCHAR AS run_id, count(*) AS cleaning_actions_applied FROM events GROUP BY 1),
  a AS (SELECT l_suppkey::VARCHAR AS run_id, count(*) AS audit_log_entries FROM lineitem GROUP BY 1)
SELECT run_id, coalesce(total_charts, 0) AS total_charts, coalesce(verified_charts, 0) AS verified_charts,
  coalesce(flagged_charts, 0) AS flagged_charts, coalesce(failed_charts, 0) AS failed_charts,
  coalesce(cleaning_actions_applied, 0) AS cleaning_actions_applied,
  coalesce(audit_log_entries, 0) AS audit_log_entries
FROM c FULL JOIN d USING (run_id) FULL JOIN a USING (run_id)""",
)
def run_scorecard(spark, sf_dir):
    """Orders stand for check rows, events for applied actions, line items for log entries."""
    status = F.col("o_orderstatus")
    checks = dirt.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.when(status == "F", "verified").when(status == "O", "flagged").otherwise("failed").alias("status"),
    )
    run = lambda name, key: dirt.table(spark, sf_dir, name).select(
        F.col(key).cast("string").alias("run_id")
    )
    return scorecard(checks, run("events", "user_id"), run("lineitem", "l_suppkey"))


@query(
    "audit_trail",
    """SELECT event_type AS run_id, count(*) * 2 AS n, min(event_id) AS first_seq, max(event_id) AS last_seq
FROM events GROUP BY 1""",
)
def audit_trail(spark, sf_dir):
    """Entries appended twice to a stored trail, read back by run."""
    entries = dirt.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("ingest").alias("stage"),
        F.lit("code").alias("actor"),
        F.lit("loaded_dataset").alias("action"),
        F.col("props").alias("detail"),
    )
    path = scratch_path(spark, "audit")
    append_log(entries, path)
    append_log(entries, path)
    return read_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query(
    "audit_vetting",
    """SELECT user_id::VARCHAR AS run_id, event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN 'code' ELSE 'llm' END AS actor,
  CASE WHEN event_id % 3 = 0 THEN 'rejected_invalid_action' ELSE 'proposed' END AS action,
  event_type AS column_name FROM events""",
)
def audit_vetting(spark, sf_dir):
    """Vetted proposals of many data sets as rows of the trail."""
    n = F.col("event_id")
    plan = dirt.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dataset_id"),
        n.alias("seq"),
        F.col("event_type").alias("column"),
        F.when(n % 3 == 0, "magic_fix").otherwise("impute_mean").alias("action_type"),
        F.lit("why").alias("rationale"),
    )
    known = plan.select("dataset_id", "column").distinct()
    log = vetting_log(vet_plan(plan, known), "cleaning_plan")
    return log.select("run_id", "seq", "actor", "action", F.get_json_object("detail", "$.column").alias("column_name"))


@query(
    "audit_merge",
    """SELECT event_id AS seq, 'code' AS actor FROM events
UNION ALL SELECT event_id, 'llm' FROM events""",
)
def audit_merge(spark, sf_dir):
    seq = dirt.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return merge_logs(seq.withColumn("actor", F.lit("code")), seq.withColumn("actor", F.lit("llm")))


@query(
    "verify_mean_line",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(avg(o_totalprice) + 1, 4) AS shown, round(avg(o_totalprice), 4) AS recomputed,
  'verified' AS status FROM orders GROUP BY o_orderdate HAVING dayofmonth(o_orderdate) = 1""",
)
def verify_mean_line(spark, sf_dir):
    """A right line of means is verified; where the first of each month is shown one too high, only those are found."""
    df = dirt.table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    intent = Intent("line", ("o_orderdate", "o_totalprice"), "trend", mean=True)
    status = check_chart(df, "line", intent).first()["status"]
    shown = chart_data(df, intent)
    shown = shown.withColumn("y", F.col("y") + F.when(F.dayofmonth("x") == 1, 1).otherwise(0))
    found = recheck(df, intent, shown)
    return found.select(
        F.substring("item", 1, 10).alias("day"), F.round("shown", 4).alias("shown"), F.round("recomputed", 4).alias("recomputed"), F.lit(status).alias("status")
    )

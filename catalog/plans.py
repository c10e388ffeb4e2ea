"""Cleaning plans: applied, measured, vetted."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.plans.actions import PLAN_DDL, Action, approved, read_plan, vet_intents, vet_plan
from dqspark.plans.executor import apply_plan
from dqspark.sources.audit import plan_log

PLAN = [
    Action("l_quantity", "impute_median", "gaps"),
    Action("l_extendedprice", "cap_outliers", "scaled prices"),
    Action("l_returnflag", "impute_mode", "gaps"),
    Action("l_linestatus", "no_action", "fine as it is"),
    Action("l_tax", "drop_rows", "needed"),
    Action("l_discount", "impute_mean", "gaps left after dropping"),
    Action("l_suppkey", "drop_column", "not needed"),
    Action("l_suppkey", "impute_mean", "comes too late"),
]

STAGES = f"""{dirt.LINEITEM}, q AS (SELECT quantile_cont(l_quantity, 0.5) AS med,
    quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM d),
  m AS (SELECT l_returnflag AS flag FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 1),
  s1 AS (SELECT d.* REPLACE (coalesce(l_quantity, med) AS l_quantity,
    greatest(least(l_extendedprice, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) AS l_extendedprice,
    coalesce(l_returnflag, flag) AS l_returnflag) FROM d, q, m),
  s2 AS (SELECT * FROM s1 WHERE l_tax IS NOT NULL),
  s3 AS (SELECT * EXCLUDE (l_suppkey) REPLACE (
    coalesce(l_discount, (SELECT avg(l_discount) FROM s2)) AS l_discount) FROM s2)"""


@query(
    "plan_apply",
    f"""WITH {STAGES} SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 4) AS l_quantity,
  round(l_extendedprice, 4) AS l_extendedprice, l_returnflag, l_tax, round(l_discount, 6) AS l_discount
FROM s3""",
)
def plan_apply(spark, sf_dir):
    df = apply_plan(dirt.lineitem(spark, sf_dir), PLAN).df
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round("l_quantity", 4).alias("l_quantity"),
        F.round("l_extendedprice", 4).alias("l_extendedprice"),
        "l_returnflag",
        "l_tax",
        F.round("l_discount", 6).alias("l_discount"),
    )


def _diff(seq: int, column: str, action: str, before: str, after: str, affected: str, cells: str) -> str:
    count = lambda t: f"(SELECT count(*) - count({column}) FROM {t})"
    unique = lambda t: f"(SELECT count(DISTINCT {column}) FROM {t})"
    gone = after == "-"
    return f"""SELECT {seq} AS seq, '{column}' AS "column", '{action}' AS action_type,
  {affected} AS rows_affected, {cells} AS cells_changed, {count(before)} AS missing_before,
  {'NULL' if gone else count(after)} AS missing_after, {unique(before)} AS n_unique_before,
  {'NULL' if gone else unique(after)} AS n_unique_after"""


_BLANK = "(SELECT count(*) - count({c}) FROM {t})"
_DROPPED = "(SELECT count(*) FROM s1) - (SELECT count(*) FROM s2)"


@query(
    "plan_diff",
    f"WITH {STAGES} "
    + "\nUNION ALL\n".join(
        [
            _diff(1, "l_quantity", "impute_median", "d", "s1", *[_BLANK.format(c="l_quantity", t="d")] * 2),
            _diff(
                2, "l_extendedprice", "cap_outliers", "d", "s1", "0",
                "(SELECT count(*) FROM d, q WHERE l_extendedprice NOT BETWEEN "
                "q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))",
            ),
            _diff(3, "l_returnflag", "impute_mode", "d", "s1", *[_BLANK.format(c="l_returnflag", t="d")] * 2),
            _diff(5, "l_tax", "drop_rows", "s1", "s2", _DROPPED, _DROPPED),
            _diff(6, "l_discount", "impute_mean", "s2", "s3", *[_BLANK.format(c="l_discount", t="s2")] * 2),
            _diff(7, "l_suppkey", "drop_column", "s2", "-", *["(SELECT count(*) FROM s2)"] * 2),
        ]
    ),
)
def plan_diff(spark, sf_dir):
    diff = apply_plan(dirt.lineitem(spark, sf_dir), PLAN).diff
    return diff.select(
        "seq",
        "column",
        "action_type",
        "rows_affected",
        "cells_changed",
        F.col("before_stat.missing_count").alias("missing_before"),
        F.col("after_stat.missing_count").alias("missing_after"),
        F.col("before_stat.n_unique").alias("n_unique_before"),
        F.col("after_stat.n_unique").alias("n_unique_after"),
    )


@query(
    "plan_log",
    f"""WITH {STAGES} SELECT * FROM (VALUES
  (1, 'executed_impute_median', {_BLANK.format(c="l_quantity", t="d")}),
  (2, 'executed_cap_outliers', 0),
  (3, 'executed_impute_mode', {_BLANK.format(c="l_returnflag", t="d")}),
  (4, 'skipped_no_action', NULL), (5, 'executed_drop_rows', {_DROPPED}),
  (6, 'executed_impute_mean', {_BLANK.format(c="l_discount", t="s2")}),
  (7, 'executed_drop_column', (SELECT count(*) FROM s2)), (8, 'skipped_failed_action', NULL)
) v(seq, action, rows_affected)""",
)
def plan_audit(spark, sf_dir):
    log = plan_log(apply_plan(dirt.lineitem(spark, sf_dir), PLAN), "run")
    affected = F.get_json_object("detail", "$.rows_affected").cast("bigint")
    return log.select(F.col("seq").cast("int"), "action", affected.alias("rows_affected"))


# Proposals of many data sets, one per user: each event proposes an action and a chart.
PROPOSED = """pr AS (SELECT event_id AS seq, user_id AS dataset_id,
    CASE WHEN event_id % 4 = 0 THEN 'gone' ELSE 'col_' || event_type END AS "column",
    CASE event_id % 6 WHEN 0 THEN 'magic_fix' WHEN 1 THEN NULL WHEN 2 THEN 'impute_mean'
      WHEN 3 THEN 'drop_rows' WHEN 4 THEN 'cap_outliers' ELSE 'parse_dates' END AS action_type,
    CASE WHEN event_id % 13 <> 0 THEN props END AS rationale FROM events)"""


def _proposals(spark, sf_dir):
    n = F.col("event_id")
    return dirt.table(spark, sf_dir, "events").select(
        n.alias("seq"),
        F.col("user_id").alias("dataset_id"),
        F.when(n % 4 == 0, "gone").otherwise(F.concat(F.lit("col_"), "event_type")).alias("column"),
        F.when(n % 6 == 0, "magic_fix")
        .when(n % 6 == 1, F.lit(None))
        .when(n % 6 == 2, "impute_mean")
        .when(n % 6 == 3, "drop_rows")
        .when(n % 6 == 4, "cap_outliers")
        .otherwise("parse_dates")
        .alias("action_type"),
        F.when(n % 13 != 0, F.col("props")).alias("rationale"),
    )


@query(
    "plan_vetting",
    f"""WITH {PROPOSED}, known AS (
    SELECT DISTINCT user_id AS dataset_id, 'col_' || event_type AS "column" FROM events WHERE value > 100)
SELECT seq, dataset_id, "column", action_type,
  CASE WHEN "column" IS NULL OR rationale IS NULL OR action_type IS NULL OR action_type = 'magic_fix'
    THEN 'rejected_invalid_action'
  WHEN k.dataset_id IS NULL THEN 'rejected_nonexistent_column' END AS reason
FROM pr LEFT JOIN known k USING (dataset_id, "column")""",
)
def plan_vetting(spark, sf_dir):
    seen = dirt.table(spark, sf_dir, "events").where(F.col("value") > 100)
    known = seen.select(
        F.col("user_id").alias("dataset_id"), F.concat(F.lit("col_"), "event_type").alias("column")
    )
    return vet_plan(_proposals(spark, sf_dir), known).drop("rationale")


@query(
    "plan_approved",
    f"""WITH {PROPOSED} SELECT seq, dataset_id, "column", action_type FROM pr
WHERE seq NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
)
def plan_approved(spark, sf_dir):
    turned_down = dirt.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    kept = approved(_proposals(spark, sf_dir), turned_down.select(F.col("event_id").alias("seq")))
    return kept.drop("rationale")


STORED = [
    ("a", 1, "l_quantity", "impute_median", "gaps"),
    ("a", 2, "l_quantity", "magic_fix", "unknown action"),
    ("a", 3, "gone", "drop_column", "unknown column"),
    ("a", 4, "l_discount", "impute_mean", "turned down"),
    ("a", 5, "l_tax", "drop_rows", "gaps"),
    ("b", 1, "l_tax", "drop_column", "of another data set"),
    ("b", 4, "l_quantity", "drop_rows", "of another data set"),
]


@query(
    "plan_from_table",
    f"""WITH {dirt.LINEITEM}, m AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM d)
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, q)::DOUBLE AS l_quantity, l_discount FROM d, m
WHERE l_tax IS NOT NULL""",
)
def plan_from_table(spark, sf_dir):
    """Plans of two data sets as a table: vetted, approved, read and one of them applied."""
    df = dirt.lineitem(spark, sf_dir)
    rows = [(*r, None) for r in STORED]
    ddl = "dataset_id string, " + PLAN_DDL
    plan = spark.createDataFrame(rows, ddl)
    known = spark.createDataFrame([(d, c) for d in "ab" for c in df.columns], "dataset_id string, column string")
    sound = vet_plan(plan, known).where("reason IS NULL").drop("reason")
    rejected = spark.createDataFrame([("a", 4), ("b", 5)], "dataset_id string, seq int")
    actions = read_plan(approved(sound, rejected), "a")
    return apply_plan(df, actions).df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


COLUMN_SETS = [["num_a"], ["cat_a", "num_a"], ["num_a", "num_b"], ["date_a", "num_b"], ["num_a", "gone"], ["cat_a"]]
CHART_NAMES = ["histogram", "box", "bar", "line", "scatter", "heatmap", "pie", "treemap"]


def _case(key: str, values: list) -> str:
    text = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


@query(
    "intent_vetting",
    f"""WITH i AS (SELECT event_id AS seq, {_case('event_id % 8', CHART_NAMES)} AS chart_type,
    {_case('event_id % 6', COLUMN_SETS)} AS columns, value / 80 AS score,
    CASE WHEN event_id % 29 <> 0 THEN event_type END AS category FROM events),
  k AS (SELECT *, [CASE c WHEN 'num_a' THEN 'n' WHEN 'num_b' THEN 'n' WHEN 'cat_a' THEN 'c'
    WHEN 'date_a' THEN 'd' END FOR c IN columns] AS kinds FROM i)
SELECT seq, chart_type, array_to_string(columns, ',') AS columns,
  CASE WHEN chart_type = 'treemap' OR category IS NULL OR score NOT BETWEEN 0 AND 5
    THEN 'rejected_invalid_intent'
  WHEN list_contains(columns, 'gone') THEN 'rejected_nonexistent_columns'
  WHEN NOT CASE WHEN chart_type IN ('histogram', 'box') THEN kinds[1] = 'n'
    WHEN chart_type IN ('bar', 'pie') THEN kinds[1] = 'c'
    WHEN chart_type = 'line' THEN len(kinds) >= 2 AND kinds[2] = 'n'
    WHEN chart_type = 'scatter' THEN len(kinds) >= 2 AND kinds[1] = 'n' AND kinds[2] = 'n'
    ELSE len(kinds) >= 2 AND kinds[1] = 'n' AND kinds[2] = 'n' END
    THEN 'rejected_dtype_incompatible' END AS reason
FROM k""",
)
def intent_vetting(spark, sf_dir):
    n = F.col("event_id")
    sets = F.array(*[F.array(*[F.lit(c) for c in s]) for s in COLUMN_SETS])
    names = F.array(*[F.lit(c) for c in CHART_NAMES])
    events = dirt.table(spark, sf_dir, "events")
    intents = events.select(
        n.alias("seq"),
        F.col("user_id").alias("dataset_id"),
        F.get(names, (n % 8).cast("int")).alias("chart_type"),
        F.get(sets, (n % 6).cast("int")).alias("columns"),
        F.col("props").alias("rationale"),
        (F.col("value") / 80).alias("priority_score"),
        F.when(n % 29 != 0, F.col("event_type")).alias("category"),
    )
    fields = [("num_a", "numeric"), ("num_b", "numeric"), ("cat_a", "categorical"), ("date_a", "datetime")]
    catalogue = events.select(
        F.col("user_id").alias("dataset_id"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("class")) for c, k in fields])),
    )
    out = vet_intents(intents, catalogue)
    return out.select("seq", "chart_type", F.array_join("columns", ",").alias("columns"), "reason")

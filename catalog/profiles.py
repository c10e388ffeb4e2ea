"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.lineage import scratch_path
from dqspark.operators.clean import apply_fitted, fit
from dqspark.operators.frequency import (
    approximate_distinct_counts,
    distinct_counts,
    frequency_table,
    top_values,
)
from dqspark.operators.frequent import frequent_values
from dqspark.operators.profile import (
    column_fences,
    column_moments,
    column_stats,
    compare_profiles,
    date_rates,
    issue_count,
    profile,
)
from dqspark.operators.quantiles import grouped_quantiles
from dqspark.operators.state import append_state, described, stored_state
from dqspark.plans.actions import Action, numbered
from dqspark.types import normalise_missing

NUMERIC = dirt.LINEITEM_NUMERIC


def _each(template: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


NUMBERS = """SELECT '{c}' AS "column", count(*) AS n_rows,
  round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_pct,
  count(DISTINCT {c}) AS n_unique, round(avg({c}::DOUBLE), 4) AS mean,
  round(stddev_samp({c}::DOUBLE), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3
FROM d"""

OUTLIERS = """SELECT '{c}' AS "column", (SELECT count(*) FROM d, (
    SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM d) q
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outlier_count"""


@query("profile_numeric", f"WITH {dirt.LINEITEM} {_each(NUMBERS, NUMERIC)}")
def profile_numeric(spark, sf_dir):
    p = profile(dirt.lineitem(spark, sf_dir), NUMERIC)
    return p.select(
        "column",
        "n_rows",
        "missing_pct",
        "n_unique",
        "mean",
        "std",
        "min",
        "max",
        F.round("q1", 4).alias("q1"),
        F.round("q3", 4).alias("q3"),
    )


MISSING = [*NUMERIC, "l_returnflag", "l_linestatus"]


@query(
    "profile_missing",
    f"WITH {dirt.LINEITEM} "
    + _each(
        """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
  round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_pct FROM d""",
        MISSING,
    ),
)
def profile_missing(spark, sf_dir):
    m = column_moments(normalise_missing(dirt.lineitem(spark, sf_dir)), MISSING)
    n, v = F.col("n_rows"), F.col("n_valid")
    return m.select("column", (n - v).alias("missing_count"), F.round((n - v) / n, 4).alias("missing_pct"))


DISTINCT = [*NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "profile_distinct",
    f"WITH {dirt.LINEITEM} "
    + _each('SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_unique FROM d', DISTINCT),
)
def profile_distinct(spark, sf_dir):
    return distinct_counts(dirt.lineitem(spark, sf_dir), DISTINCT)


@query(
    "profile_distinct_approx",
    f"WITH {dirt.LINEITEM} "
    + _each('SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS n_unique, true AS within_5_percent FROM d', DISTINCT),
)
def profile_distinct_approx(spark, sf_dir):
    """Sketches beside the exact counts."""
    df = normalise_missing(dirt.lineitem(spark, sf_dir))
    guess = approximate_distinct_counts(df, DISTINCT).withColumnRenamed("n_unique", "guess")
    near = F.abs(F.col("guess") - F.col("n_unique")) <= 0.05 * F.col("n_unique")
    return distinct_counts(df, DISTINCT).join(guess, "column").select("column", "n_unique", near.alias("within_5_percent"))


QUARTILES = """SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1,
  round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3 FROM {t}"""


@query(
    "profile_quartiles",
    _each(QUARTILES.replace("{t}", "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]),
)
def profile_quartiles(spark, sf_dir):
    found = column_fences(dirt.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    rows = [(c, round(v[0], 4), round(v[1], 4)) for c, v in found.items()]
    return spark.createDataFrame(rows, "column string, q1 double, q3 double")


@query("profile_iqr_outliers", f"WITH {dirt.LINEITEM} {_each(OUTLIERS, NUMERIC)}")
def profile_iqr_outliers(spark, sf_dir):
    df = dirt.lineitem(spark, sf_dir)
    limits = column_fences(df, NUMERIC)
    return column_moments(normalise_missing(df), NUMERIC, limits).select("column", "iqr_outlier_count")


TOP = """SELECT "column", value, n, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM (
    SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))
WHERE place <= 10"""


@query(
    "profile_top_values",
    f"WITH {dirt.EVENTS} "
    + _each(TOP.replace("{t}", "e"), ["event_type", "props"])
    + "\nUNION ALL\n"
    + _each(TOP.replace("{t}", "part"), ["p_brand", "p_type", "p_name"]),
)
def profile_top_values(spark, sf_dir):
    e = frequency_table(dirt.events(spark, sf_dir), ["event_type", "props"])
    p = frequency_table(dirt.table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])
    return top_values(e.unionByName(p))


FREQUENT = ["l_returnflag", "l_linestatus", "l_partkey", "l_orderkey"]


@query(
    "frequent_values",
    f"WITH {dirt.LINEITEM} " + _each(TOP.replace("{t}", "d").replace("{c} AS value", "{c}::VARCHAR AS value"), FREQUENT),
)
def most_frequent_values(spark, sf_dir):
    """Labels and keys: some columns are settled by their summaries, some need the second count, some all of it."""
    return frequent_values(dirt.lineitem(spark, sf_dir), FREQUENT)


@query(
    "quantiles_many_groups",
    f"""WITH {dirt.LINEITEM} SELECT l_orderkey, l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM d GROUP BY ALL""",
)
def quantiles_many_groups(spark, sf_dir):
    """Quartiles of tens of thousands of small groups, one of them NULL in part."""
    keys = ["l_orderkey", "l_returnflag"]
    found = grouped_quantiles(dirt.lineitem(spark, sf_dir), keys, "l_extendedprice", [0.25, 0.5, 0.9])
    return found.select(*keys, *[F.round(F.get("q", i), 4).alias(n) for i, n in enumerate(("q1", "median", "p90"))])


MERGED = """SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_valid, round(avg({c}::DOUBLE), 4) AS mean,
  round(stddev_samp({c}::DOUBLE), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, true AS distinct_near,
  true AS ranks_near FROM d"""


@query("profile_merged_states", f"WITH {dirt.LINEITEM} {_each(MERGED, NUMERIC)}")
def profile_merged_states(spark, sf_dir):
    """States of two halves of a table, stored one after the other and merged: moments exact, sketches near."""
    df = normalise_missing(dirt.lineitem(spark, sf_dir))
    path = scratch_path(spark, "state")
    for half in (0, 1):
        append_state(df.where(F.col("l_orderkey") % 2 == half), path, NUMERIC)
    told = described(stored_state(spark, path), [0.25, 0.9])
    quantiles = {r["column"]: r["q"] for r in told.select("column", "q").collect()}  # a row per column
    ranks = []
    for c, q in quantiles.items():
        x = F.col(c).cast("double")
        # the share of values below and up to an estimate must take in what it stands for
        fits = F.lit(True)
        for value, p in zip(q, (0.25, 0.9)):
            fits = fits & (F.try_divide(F.count_if(x < value), F.count(x)) <= p + 0.02) & (F.try_divide(F.count_if(x <= value), F.count(x)) >= p - 0.02)
        ranks.append(F.struct(F.lit(c).alias("column"), fits.alias("ranks_near")))
    ranks = df.agg(F.array(*ranks).alias("r")).select(F.inline("r"))
    near = F.abs(F.col("n_unique") - F.col("exact")) <= 0.05 * F.col("exact")
    out = told.join(distinct_counts(df, NUMERIC).withColumnRenamed("n_unique", "exact"), "column").join(ranks, "column")
    return out.select(
        "column", "n_rows", "n_valid", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        "min", "max", near.alias("distinct_near"), "ranks_near",
    )


@query(
    "profile_date_like",
    f"""WITH {dirt.ORDERS}
SELECT 'order_date' AS "column", '%Y-%m-%d' AS date_format,
  round(count(try_strptime(order_date, '%Y-%m-%d')) / count(order_date)::DOUBLE, 4) AS rate FROM o
UNION ALL
SELECT 'o_orderpriority', '%Y-%m-%d',
  round(count(try_strptime(o_orderpriority, '%Y-%m-%d')) / count(o_orderpriority)::DOUBLE, 4) FROM o""",
)
def profile_date_like(spark, sf_dir):
    ft = frequency_table(dirt.orders(spark, sf_dir), ["order_date", "o_orderpriority"])
    return date_rates(ft).select("column", "date_format", F.round("rate", 4).alias("rate"))


FULL_NUMERIC = """SELECT '{c}' AS "column", 'TYPE' AS dtype, round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_pct,
  count(DISTINCT {c}) AS n_unique, round(avg({c}::DOUBLE), 4) AS mean,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, (SELECT count(*) FROM e, (
    SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM e) q
    WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS iqr_outlier_count,
  NULL::VARCHAR AS top, NULL::BIGINT AS near_duplicate_pairs FROM e"""
FULL_OTHER = """SELECT '{c}', 'TYPE', round(1 - count({c}) / count(*)::DOUBLE, 4), count(DISTINCT {c}),
  NULL, NULL, NULL, TOP, NEAR FROM e"""
TOP_TEXT = """(SELECT string_agg(value || '=' || n, ';' ORDER BY n DESC, value) FROM (
    SELECT {c} AS value, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10))"""


def _full() -> str:
    parts = [
        FULL_NUMERIC.replace("{c}", c).replace("TYPE", t)
        for c, t in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))
    ]
    for c, t, top, near in (
        ("ts", "timestamp_ntz", "NULL", "NULL"),
        ("event_type", "string", TOP_TEXT, "(SELECT count(*) FROM near_)"),
        ("props", "string", TOP_TEXT, "NULL"),
    ):
        other = FULL_OTHER.replace("TYPE", t).replace("TOP", top).replace("NEAR", near)
        parts.append(other.replace("{c}", c))
    labels = """labels_ AS (SELECT DISTINCT 'event_type' AS "column", event_type AS value FROM e
    WHERE event_type IS NOT NULL)"""
    near = f"near_ AS ({dirt.NEAR})"
    return f"WITH RECURSIVE {dirt.EVENTS}, {labels}, {dirt.PAIRS}, {dirt.LCS}, {near} " + "\nUNION ALL\n".join(parts)


@query("profile_full", _full())
def profile_full(spark, sf_dir):
    p = profile(dirt.events(spark, sf_dir), near_duplicate_columns=["event_type"])
    entry = F.transform(F.map_entries("top_values"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return p.select(
        "column",
        "dtype",
        "missing_pct",
        "n_unique",
        "mean",
        F.round("q1", 4).alias("q1"),
        "iqr_outlier_count",
        F.when(F.col("top_values").isNotNull(), F.array_join(entry, ";")).alias("top"),
        "near_duplicate_pairs",
    )


STATS = """SELECT '{c}' AS "column", false AS dropped, count(*) - count({c}) AS missing_count,
  round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_pct, count(DISTINCT {c}) AS n_unique,
  '{t}' AS dtype, {m} FROM d"""
MOMENTS = """round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
  max({c})::DOUBLE AS max"""
NONE = "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max"


@query(
    "column_stats",
    f"WITH {dirt.LINEITEM} "
    + "\nUNION ALL\n".join(
        [
            STATS.replace("{m}", MOMENTS).replace("{c}", "l_quantity").replace("{t}", "double"),
            STATS.replace("{m}", MOMENTS).replace("{c}", "l_linenumber").replace("{t}", "int"),
            STATS.replace("{m}", NONE).replace("{c}", "l_returnflag").replace("{t}", "string"),
            """SELECT 'l_gone', true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
        ]
    ),
)
def stats_snapshot(spark, sf_dir):
    stats = column_stats(
        normalise_missing(dirt.lineitem(spark, sf_dir)), ["l_quantity", "l_linenumber", "l_returnflag", "l_gone"]
    )
    return stats.drop("n_rows")


ISSUES = f"""WITH {dirt.LINEITEM}, i AS (
{_each(OUTLIERS.replace(' AS iqr_outlier_count', ' AS n_out, (SELECT count(*) - count({c}) FROM d) AS n_missing'), NUMERIC)}
UNION ALL SELECT 'l_returnflag', 0, (SELECT count(*) - count(l_returnflag) FROM d)
UNION ALL SELECT 'l_linestatus', 0, 0 UNION ALL SELECT 'l_shipdate', 0, 0)
SELECT count(*) AS columns_audited, count(*) FILTER (n_out > 0 OR n_missing > 0) AS columns_with_issues FROM i"""


@query("profile_issues", ISSUES)
def profile_issues(spark, sf_dir):
    return issue_count(profile(dirt.lineitem(spark, sf_dir)))


COMPARED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_compare",
    f"WITH {dirt.LINEITEM} "
    + _each(
        """SELECT '{c}' AS "column", 'double' AS dtype_before, 'double' AS dtype_after,
  round(1 - count({c}) / count(*)::DOUBLE, 4) AS missing_pct_before,
  CASE WHEN '{c}' = 'l_tax' THEN round(1 - count({c}) / count(*)::DOUBLE, 4) ELSE 0.0 END AS missing_pct_after,
  nullif(round((round(1 - count({c}) / count(*)::DOUBLE, 4)
    - CASE WHEN '{c}' = 'l_tax' THEN round(1 - count({c}) / count(*)::DOUBLE, 4) ELSE 0.0 END) * 100, 1), 0)
    AS missing_pp_gained FROM d""",
        COMPARED[:2] + COMPARED[3:],
    )
    + """
UNION ALL SELECT 'l_discount', 'double', NULL, round(1 - count(l_discount) / count(*)::DOUBLE, 4), NULL, NULL FROM d""",
)
def profile_compare(spark, sf_dir):
    before = normalise_missing(dirt.lineitem(spark, sf_dir).select(*COMPARED))
    actions = numbered([Action("l_quantity", "impute_mean"), Action("l_discount", "drop_column")])
    after = apply_fitted(before, fit(before, actions))
    both = compare_profiles(profile(before), profile(after))
    return both.drop("n_unique_before", "n_unique_after")

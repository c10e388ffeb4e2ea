"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.operators.charts import chart_data, heatmap, histogram, line, scatter
from dqspark.plans.actions import Intent


@query(
    "chart_histogram",
    f"""WITH {dirt.LINEITEM}, r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM d)
SELECT (g.i + 1)::INTEGER AS bin, round(lo + g.i * ((hi - lo) / 20), 6) AS bin_start, coalesce(n, 0) AS n
FROM r, range(0, 20) g(i) LEFT JOIN (
  SELECT least(floor(20 * (l_quantity - lo) / (hi - lo)), 19)::BIGINT AS b, count(*) AS n
  FROM d, r WHERE l_quantity IS NOT NULL GROUP BY 1) c ON c.b = g.i""",
)
def chart_histogram(spark, sf_dir):
    bins = histogram(dirt.lineitem(spark, sf_dir), "l_quantity", 20)
    return bins.select("bin", F.round("bin_start", 6).alias("bin_start"), "n")


BOX = """{p}, q AS (SELECT {g} AS "group", quantile_cont({x}::DOUBLE, 0.25) AS q1,
    quantile_cont({x}::DOUBLE, 0.5) AS median, quantile_cont({x}::DOUBLE, 0.75) AS q3 FROM {t} GROUP BY 1)
SELECT {out} round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n,
  min({x}) AS min, max({x}) AS max,
  min({x}) FILTER ({x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max({x}) FILTER ({x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({x} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM {t} JOIN q ON "group" = {g} WHERE {x} IS NOT NULL GROUP BY "group", q1, median, q3"""


def _box(**parts: str) -> str:
    sql = BOX
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _rounded(df):
    for c in ("q1", "median", "q3"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "chart_box",
    _box(p=f"WITH {dirt.LINEITEM}", g="l_returnflag", x="l_extendedprice", t="d", out='"group",'),
)
def chart_box(spark, sf_dir):
    intent = Intent("box", ("l_extendedprice", "l_returnflag"))
    return _rounded(chart_data(dirt.lineitem(spark, sf_dir), intent))


@query(
    "chart_box_overall", _box(p=f"WITH {dirt.EVENTS}", g="'all'", x="value", t="e", out="")
)
def chart_box_overall(spark, sf_dir):
    return _rounded(chart_data(dirt.events(spark, sf_dir), Intent("box", ("value",))))


@query(
    "chart_bar_mean",
    f"""WITH {dirt.LINEITEM} SELECT l_returnflag AS label, round(avg(l_quantity), 4) AS mean FROM d
WHERE l_returnflag IS NOT NULL GROUP BY 1""",
)
def chart_bar_mean(spark, sf_dir):
    out = chart_data(dirt.lineitem(spark, sf_dir), Intent("bar", ("l_returnflag", "l_quantity")))
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "chart_bar_count",
    f"""WITH {dirt.EVENTS} SELECT event_type AS label, count(*) AS n FROM e
WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, label""",
)
def chart_bar_count(spark, sf_dir):
    return chart_data(dirt.events(spark, sf_dir), Intent("bar", ("event_type",)))


@query("chart_line", f"WITH {dirt.EVENTS} SELECT user_id AS x, value AS y FROM e ORDER BY x, y")
def chart_line(spark, sf_dir):
    return chart_data(dirt.events(spark, sf_dir), Intent("line", ("user_id", "value")))


@query(
    "chart_line_mean",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, round(avg(o_totalprice), 6) AS y
FROM orders GROUP BY o_orderdate""",
)
def chart_line_mean(spark, sf_dir):
    points = line(dirt.table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", mean=True)
    return points.select(F.date_format("x", "yyyy-MM-dd").alias("x"), F.round("y", 6).alias("y"))


@query(
    "chart_scatter",
    f"""WITH {dirt.LINEITEM} SELECT l_quantity AS x, l_discount AS y FROM d
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL""",
)
def chart_scatter(spark, sf_dir):
    return chart_data(dirt.lineitem(spark, sf_dir), Intent("scatter", ("l_quantity", "l_discount")))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "chart_corr",
    f"WITH {dirt.LINEITEM} "
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM d"
        for a in CORR
        for b in CORR
    ),
)
def chart_corr(spark, sf_dir):
    out = chart_data(dirt.lineitem(spark, sf_dir), Intent("heatmap", tuple(CORR)))
    return out.withColumn("corr", F.round("corr", 6) + 0.0)


WIDE = [*CORR, "l_linenumber", *(f"v{i}" for i in range(12))]
#: Columns made of others by the same arithmetic on both sides, some with missing cells, one constant.
MADE = ", ".join(f"l_extendedprice / (l_partkey % {i + 3} + 1) + l_quantity * {i} AS v{i}" for i in range(11)) + ", 2.5 + 0 * l_tax AS v11"


@query(
    "chart_corr_wide",
    f"""WITH {dirt.LINEITEM}, w AS (SELECT *, {MADE} FROM d),
c AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN 'v11' IN ('{a}', '{b}') THEN NULL ELSE corr({a}, {b}) END AS corr FROM w"
    for a in WIDE for b in WIDE)})
SELECT column_a, column_b, round(corr, 5) + 0.0 AS corr FROM c""",
)
def chart_corr_wide(spark, sf_dir):
    """All pairs of many columns from one scan; a constant column has no correlation."""
    df = dirt.lineitem(spark, sf_dir).withColumn("l_tax", F.nanvl("l_tax", F.lit(None).cast("double")))
    out = heatmap(df.selectExpr("*", *MADE.split(", ")), WIDE)
    return out.withColumn("corr", F.round("corr", 5) + 0.0)


@query(
    "chart_scatter_sample",
    f"""WITH {dirt.LINEITEM}, p AS (SELECT l_quantity AS x, l_discount AS y,
    md5(concat_ws('|', '7', l_orderkey::VARCHAR, l_linenumber::VARCHAR)) AS o
  FROM d WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
SELECT x, y, (SELECT count(*) FROM p) AS n_points FROM (SELECT * FROM p ORDER BY o, x, y LIMIT 2000)""",
)
def chart_scatter_sample(spark, sf_dir):
    df = dirt.lineitem(spark, sf_dir)
    return scatter(df, "l_quantity", "l_discount", max_points=2000, key=["l_orderkey", "l_linenumber"], seed=7)


@query(
    "chart_pie_sum",
    """SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS total,
  round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 6) AS share FROM customer GROUP BY 1""",
)
def chart_pie_sum(spark, sf_dir):
    out = chart_data(dirt.table(spark, sf_dir, "customer"), Intent("pie", ("c_mktsegment", "c_acctbal")))
    return out.withColumn("total", F.round("total", 2)).withColumn("share", F.round("share", 6))


@query(
    "chart_pie_count",
    f"""WITH {dirt.EVENTS} SELECT event_type AS label, count(*) AS n,
  round(count(*) / (SELECT count(event_type) FROM e)::DOUBLE, 6) AS share
FROM e WHERE event_type IS NOT NULL GROUP BY 1""",
)
def chart_pie_count(spark, sf_dir):
    out = chart_data(dirt.events(spark, sf_dir), Intent("pie", ("event_type",)))
    return out.withColumn("share", F.round("share", 6))

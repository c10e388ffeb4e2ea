import math

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.operators.charts import bar, box, chart_data, heatmap, histogram, line, pie, scatter
from dqspark.operators.verify import check_chart, mismatches, recheck, scatter_count
from dqspark.plans.actions import CHART_TYPES, Intent
from dqspark.types import IncompatibleColumn

GOOD = {
    "histogram": ("age",),
    "box": ("salary", "department"),
    "bar": ("department", "salary"),
    "line": ("date", "salary"),
    "scatter": ("age", "salary"),
    "heatmap": ("age", "salary"),
    "pie": ("status",),
}
BAD = [
    ("histogram", ("department",)),
    ("histogram", ()),
    ("box", ("status",)),
    ("bar", ("age",)),
    ("line", ("date", "status")),
    ("line", ("date",)),
    ("scatter", ("age", "status")),
    ("scatter", ("age",)),
    ("heatmap", ("age",)),
    ("heatmap", ("age", "salary", "status")),
    ("pie", ("salary",)),
    ("bar", ("nope",)),
]


def rows(df: DataFrame):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chart", CHART_TYPES)
def test_good_columns_are_charted_and_verified(mixed, chart):
    intent = Intent(chart, GOOD[chart], "c")
    assert chart_data(mixed, intent).count() > 0
    assert recheck(mixed, intent, chart_data(mixed, intent)).count() == 0
    assert check_chart(mixed, "x", intent).first().status == "verified"


@pytest.mark.parametrize("chart,columns", BAD)
def test_bad_columns_are_refused(mixed, chart, columns):
    with pytest.raises(IncompatibleColumn):
        chart_data(mixed, Intent(chart, columns))
    assert check_chart(mixed, "x", Intent(chart, columns)).first().status == "failed"


def test_intents_are_checked():
    for chart, score in (("treemap", 1.0), ("bar", -0.1), ("bar", 5.1)):
        with pytest.raises(ValueError):
            Intent(chart, ("a",), priority_score=score)


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (9.9,), (10.0,), (None,)], "x double")
    assert rows(histogram(df, "x", 5).select("bin", "n")) == [(1, 3), (2, 0), (3, 0), (4, 0), (5, 2)]
    assert rows(histogram(df.where("x = 1"), "x")) == [(1, 1.0, 1.0, 1)]
    assert rows(histogram(df.where("x IS NULL"), "x")) == []


def test_box_numbers(spark):
    values = {"a": [1.0, 2.0, 3.0, 4.0, 100.0], "b": [5.0]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("a", None), (None, 7.0)], "g string, x double")
    got = {r["group"]: r for r in box(df, "x", "g").collect()}
    a = got["a"]
    assert (a.q1, a["median"], a.q3, a.n, a["min"], a["max"]) == (2.0, 3.0, 4.0, 5, 1.0, 100.0)
    assert (a.whisker_low, a.whisker_high, a.n_outliers) == (1.0, 4.0, 1)
    assert got["b"].q1 == got["b"].q3 == 5.0 and set(got) == {"a", "b"}
    assert box(df, "x").first()["n"] == 7
    assert box(df.limit(0), "x").count() == 0


def test_bars_and_pies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), (None, 5), ("b", None), ("b", 2)], "k string, v int")
    assert rows(bar(df, "k", "v")) == [("a", 2.0), ("b", 2.0)]
    assert [tuple(r) for r in bar(df, "k").collect()] == [("b", 3), ("a", 2)]
    assert rows(pie(df, "k", "v")) == [("a", 4.0, 4 / 6), ("b", 2.0, 2 / 6)]
    assert rows(pie(df, "k")) == [("a", 2, 0.4), ("b", 3, 0.6)]
    nothing = df.where("k = 'b' AND v IS NULL")
    assert rows(pie(nothing, "k", "v")) == [("b", 0.0, None)]
    assert rows(bar(nothing, "k", "v")) == [("b", None)]


def test_line_and_scatter(spark):
    df = spark.createDataFrame([(2, 1.0), (1, None), (None, 3.0), (1, 4.0)], "x int, y double")
    assert [tuple(r) for r in line(df, "x", "y").collect()] == [(1, 4.0), (1, None), (2, 1.0), (None, 3.0)]
    assert [tuple(r) for r in line(df, "x", "y", mean=True).collect()] == [(1, 4.0), (2, 1.0), (None, 3.0)]
    assert rows(scatter(df, "x", "y")) == [(1.0, 4.0), (2.0, 1.0)]
    assert tuple(scatter_count(df, scatter(df, "x", "y"), "x", "y").first()) == (2, 2, True)


def test_correlations_are_pairwise_complete(spark):
    data = [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0), (float("nan"), 1.0, 5.0)]
    df = spark.createDataFrame(data, "a double, b double, k double")
    got = {(r.column_a, r.column_b): r["corr"] for r in heatmap(df, ["a", "b", "k"]).collect()}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"]
    assert math.isclose(got["a", "b"], np.corrcoef([1, 2, 4], [2, 4.5, 8])[0, 1])
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "k"] is None and got["k", "k"] is None


@pytest.mark.parametrize(
    "chart,columns,wrong",
    [
        ("bar", ("department", "salary"), ("mean", "label = 'x'")),
        ("bar", ("department",), ("n", "label = 'x'")),
        ("pie", ("department", "salary"), ("total", "label = 'y'")),
        ("histogram", ("salary",), ("n", "bin = 1")),
        ("box", ("salary", "department"), ("q1", "group = 'x'")),
        ("box", ("salary",), ("n_outliers", "n > 0")),
        ("heatmap", ("age", "salary"), ("corr", "column_a < column_b")),
        ("line", ("date", "salary"), ("y", "y = 3000")),
    ],
)
def test_a_wrong_number_is_found(mixed, chart, columns, wrong):
    measure, where = wrong
    intent = Intent(chart, columns)
    shown = chart_data(mixed, intent)
    shown = shown.withColumn(measure, F.when(F.expr(where), F.col(measure) - 999_999).otherwise(F.col(measure)))
    assert recheck(mixed, intent, shown).count() >= 1
    assert check_chart(mixed, "x", intent, shown).first().status == "flagged"


def test_missing_and_extra_keys_are_mismatches(spark):
    a = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([("b", 1.0), (None, 2.0)], "k string, v double")
    assert rows(mismatches(a, b, ["k"], ["v"])) == [("a", "v", 1.0, None), ("b", "v", None, 1.0)]


def test_scatter_may_miss_one_point(mixed):
    intent = Intent("scatter", ("age", "salary"))
    assert scatter_count(mixed, chart_data(mixed, intent).limit(6), "age", "salary").first().agrees
    assert not scatter_count(mixed, chart_data(mixed, intent).limit(5), "age", "salary").first().agrees
    assert check_chart(mixed, "x", intent, chart_data(mixed, intent).limit(0)).first().status == "flagged"

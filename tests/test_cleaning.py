import datetime as dt

import pytest
from pyspark.sql import functions as F

from dqspark.functions.dates import CANDIDATE_FORMATS, UnknownDateFormat, shape, spark_pattern
from dqspark.operators.clean import clean
from dqspark.operators.frequency import mode_of
from dqspark.plans.actions import ACTION_TYPES, Action
from dqspark.plans.executor import apply_plan
from dqspark.sources.audit import plan_log
from dqspark.types import ColumnNotFound, IncompatibleColumn


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_every_action_runs(numeric):
    for action in ACTION_TYPES:
        target = "name" if action in ("standardize_categories", "parse_dates") else "age"
        assert clean(numeric, target, action).count() in (5, 7)


def test_impute_mean_takes_null_and_nan(numeric):
    out = column(clean(numeric, "age", "impute_mean"), "age")
    assert out[2] == out[5] == pytest.approx(31.6)
    assert column(numeric, "age")[2] is None


def test_impute_median(numeric):
    assert column(clean(numeric, "age", "impute_median"), "age")[2] == 30.0


def test_integers_can_hold_a_fractional_mean(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "x int")
    assert column(clean(df, "x", "impute_mean"), "x") == [1.0, 2.5, 4.0]


def test_imputing_other_types_changes_nothing(numeric):
    assert column(clean(numeric, "name", "impute_mean"), "name") == column(numeric, "name")


def test_impute_mode(spark):
    df = spark.createDataFrame([("red",), ("red",), ("blue",), (None,), ("red",)], "color string")
    assert column(clean(df, "color", "impute_mode"), "color")[3] == "red"


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (9,), (10,)], "x int")
    assert mode_of(df, "x") == "9"
    assert column(clean(df, "x", "impute_mode"), "x") == [10, 9, 9, 9, 10]


def test_mode_of_timestamps_and_of_nothing(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.5' AS t UNION ALL SELECT NULL")
    assert column(clean(df, "t", "impute_mode"), "t") == [dt.datetime(2024, 1, 2, 3, 4, 5, 500_000)] * 2
    empty = spark.createDataFrame([(None,)] * 3, "x double")
    assert column(clean(empty, "x", "impute_mode"), "x") == [None] * 3


def test_drops(numeric):
    assert clean(numeric, "age", "drop_rows").count() == 5
    assert clean(numeric, "salary", "drop_column").columns == ["age", "name"]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-1-5",), ("not-a-date",), (None,)], "d string")
    out = clean(df, "d", "parse_dates")
    assert out.schema["d"].dataType.simpleString() == "timestamp_ntz"
    assert column(out, "d") == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5), None, None]
    us = spark.createDataFrame([("12/31/2023",), ("01/02/2024",)], "d string")
    assert column(clean(us, "d", "parse_dates"), "d") == [dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 2)]
    named = spark.createDataFrame([("5 January 2024 07:08 PM",)], "d string")
    out = clean(named, "d", "parse_dates", format="%d %B %Y %I:%M %p")
    assert column(out, "d") == [dt.datetime(2024, 1, 5, 19, 8)]


def test_every_candidate_format_parses_its_own_text(spark):
    when = dt.datetime(2024, 3, 25, 14, 5, 6, 123456)
    for fmt in CANDIDATE_FORMATS:
        df = spark.createDataFrame([(when.strftime(fmt),)], "d string")
        assert column(clean(df, "d", "parse_dates", format=fmt), "d") == [
            dt.datetime.strptime(when.strftime(fmt), fmt)
        ], fmt


def test_date_patterns():
    assert spark_pattern("%Y-%m-%d") == "yyyy-M-d"
    assert spark_pattern("%Y%m%d") == "yyyyMMdd"
    assert spark_pattern("%Y-%m-%dT%H") == "yyyy-M-d'T'H"
    assert shape("%d.%m.%Y") == r"^\d{1,2}\.\d{1,2}\.\d{4}$"
    with pytest.raises(UnknownDateFormat):
        spark_pattern("%Y %Q")


def test_parsing_numbers_is_refused_and_dates_pass(numeric, mixed):
    with pytest.raises(IncompatibleColumn):
        clean(numeric, "salary", "parse_dates")
    assert clean(mixed, "date", "parse_dates").collect() == mixed.collect()


def test_cap_by_fences_keeps_missing_cells(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "x double")
    assert column(clean(df, "x", "cap_outliers"), "x") == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_cap_by_percentile(numeric):
    out = column(clean(numeric, "salary", "cap_outliers", cap_percentile=0.99), "salary")
    assert max(out) == pytest.approx(474_200) and min(out) == pytest.approx(50_300)
    with pytest.raises(ValueError):
        clean(numeric, "salary", "cap_outliers", cap_percentile=0.3)
    assert clean(numeric, "name", "cap_outliers").select("name").collect() == numeric.select("name").collect()


def test_unknown_columns_and_actions(numeric):
    with pytest.raises(ColumnNotFound):
        clean(numeric, "nope", "impute_mean")
    with pytest.raises(ValueError):
        Action("age", "magic_fix")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "A "), (None, "a")], "`a.b` double, `x``y` string")
    out = apply_plan(df, [Action("a.b", "impute_mean"), Action("x`y", "standardize_categories")])
    assert sorted(tuple(r) for r in out.df.collect()) == [(1.0, "a"), (1.0, "a")]
    assert out.diff.count() == 2


PLAN = [
    Action("salary", "drop_column"),
    Action("salary", "impute_mean"),
    Action("age", "impute_median"),
    Action("name", "no_action"),
    Action("name", "drop_rows"),
    Action("age", "cap_outliers", params={"cap_percentile": 0.9}),
]


def test_plan_goes_on_after_a_failed_action(numeric):
    result = apply_plan(numeric, PLAN)
    assert [a.seq for a in result.applied] == [1, 3, 5, 6]
    assert [(a.seq, why) for a, why, _ in result.skipped] == [
        (2, "skipped_failed_action"),
        (4, "skipped_no_action"),
    ]
    assert result.df.columns == ["age", "name"]
    assert result.df.count() == 6


def test_plan_records_before_and_after(numeric):
    rows = {r.seq: r for r in apply_plan(numeric, PLAN).diff.collect()}
    assert {s: (r.rows_affected, r.cells_changed) for s, r in rows.items()} == {
        1: (7, 7),
        3: (2, 2),
        5: (1, 1),
        6: (0, 2),
    }
    assert rows[1].after_stat.dropped and rows[1].after_stat.missing_count is None
    assert rows[3].before_stat.missing_count == 2 and rows[3].after_stat.missing_count == 0
    assert rows[3].before_stat.mean == pytest.approx(31.6)
    assert rows[5].before_stat.n_unique == 6 and rows[5].before_stat.mean is None
    log = plan_log(apply_plan(numeric, PLAN), "r1").orderBy("seq").collect()
    assert [r.action for r in log][:3] == ["executed_drop_column", "skipped_failed_action", "executed_impute_median"]
    assert len(log) == len(PLAN) and all(r.ts is not None for r in log)


def test_empty_plan_and_empty_table(spark, numeric):
    assert apply_plan(numeric, []).diff.count() == 0
    empty = numeric.limit(0)
    out = apply_plan(empty, [Action("age", "impute_mean"), Action("salary", "cap_outliers")])
    assert out.df.count() == 0
    assert [(r.rows_affected, r.before_stat.missing_pct) for r in out.diff.collect()] == [(0, None)] * 2


def test_cleaned_table_is_a_narrow_plan(numeric):
    plan = apply_plan(numeric, [a for a in PLAN if a.action_type != "no_action"]).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_partitions_do_not_matter(numeric):
    plan = [Action("age", "impute_median"), Action("name", "impute_mode"), Action("salary", "cap_outliers")]
    one, eight = (
        sorted(apply_plan(numeric.repartition(n), plan).df.collect()) for n in (1, 8)
    )
    assert one == eight


def test_capped_values_lie_inside_the_fences(spark):
    df = spark.range(500).select((F.col("id") * F.col("id") * F.rand(3)).alias("x"))
    from dqspark.operators.profile import column_fences

    _, _, low, high = column_fences(df, ["x"])["x"]
    out = clean(df, "x", "cap_outliers").agg(F.min("x"), F.max("x")).first()
    assert out[0] >= low and out[1] <= high

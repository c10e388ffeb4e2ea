import pytest

from dqspark.operators.frequency import distinct_counts, frequency_table, top_values
from dqspark.operators.profile import (
    column_stats,
    compare_profiles,
    date_rates,
    issue_count,
    profile,
)
from dqspark.types import normalise_missing


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_full_profile(numeric):
    p = by_column(profile(numeric))
    age, salary, name = p["age"], p["salary"], p["name"]
    assert (age.position, salary.position, name.position) == (0, 1, 2)
    assert age.missing_pct == 0.2857 and age.n_unique == 5 and age.n_rows == 7
    assert age["mean"] == 31.6 and age.std == 5.9414 and (age.min, age.max) == (25.0, 40.0)
    assert (age.q1, age.q3, age.iqr_outlier_count) == (28.0, 35.0, 0)
    assert salary.iqr_outlier_count == 1 and salary.n_unique == 7 and salary.dtype == "bigint"
    assert name.missing_pct == 0.1429 and name.top_values == {n: 1 for n in ("ann", "ben", "cid", "eve", "fay", "gus")}
    assert name["mean"] is None and name.near_duplicate_pairs == 0 and age.top_values is None


def test_date_like_text(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-03",), ("soon",), (None,)], "d string")
    row = profile(df).first()
    assert (row.date_parse_success_rate, row.date_format, row.looks_like_date) == (0.6667, "%Y-%m-%d", True)
    half = spark.createDataFrame([("2024-01-01",), ("soon",)], "d string")
    assert profile(half).first().looks_like_date is None
    assert date_rates(frequency_table(half, ["d"])).first().rate == 0.5


def test_near_duplicates_are_counted(spark):
    df = spark.createDataFrame([("active",), ("actve",), ("idle",)], "s string")
    assert profile(df).first().near_duplicate_pairs == 1
    assert profile(df, near_duplicate_columns=[]).first().near_duplicate_pairs is None


def test_issue_count(numeric):
    row = issue_count(profile(numeric)).first()
    assert (row.columns_audited, row.columns_with_issues) == (3, 3)


def test_empty_table(numeric):
    p = by_column(profile(numeric.limit(0)))
    assert set(p) == {"age", "salary", "name"}
    assert all(r.n_rows == 0 and r.missing_pct is None and r.n_unique == 0 for r in p.values())
    assert p["age"]["mean"] is None and p["age"].iqr_outlier_count == 0


def test_one_row_has_no_deviation(numeric):
    row = by_column(profile(numeric.limit(1)))["age"]
    assert row.std is None and row["mean"] == 25.0 and row.q1 == row.q3 == 25.0


def test_booleans_dates_and_nested(spark):
    df = spark.sql(
        "SELECT true AS b, timestamp_ntz'2024-01-01 00:00:00' AS t, array(1) AS a, 1.50BD AS d "
        "UNION ALL SELECT NULL, NULL, NULL, 2.25BD"
    )
    p = by_column(profile(df))
    assert (p["b"].n_unique, p["b"]["mean"], p["b"].missing_pct) == (1, None, 0.5)
    assert p["t"].n_unique == 1 and p["a"].n_unique is None and p["a"].missing_pct == 0.5
    assert p["d"]["mean"] == 1.875 and p["d"].n_unique == 2


def test_wide_tables(spark):
    df = spark.range(20).selectExpr(*[f"id + {i} AS c{i}" for i in range(90)])
    p = by_column(profile(df))
    assert len(p) == 90 and p["c89"]["mean"] == 98.5 and p["c89"].n_unique == 20
    # Computed float columns: every one is an expression to the optimiser.
    df = spark.range(20).selectExpr(*[f"(id + {i}) / 2 AS c{i}" for i in range(45)])
    p = by_column(profile(df))
    assert len(p) == 45 and p["c44"]["mean"] == 26.75 and p["c44"].n_unique == 20
    assert (p["c44"].q1, p["c44"].q3) == (24.375, 29.125)


def test_long_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "x bigint")
    assert distinct_counts(df, ["x"]).first().n_unique == 2


def test_top_values_break_ties_by_label(spark):
    rows = [(x,) for x in "aabbcdefghijkl"]
    got = top_values(frequency_table(spark.createDataFrame(rows, "s string"), ["s"])).orderBy("place").collect()
    assert [(r.value, r.n) for r in got[:3]] == [("a", 2), ("b", 2), ("c", 1)] and len(got) == 10


def test_column_stats(numeric):
    s = by_column(column_stats(normalise_missing(numeric), ["age", "name", "gone"]))
    assert (s["age"].missing_count, s["age"]["mean"], s["age"].dropped) == (2, 31.6, False)
    assert s["name"].missing_count == 1 and s["name"].std is None
    assert s["gone"].dropped and s["gone"].dtype is None


def test_compare_profiles(numeric):
    before, after = profile(numeric), profile(numeric.na.drop().drop("salary"))
    rows = by_column(compare_profiles(before, after))
    assert rows["age"].missing_pp_gained == 28.6 and rows["salary"].dtype_after is None
    assert rows["salary"].missing_pp_gained is None


@pytest.mark.parametrize("n", [1, 8])
def test_partitions_do_not_matter(numeric, n):
    assert sorted(profile(numeric.repartition(n)).collect()) == sorted(profile(numeric).collect())

"""Rules that real tables break: clock changes, NaN, quotes, encodings, plans of many data sets."""

import pytest
from pyspark.sql import functions as F

from dqspark.functions.dates import parse_date
from dqspark.operators.charts import box, chart_data
from dqspark.operators.clean import clean
from dqspark.operators.frequency import distinct_counts
from dqspark.operators.tables import conformance, keep_best, required
from dqspark.operators.charts import histogram
from dqspark.operators.verify import check_chart
from dqspark.plans.actions import PLAN_DDL, Action, Intent, approved, read_plan, vet_intents
from dqspark.plans.executor import apply_plan
from dqspark.sources.files import probe_files, read_delimited

NEW_YORK = "America/New_York"


@pytest.fixture
def new_york(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", NEW_YORK)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize(
    "fmt,text,want",
    [
        ("%Y-%m-%d %H:%M:%S", "2024-03-10 02:30:00", "2024-03-10 02:30:00"),
        ("%y-%m-%d", "70-01-05", "1970-01-05 00:00:00"),
        ("%y-%m-%d", "68-01-05", "2068-01-05 00:00:00"),
        ("%Y-%m-%dT%H:%M:%S%z", "2024-03-10T02:30:00Z", "2024-03-10 02:30:00"),
        ("%Y-%m-%dT%H:%M:%S%z", "2024-03-10T02:30:00+0530", "2024-03-09 21:00:00"),
        ("%m/%d/%Y %I:%M %p", "03/10/2024 02:30 PM", "2024-03-10 14:30:00"),
        ("%A, %B %d, %Y", "Sunday, March 10, 2024", "2024-03-10 00:00:00"),
        ("%Y-%m-%d", "2024-02-30", None),
    ],
)
def test_dates_in_a_zone_with_clock_changes(new_york, fmt, text, want):
    df = new_york.createDataFrame([(text,)], "d string")
    assert df.select(parse_date(F.col("d"), fmt).cast("string")).first()[0] == want


def test_instants_of_a_repeated_hour(new_york):
    df = new_york.createDataFrame([(1730611800,), (1730615400,), (1730615400,), (None,)], "s bigint")
    df = df.select(F.timestamp_seconds("s").alias("ts"))
    assert distinct_counts(df, ["ts"]).first().n_unique == 2
    filled = clean(df, "ts", "impute_mode").select(F.unix_seconds("ts").alias("s"))
    assert sorted(r.s for r in filled.collect()) == [1730611800, 1730615400, 1730615400, 1730615400]


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 1), (1, 4.0, 2), (2, nan, 3)], "k int, score double, seq int")
    assert [(r.k, r.score) for r in keep_best(df, ["k"], "score", "seq").collect()] == [(1, 4.0)]
    marked = conformance(df, [required("score", "none")]).orderBy("seq").collect()
    assert [r.reasons for r in marked] == [["none"], [], ["none"]]


def test_plans_of_many_data_sets(spark):
    rows = [("a", 3, "x", "drop_rows", "", None), ("b", 3, "y", "drop_rows", "", None)]
    plan = spark.createDataFrame(rows, "dataset_id string, " + PLAN_DDL)
    rejected = spark.createDataFrame([("a", 3)], "dataset_id string, seq int")
    left = approved(plan, rejected)
    assert read_plan(left, "a") == [] and [a.column for a in read_plan(left, "b")] == ["y"]
    with pytest.raises(ValueError):
        read_plan(plan)


def test_an_action_with_a_wrong_parameter_is_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    actions = [Action("x", "cap_outliers", "", {"cap_percentile": "0.9"}), Action("x", "impute_mean")]
    result = apply_plan(df, actions)
    assert [s[1] for s in result.skipped] == ["skipped_failed_action"]
    assert [r.x for r in result.df.collect()] == [1.0, 1.0]


def test_a_column_listed_twice(spark):
    known = spark.createDataFrame([("a", "x", "numeric"), ("a", "x", "text")], "dataset_id string, column string, class string")
    rows = [("a", 1, "histogram", ["x"], "why", 1.0, "c")]
    ddl = "dataset_id string, seq int, chart_type string, columns array<string>, rationale string, priority_score double, category string"
    assert vet_intents(spark.createDataFrame(rows, ddl), known).count() == 1


FAULTY = {
    Intent("scatter", ("age", "salary")): ("x", "y"),
    Intent("line", ("date", "salary")): ("y",),
    Intent("box", ("salary", "department")): ("q1", "median", "q3", "n", "min", "max", "whisker_low", "whisker_high", "n_outliers"),
    Intent("box", ("salary",)): ("q1", "whisker_high"),
    Intent("pie", ("status", "salary")): ("total", "share"),
    Intent("pie", ("status",)): ("n", "share"),
    Intent("histogram", ("salary",)): ("bin_start", "bin_end", "n"),
}


@pytest.mark.parametrize("intent", FAULTY, ids=lambda i: "-".join((i.chart_type, *i.columns)))
def test_a_fault_in_any_shown_column_is_flagged(mixed, intent):
    shown = chart_data(mixed, intent).cache()
    assert check_chart(mixed, "c", intent, shown).first().status == "verified"
    for c in FAULTY[intent]:
        wrong = shown.withColumn(c, F.col(c) * 2 + 1)
        assert check_chart(mixed, "c", intent, wrong).first().status == "flagged", c


def test_a_scatter_may_miss_one_point(mixed):
    intent = Intent("scatter", ("age", "salary"))
    shown = chart_data(mixed, intent)
    assert check_chart(mixed, "c", intent, shown.limit(6)).first().status == "verified"
    assert check_chart(mixed, "c", intent, shown.limit(5)).first().status == "flagged"


def test_large_groups_of_a_box_are_combined_first(spark, monkeypatch):
    import dqspark.operators.quantiles as Q

    monkeypatch.setattr(Q, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(f"g{i % 5}", float(i)) for i in range(200)], "g string, x double")
        out = box(df, "x", "g")
        plan = out._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" in top and "partial_count" in top
        assert out.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\n1,"say ""hi"", you",x\n2,"two\nlines",y\n')
    rows = read_delimited(spark, str(tmp_path), delimiter=",", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", you', "x"), (2, "two\nlines", "y")]


def test_files_of_one_folder_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,t\n1,café\n2,thé\n".encode())
    (tmp_path / "b.csv").write_bytes("id;t\n3;café\n4;x\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    found = {r.file[-5:]: (r.delimiter, r.encoding) for r in probe_files(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (",", "utf-8"), "b.csv": (";", "iso-8859-1"), "c.csv": (",", "utf-8")}
    rows = read_delimited(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "café"), (2, "thé"), (3, "café"), (4, "x")]


def test_lines_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,2\nx,3\n")
    df = read_delimited(spark, str(tmp_path), schema="id int, n int", corrupt_column="_corrupt_record").cache()
    assert sorted((r.id is None, r._corrupt_record) for r in df.collect()) == [(False, None), (True, "x,3")]


def test_modes_of_all_kinds_are_filled_together(spark):
    import decimal

    rows = [(1, "b", 2.5, decimal.Decimal("10.0"), True), (1, "a", 2.5, decimal.Decimal("9.0"), True), (None,) * 5, (2, "a", 1.0, None, False)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n decimal(5,1), t boolean")
    out = apply_plan(df, [Action(c, "impute_mode") for c in df.columns]).df
    assert (1, "a", 2.5, decimal.Decimal("9.0"), True) in [tuple(r) for r in out.collect()]
    assert [dict(f.jsonValue())["type"] for f in out.schema] == [dict(f.jsonValue())["type"] for f in df.schema]


def test_trail_of_profiles_and_checks(spark, mixed):
    from dqspark.operators.profile import profile
    from dqspark.sources.audit import check_log, profile_log

    logged = profile_log(profile(mixed, ["age", "salary"]), "r").orderBy("seq").collect()
    assert [(r.seq, r.action) for r in logged] == [(0, "profiled_column"), (1, "profiled_column")]
    checks = check_chart(mixed, "c", Intent("bar", ("status",)))
    assert [(r.seq, r.action, r.run_id) for r in check_log(checks, "r").collect()] == [(1, "check_verified", "r")]


def test_histogram_counts_between_any_edges(spark):
    import math
    import random

    from dqspark.operators.verify import _counts_at, recheck

    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 9), float(rng.randint(-5, 5)), math.inf, -math.inf, -0.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    for edges in ([], [0.0], [3.0, -2.0, 3.0, math.nan, -math.inf, math.inf, 0.5, *(rng.gauss(0, 9) for _ in range(90))]):
        below, upto = _counts_at(df, edges)
        for e in edges:
            assert (below(e), upto(e)) == ((2000, 2000) if e != e else (sum(v < e for v in values), sum(v <= e for v in values)))

    df = spark.range(5000).selectExpr("cast(id % 977 AS double) / 7 AS x")
    jobs = []
    for bins in (20, 300):  # the data are read as often for many bins as for few
        shown = spark.createDataFrame(histogram(df, "x", bins).collect(), "bin int, bin_start double, bin_end double, n bigint")
        assert recheck(df, Intent("histogram", ("x",)), shown).count() == 0
        spark.sparkContext.setJobGroup(f"bins-{bins}", "")
        wrong = recheck(df, Intent("histogram", ("x",)), shown.withColumn("n", F.expr("if(bin = 7, n + 1, n)")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bins-{bins}")))
        right = shown.where("bin = 7").first().n
        assert {(r.item, r.measure, r.shown, r.recomputed) for r in wrong.collect()} >= {("7", "n", right + 1.0, float(right))}
    assert jobs[0] == jobs[1]

"""One-scan correlations, quantiles of many groups, frequent labels by summaries, merged states, stored upserts."""

import collections
import random

import numpy as np
import pandas as pd
import pytest

import dqspark.operators.quantiles as Q
from dqspark.functions.dates import CANDIDATE_FORMATS, ZONED_FORMATS, shape, sketches
from dqspark.operators.charts import chart_data, heatmap, scatter
from dqspark.operators.frequency import frequency_table, top_values
from dqspark.operators.frequent import frequent_values, summaries
from dqspark.operators.gram import pair_moments
from dqspark.operators.profile import date_rates
from dqspark.operators.state import described, merge_states, profile_state
from dqspark.operators.tables import upsert_stored
from dqspark.operators.verify import check_chart, recheck
from dqspark.plans.actions import Intent


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24)) * 10.0 ** rng.integers(-3, 6, 24) + 10.0 ** rng.integers(0, 7, 24)
    x[:, 5] += x[:, 4] * 3
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 7], x[:, 8] = 0.1, np.nan  # constant, and empty
    x[1:, 9] = np.nan  # a single value
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(24)])
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_correlations_equal_pandas(wide):
    pdf, df = wide
    want = pdf.corr()
    found = {(r.column_a, r.column_b): r["corr"] for r in heatmap(df, list(pdf.columns)).collect()}
    assert len(found) == 24 * 24
    for (a, b), got in found.items():
        if "c7" in (a, b) or np.isnan(want.loc[a, b]):
            assert got is None, (a, b)
        else:
            assert got == pytest.approx(want.loc[a, b], abs=1e-7)


def test_correlations_read_the_table_once(wide):
    pdf, df = wide
    plan = pair_moments(df, list(pdf.columns))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_correlations_are_verified_by_the_other_route(wide):
    pdf, df = wide
    columns = ["c0", "c4", "c5", "c7", "c9", "c11"]
    intent = Intent("heatmap", tuple(columns))
    shown = chart_data(df, intent)
    assert recheck(df, intent, shown).count() == 0
    wrong = shown.selectExpr("column_a", "column_b", "if(column_a = 'c0' AND column_b = 'c4', corr + 0.1, corr) AS corr")
    assert [r.item for r in recheck(df, intent, wrong).collect()] == ["c0|c4"]


def test_correlations_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert sorted(tuple(r) for r in heatmap(empty, ["a", "b"]).collect()) == [(a, b, None) for a in "ab" for b in "ab"]


@pytest.mark.parametrize("tasks", ["8", "3"])
def test_many_groups_equal_numpy(spark, monkeypatch, tasks):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    rng = random.Random(4)
    # small groups, a group that holds a third of all rows, one of a single value, groups without name
    rows = [(rng.choice([None, *range(300)]), f"k{rng.randrange(2)}", rng.choice([rng.gauss(0, 5), 1.0, None, float("nan")])) for _ in range(6000)]
    rows += [(1000, "hot", rng.choice([2.5, rng.random()])) for _ in range(3000)] + [(2000, None, 7.0)] * 1500
    df = spark.createDataFrame(rows, "g int, h string, x double").repartition(5)
    groups = collections.defaultdict(list)
    for g, h, x in rows:
        if x is not None and x == x:
            groups[g, h].append(x)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = Q.grouped_quantiles(df, ["g", "h"], "x", probs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(groups)
    for r in got:
        np.testing.assert_allclose(r.q, np.quantile(groups[r.g, r.h], probs), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("room", [1000, 30, 12])
def test_frequent_labels_equal_a_full_count(spark, room):
    rng = random.Random(9)
    rows = [(f"v{int(rng.paretovariate(0.8))}", f"free text {i}", rng.choice(["a", "b", None]), None) for i in range(4000)]
    df = spark.createDataFrame(rows, "zipf string, free string, few string, none string").repartition(6)
    columns = ["zipf", "free", "few", "none"]
    want = top_values(frequency_table(df, columns), 10)
    got = frequent_values(df, columns, 10, room)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_summaries_bound_the_counts(spark):
    rng = random.Random(10)
    values = [f"v{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    true = collections.Counter(values)
    found = summaries(spark.createDataFrame([(v,) for v in values], "s string").repartition(4), ["s"], 20).collect()
    low, lost = collections.Counter(), sum(r.lost for r in found)
    for r in found:
        if r.value is not None:
            low[r.value] += r.low
    assert all(low[v] <= n <= low[v] + lost for v, n in true.items())
    assert max(collections.Counter(r.value is None for r in found).values()) <= 4 * 20


def test_sketches_hold_what_the_formats_match(spark):
    """Every text that a format's shape lets pass has one of its outlines."""
    import re

    rng = random.Random(2)
    texts = ["2024-01-05", "5/1/2024", "05/01/2024 1:02:03 PM", "Jan 5, 2024", "Friday, January 5, 2024", "2024-01-05T10:11:12.123456+02:00", "2024-01-05 10:11:12Z"]
    texts += ["".join(rng.choice("0123-/: ,aTZ+.") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    outline = lambda t: re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", t))
    for f in (*CANDIDATE_FORMATS, *ZONED_FORMATS):
        known, pattern = sketches(f), re.compile(shape(f))
        assert all(outline(t) in known for t in texts if pattern.fullmatch(t)), f
    rows = [(t,) for t in ("2024-01-05", "2024-02-30", "some text", "2023-12-31")]
    best = date_rates(frequency_table(spark.createDataFrame(rows, "d string"), ["d"])).first()
    assert (best.date_format, best.rate) == ("%Y-%m-%d", 0.5)
    none = date_rates(frequency_table(spark.createDataFrame([("x",)], "d string"), ["d"])).first()
    assert (none.date_format, none.rate) == ("%Y-%m-%d", 0.0)


def test_a_sample_of_points_is_the_same_on_any_partitioning(spark):
    rows = [(i, float(i % 7), None if i % 10 == 0 else float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    one, two = (scatter(df.repartition(n), "x", "y", max_points=50, key=["id"], seed=3).collect() for n in (1, 9))
    assert one == two and len(one) == 50 and {r.n_points for r in one} == {450}
    other = scatter(df, "x", "y", max_points=50, key=["id"], seed=4).collect()
    assert sorted(other) != sorted(one)
    assert scatter(df, "x", "y", max_points=1000, key=["id"]).count() == 450
    with pytest.raises(ValueError):
        scatter(df, "x", "y", max_points=5)


def test_lines_of_means_are_verified(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (3, 5.0), (None, 1.0)], "x int, y double")
    intent = Intent("line", ("x", "y"), mean=True)
    assert check_chart(df, "m", intent).first()["status"] == "verified"
    wrong = chart_data(df, intent).selectExpr("x", "if(x = 3, 6.0D, y) AS y")
    assert [tuple(r) for r in recheck(df, intent, wrong).collect()] == [("3", "y", 6.0, 5.0)]
    points = Intent("line", ("x", "y"))
    assert check_chart(df, "p", points).first()["status"] == "verified"
    assert check_chart(df, "p", points, chart_data(df, intent)).first()["status"] == "flagged"


def test_merged_states_are_those_of_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), f"t{i % 97}", None if i % 5 else i) for i, v in enumerate(rng.normal(1e6, 2, 4000))]
    df = spark.createDataFrame(rows, "x double, s string, n bigint")
    parts = [profile_state(df.where(f"pmod(hash(s), 3) = {k}")) for k in range(3)] + [profile_state(df.limit(0))]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    got = {r["column"]: r for r in described(merge_states(states), [0.5]).collect()}
    x = np.array([r[0] for r in rows])
    assert got["x"].n_rows == got["x"].n_valid == 4000 and got["n"].n_valid == 800
    assert got["x"]["mean"] == pytest.approx(x.mean(), rel=1e-12) and got["x"]["std"] == pytest.approx(x.std(ddof=1), rel=1e-9)
    assert got["x"]["min"] == x.min() and got["x"]["max"] == x.max()
    assert abs((x <= got["x"].q[0]).mean() - 0.5) < 0.02
    assert got["s"]["mean"] is None and abs(got["s"].n_unique - 97) <= 3


def test_an_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, k * 1.0, k, "abc"[k % 3]) for k in range(30)]
    spark.createDataFrame(rows, "k int, v double, seq int, part string").write.partitionBy("part").parquet(path)
    names = lambda: {r[0] for r in spark.read.parquet(path).selectExpr("_metadata.file_path").distinct().collect()}
    before = names()
    new = spark.createDataFrame([(3, -1.0, 100, "a"), (3, -2.0, 101, "a"), (99, 9.0, 102, "d")], "k int, v double, seq int, part string")
    assert upsert_stored(spark, path, new, ["k"], "seq", "part") == 2
    want = {k: (v, s, p) for k, v, s, p in rows} | {3: (-2.0, 101, "a"), 99: (9.0, 102, "d")}
    assert {r.k: (r.v, r.seq, r.part) for r in spark.read.parquet(path).collect()} == want
    kept = {f for f in before if "part=a" not in f}
    assert kept <= names() and not (before - kept) & names()

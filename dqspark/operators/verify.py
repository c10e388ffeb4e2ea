"""Check shown numbers by computing them again along another route."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.operators.charts import chart_data
from dqspark.operators.gram import all_pairs, pair_sums
from dqspark.plans.actions import Intent, chart_problem
from dqspark.types import NUMERIC, classes, normalise_missing, quoted, ref

TOLERANCE = 1e-9
POINT_TOLERANCE = 1  # fixed value: a scatter may miss or add one point
BOX_MEASURES = ["n", "min", "max", "whisker_low", "whisker_high", "n_outliers"]
CHECK_DDL = "chart_id string, chart_type string, columns array<string>, category string, status string, notes string"


def _same(shown: Column, again: Column, tolerance: float) -> Column:
    scale = F.greatest(F.abs(shown), F.abs(again), F.lit(1.0))
    near = F.abs(shown - again) <= tolerance * scale
    return F.coalesce(near, shown.isNull() & again.isNull())


def mismatches(
    shown: DataFrame,
    again: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(keys..., measure, shown, recomputed)`` where two tables of the same numbers differ.

    A key that only one side has differs in every measure. Keys may be NULL.
    """
    s = shown.select(
        *[ref(k).alias(f"s_{k}") for k in keys],
        *[ref(m).cast("double").alias(f"s_{m}") for m in measures],
        F.lit(True).alias("in_shown"),
    )
    a = again.select(
        *[ref(k).alias(f"a_{k}") for k in keys],
        *[ref(m).cast("double").alias(f"a_{m}") for m in measures],
        F.lit(True).alias("in_again"),
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s_{k}").eqNullSafe(F.col(f"a_{k}"))
    joined = s.join(a, on, "full_outer")
    one_sided = F.col("in_shown").isNull() | F.col("in_again").isNull()
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"s_{m}").alias("shown"),
                F.col(f"a_{m}").alias("recomputed"),
                (one_sided | ~_same(F.col(f"s_{m}"), F.col(f"a_{m}"), tolerance)).alias("differs"),
            )
            for m in measures
        ]
    )
    return (
        joined.select(*[F.coalesce(f"s_{k}", f"a_{k}").alias(k) for k in keys], F.inline(cells))
        .where("differs")
        .drop("differs")
    )


def _weighted(df: DataFrame, category: str, value: str | None) -> DataFrame:
    """Per-label sums over a table pre-counted by ``(label, value)``: not the plain aggregate."""
    data = df.where(ref(category).isNotNull()).select(
        ref(category).alias("label"),
        (ref(value).cast("double") if value else F.lit(None).cast("double")).alias("v"),
    )
    counted = data.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("n_valid"),
        F.sum(F.col("v") * F.col("n")).alias("total"),
    )


def _histogram_again(df: DataFrame, column: str, shown: DataFrame) -> DataFrame:
    """Edges from the range of the values, and counts of the values between the *shown* edges.

    A value on an edge, but for rounding, may stand in either bin: a shown count is taken over if it
    lies between the counts without and with such values.
    """
    x = f"cast({quoted(column)} AS double)"
    bins = shown.select("bin", "bin_start", "bin_end", "n").orderBy("bin").collect()  # one row per bin
    lo, hi = df.selectExpr(f"min({x})", f"max({x})").first()
    ddl = "bin int, bin_start double, bin_end double, n bigint"
    if lo is None:
        return df.sparkSession.createDataFrame([], ddl)
    width, slack = (hi - lo) / max(1, len(bins)), 1e-9 * max(abs(lo), abs(hi), hi - lo)
    spans = [(float(r.bin_start), float(r.bin_end)) for r in bins if r.bin_start is not None and r.bin_end is not None]
    below, upto = _counts_at(df.selectExpr(f"{x} AS x"), [e for s, t in spans for e in (s, s + slack, s - slack, t, t - slack, t + slack)])
    out = []
    for r in bins:
        exact, least, most = 0, 0, 0
        if r.bin_start is not None and r.bin_end is not None:
            s, e = float(r.bin_start), float(r.bin_end)
            exact = max(0, (upto if r.bin == len(bins) else below)(e) - below(s))
            least = max(0, below(e - slack) - upto(s + slack))
            most = max(0, upto(e + slack) - below(s - slack))
        n = r.n if r.n is not None and least <= r.n <= most else exact
        k = r.bin - 1
        out.append((r.bin, lo + k * width, hi if k + 1 == len(bins) else lo + (k + 1) * width, n))
    return df.sparkSession.createDataFrame(out, ddl)


def _counts_at(values: DataFrame, edges: Sequence[float]) -> tuple[Callable[[float], int], Callable[[float], int]]:
    """How many values ``x`` lie below any of the edges, and how many up to it, from one scan.

    A value is placed among the sorted edges by halving, a projection a step, and values are counted by place. NaN is above all.
    """
    edges = sorted({float(e) for e in edges if e == e})
    places = values.where(F.col("x").isNotNull()).select("x", F.lit(0).alias("i"))  # i: edges known to be below x
    ranked = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    for step in (1 << b for b in reversed(range(len(edges).bit_length()))):
        under = F.coalesce(F.get(ranked, F.col("i") + (step - 1)) < F.col("x"), F.lit(False))
        places = places.select("x", F.when(under, F.col("i") + step).otherwise(F.col("i")).alias("i"))
    on = F.coalesce(F.get(ranked, F.col("i")) == F.col("x"), F.lit(False))
    counted = places.groupBy("i", on.alias("on")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows an edge at most
    under, at = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for r in counted:
        (at if r.on else under)[r.i] += r.n
    upto = list(accumulate(u + a for u, a in zip(under, at)))
    place = {e: i for i, e in enumerate(edges)}

    def up_to(e: float) -> int:
        return upto[place[e]] if e == e else upto[-1]

    def below(e: float) -> int:
        return up_to(e) - at[place[e]] if e == e else upto[-1]

    return below, up_to


def _box_again(df: DataFrame, column: str, by: str | None, shown: DataFrame) -> DataFrame:
    """Counts, extremes and whiskers between the shown quartiles' fences, and ranks of the quartiles.

    Rows are only counted, in one aggregate combined before its shuffle; the join is null-safe, so
    that the aggregate does not take over its partitioning and a large group is split.
    """
    x = ref(column).cast("double").alias("x")
    quartiles = ("q1", "median", "q3")
    if by is None:
        row = shown.select(*quartiles).first()  # a chart without groups is one row
        values = [row[q] if row else None for q in quartiles]
        joined = df.select(
            F.lit("all").alias("group"), x, *[F.lit(v).cast("double").alias(q) for v, q in zip(values, quartiles)]
        ).where(F.col("x").isNotNull())
    else:
        data = df.select(ref(by).alias("group"), x).where(F.col("x").isNotNull() & F.col("group").isNotNull())
        q = shown.select(F.col("group").alias("of"), *quartiles)
        joined = data.join(q, F.col("group").eqNullSafe(F.col("of"))).drop("of")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("x")
    inside = v.between(low, high)
    out = joined.groupBy("group", *quartiles).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("n_outliers"),
        *[F.count_if(v < F.col(name)).alias(f"under_{name}") for name in quartiles],
        *[F.count_if(v <= F.col(name)).alias(f"upto_{name}") for name in quartiles],
    )
    # The p-quantile has at most (n-1)p values strictly below it plus the one it interpolates from,
    # and at least floor((n-1)p) + 1 values up to it.
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        position = (F.col("n") - 1) * p
        fits = (F.col(f"under_{name}") <= F.ceil(position)) & (
            F.col(f"upto_{name}") >= F.floor(position) + 1
        )
        out = out.withColumn(f"{name}_again", F.when(fits, F.col(name)))
    return out.select("group", *[F.col(f"{m}_again").alias(m) for m in quartiles], *BOX_MEASURES)


def _points_again(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """``(item, measure, shown, recomputed)`` for every point that the data hold a different number of times.

    Shown points and rows are counted together, one row per distinct point and side; counts
    are combined before the shuffle, so a frequent point is no hot key.
    """
    point = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in ("x", "y")])
    sides = shown.select("x", "y", F.lit(1).alias("s")).unionByName(rows.select("x", "y", F.lit(0).alias("s")))
    counted = sides.groupBy("x", "y").agg(
        F.sum("s").cast("double").alias("shown"), F.sum(1 - F.col("s")).cast("double").alias("recomputed")
    )
    return counted.where("shown <> recomputed").select(
        point.alias("item"), F.lit("points").alias("measure"), "shown", "recomputed"
    )


def _means_again(rows: DataFrame, shown: DataFrame, tolerance: float) -> DataFrame:
    """``(item, measure, shown, recomputed)`` where a shown mean is not that of its x, from sums over ``(x, y)`` counted first."""
    counted = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    valid = F.sum(F.when(F.col("y").isNotNull(), F.col("n")))
    again = counted.groupBy("x").agg(F.try_divide(F.sum(F.col("y") * F.col("n")), valid).alias("y"))
    found = mismatches(shown, again, ["x"], ["y"], tolerance)
    item = F.coalesce(F.col("x").cast("string"), F.lit("missing"))
    return found.select(item.alias("item"), "measure", "shown", "recomputed")


def _same_bag(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables of points hold the same ones equally often, by their number and the sums of two hashes of each.

    One row per task and side is shuffled. Hashes are of 64 bits, two of them and independent, so tables that differ by chance look the
    same once in 10^38; tables that agree never look different.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in ("x", "y")]
    prints = [F.xxhash64(*cells), F.xxhash64(F.lit("other"), *reversed(cells))]
    sums = [F.sum(h.cast("decimal(38,0)")) for h in prints]
    told = [tuple(df.select("x", "y").agg(F.count(F.lit(1)), *sums).first()) for df in (one, other)]
    return told[0] == told[1]


def _heatmap_again(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations from plain sums of products about the columns' means: two scans, whatever the number of columns."""
    centre = df.agg(*[F.avg(ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    sums = pair_sums(df, columns, centre)
    # what is left of a sum of squares after cancellation may be rounding only
    side = lambda s, q: F.when(F.expr(f"n * {q} - {s} * {s} > 1e-13D * n * {q}"), F.expr(f"sqrt(n * {q} - {s} * {s})"))
    corr = F.try_divide(F.expr("n * uv - u * v"), side("u", "uu") * side("v", "vv"))
    found = sums.select("i", "j", F.when(F.col("n") > 1, corr).alias("corr"))
    return all_pairs(df, columns).join(found, ["i", "j"], "left").select("column_a", "column_b", "corr")


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables of counts as one row."""
    zero = lambda df: [F.lit(0).cast("bigint").alias(c) for c in df.columns]
    both = left.select("*", *zero(right)).unionByName(right.select("*", *zero(left)))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def scatter_count(df: DataFrame, shown: DataFrame, x: str, y: str) -> DataFrame:
    """One row: points shown, complete rows in the data, and whether they agree."""
    df = normalise_missing(df)
    points = shown.agg(F.count(F.lit(1)).alias("n_shown"))
    complete = df.agg(F.count_if(ref(x).isNotNull() & ref(y).isNotNull()).alias("n_complete"))
    near = F.abs(F.col("n_shown") - F.col("n_complete")) <= POINT_TOLERANCE
    return _side_by_side(points, complete).select("n_shown", "n_complete", near.alias("agrees"))


def _total_bin(total: DataFrame) -> DataFrame:
    """The number of values in all bins together, as a bin 0 without edges."""
    edge = F.lit(None).cast("double")
    return total.select(F.lit(0).alias("bin"), edge.alias("bin_start"), edge.alias("bin_end"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def recheck(df: DataFrame, intent: Intent, shown: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Mismatches between shown chart data and a second computation of it, every shown column.

    Columns ``(item, measure, shown, recomputed)``; no rows means the chart is right. Points of
    lines and scatters are compared as a bag of ``(x, y)``; they are shuffled only where fingerprints
    of the two bags differ. A line of means (``mean`` in the intent) is compared with means.
    """
    df = normalise_missing(df)
    c = list(intent.columns)
    kind = intent.chart_type
    numeric = len(c) > 1 and classes(df).get(c[1]) == NUMERIC
    keys: list[str] = ["label"]
    if kind in ("line", "scatter"):
        rows = df.select(ref(c[0]).alias("x"), ref(c[1]).cast("double").alias("y"))
        if kind == "line" and intent.mean:
            return _means_again(rows, shown, tolerance)
        if kind == "scatter":
            rows = rows.select(F.col("x").cast("double"), "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
        if _same_bag(rows, shown):
            return _points_again(rows.limit(0), shown.limit(0))
        return _points_again(rows, shown)
    if kind in ("bar", "pie"):
        again = _weighted(df, c[0], c[1] if numeric else None)
        if kind == "bar":
            again = again.withColumn("mean", F.try_divide("total", "n_valid"))
            measures = ["mean"] if numeric else ["n"]
        else:
            again = again.withColumn("total", F.coalesce("total", F.lit(0.0)))
            part = "total" if numeric else "n"
            whole = again.agg(F.sum(part)).first()[0]
            again = again.withColumn("share", F.try_divide(F.col(part).cast("double"), F.lit(float(whole or 0))))
            measures = [part, "share"]
    elif kind == "histogram":
        again, keys, measures = _histogram_again(df, c[0], shown), ["bin"], ["bin_start", "bin_end", "n"]
        spread = shown.agg(F.sum("n").alias("n")), df.agg(F.count(ref(c[0])).alias("n"))
        shown = shown.select("bin", *measures).unionByName(_total_bin(spread[0]))
        again = again.unionByName(_total_bin(spread[1]))
    elif kind == "box":
        by = c[1] if len(c) > 1 and "group" in shown.columns else None
        again = _box_again(df, c[0], by, shown)
        shown = shown if by else shown.withColumn("group", F.lit("all"))
        keys, measures = ["group"], ["q1", "median", "q3", *BOX_MEASURES]
    else:
        again, keys, measures = _heatmap_again(df, c), ["column_a", "column_b"], ["corr"]
    found = mismatches(shown, again, keys, measures, tolerance)
    return found.select(
        F.concat_ws("|", *[ref(k).cast("string") for k in keys]).alias("item"),
        "measure",
        "shown",
        "recomputed",
    )


def check_chart(
    df: DataFrame, chart_id: str, intent: Intent, shown: DataFrame | None = None
) -> DataFrame:
    """One check row: ``failed`` if it cannot be made, ``flagged`` if it is wrong, else ``verified``."""
    spark = df.sparkSession
    head = (chart_id, intent.chart_type, list(intent.columns), intent.category)
    problem = chart_problem(intent.chart_type, list(intent.columns), classes(df))
    if problem:
        return spark.createDataFrame([(*head, "failed", problem)], CHECK_DDL)
    data = chart_data(df, intent) if shown is None else shown
    wrong = recheck(df, intent, data)
    # A scatter may miss or add one point; nothing else may differ.
    bad = F.coalesce(F.sum(F.abs(F.col("shown") - F.col("recomputed"))), F.lit(0)) if intent.chart_type == "scatter" else F.count(F.lit(1))
    allowed = POINT_TOLERANCE if intent.chart_type == "scatter" else 0
    found = _side_by_side(
        wrong.agg(bad.cast("bigint").alias("bad")), data.limit(1).agg(F.count(F.lit(1)).alias("some"))
    )
    status = F.when((F.col("bad") > allowed) | (F.col("some") == 0), "flagged").otherwise("verified")
    notes = (
        F.when(F.col("some") == 0, "no chart data")
        .when(F.col("bad") > allowed, F.concat(F.col("bad").cast("string"), F.lit(" value(s) differ on recomputation")))
        .otherwise("recomputed values agree")
    )
    return found.select(
        F.lit(chart_id).alias("chart_id"),
        F.lit(intent.chart_type).alias("chart_type"),
        F.array(*[F.lit(c) for c in intent.columns]).alias("columns"),
        F.lit(intent.category).alias("category"),
        status.alias("status"),
        notes.alias("notes"),
    )

"""Chart data: the table behind each chart, small where the chart is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.operators.gram import FIELDS, all_pairs, pair_moments
from dqspark.operators.profile import fences
from dqspark.operators.quantiles import grouped_quantiles
from dqspark.plans.actions import Intent, chart_problem
from dqspark.types import (
    CATEGORICAL,
    NUMERIC,
    IncompatibleColumn,
    classes,
    normalise_missing,
    ref,
    require,
)

DEFAULT_BINS = 30


def _ready(df: DataFrame, chart: str, columns: list[str]) -> DataFrame:
    problem = chart_problem(chart, columns, classes(df))
    if problem:
        raise IncompatibleColumn(problem)
    return normalise_missing(df)


def histogram(df: DataFrame, column: str, n_bins: int = DEFAULT_BINS) -> DataFrame:
    """``(bin, bin_start, bin_end, n)`` in equal widths, empty bins included, maximum in the last.

    A constant column has one bin. The range is read first, so binning is a plain projection.
    """
    df = _ready(df, "histogram", [column])
    x = ref(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    ddl = "bin int, bin_start double, bin_end double"
    if lo is None:
        return spark.createDataFrame([], ddl + ", n bigint")
    bins = 1 if lo == hi else n_bins
    width = (hi - lo) / bins
    edges = spark.createDataFrame(
        [(i + 1, lo + i * width, hi if i + 1 == bins else lo + (i + 1) * width) for i in range(bins)],
        ddl,
    )
    number = F.least(F.floor(bins * (x - lo) / F.lit(hi - lo)) + 1, F.lit(bins)) if bins > 1 else F.lit(1)
    counted = (
        df.where(x.isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    return edges.join(counted, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n")
    )


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers and outlier counts, overall or per label of ``by``.

    ``by`` is used where it is a text column. Whiskers end at the outermost values inside the
    fences.
    """
    df = _ready(df, "box", [column])
    grouped = by is not None and classes(df).get(by) == CATEGORICAL
    data = df.select(
        *([ref(by).alias("group")] if grouped else []), ref(column).cast("double").alias("x")
    ).where(F.col("x").isNotNull())
    if grouped:
        data = data.where(F.col("group").isNotNull())
        quartiles = grouped_quantiles(data, ["group"], "x", [0.25, 0.5, 0.75]).select(
            "group", *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
        )
        # null-safe, so that the aggregate below does not take over the join's partitioning: rows of a
        # large group are combined in many tasks first
        quartiles = quartiles.withColumnRenamed("group", "of")
        with_q = data.join(quartiles, F.col("group").eqNullSafe(F.col("of"))).drop("of")
        keys = ["group", "q1", "median", "q3"]
    else:
        (q,) = grouped_quantiles(data, [], "x", [0.25, 0.5, 0.75]).collect() or [None]
        values = q["q"] if q else [None] * 3
        with_q = data.select(
            "*", *[F.lit(v).cast("double").alias(n) for n, v in zip(("q1", "median", "q3"), values)]
        )
        keys = ["q1", "median", "q3"]
    lower, upper = fences(F.col("q1"), F.col("q3"))
    x = F.col("x")
    inside = x.between(lower, upper)
    return with_q.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def bar(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Mean of a numeric column per label, or the number of rows per label, most frequent first."""
    df = _ready(df, "bar", [category])
    labelled = df.where(ref(category).isNotNull())
    if value is not None and classes(df).get(value) == NUMERIC:
        return labelled.groupBy(ref(category).alias("label")).agg(
            F.avg(ref(value).cast("double")).alias("mean")
        )
    return (
        labelled.groupBy(ref(category).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def line(df: DataFrame, x: str, y: str, mean: bool = False) -> DataFrame:
    """``(x, y)`` in ascending x, missing x last; with ``mean`` one averaged point per x.

    Rows of equal x are ordered by y, so that a frequent x is spread over sort partitions too.
    """
    df = _ready(df, "line", [x, y])
    points = df.select(ref(x).alias("x"), ref(y).cast("double").alias("y"))
    if mean:
        points = points.groupBy("x").agg(F.avg("y").alias("y"))
    return points.orderBy(F.col("x").asc_nulls_last(), F.col("y").asc_nulls_last())


def scatter(
    df: DataFrame, x: str, y: str, max_points: int | None = None, key: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """All complete ``(x, y)`` points, or a sample of ``max_points`` with ``n_points``, their exact number, beside it.

    The sample are the points whose hashes of seed and ``key`` (columns that tell rows apart) are the smallest: the same on any
    partitioning, and tasks send ``max_points`` rows each at most. Rows of one key are taken together, in the
    order of their points.
    """
    df = _ready(df, "scatter", [x, y])
    points = [ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y")]
    complete = F.col("x").isNotNull() & F.col("y").isNotNull()
    if max_points is None:
        return df.select(*points).where(complete)
    require(df, *key)
    if not key:
        raise ValueError("a sample of points needs the columns of a key")
    cells = [F.coalesce(ref(c).cast("string"), F.lit("missing")) for c in key]
    data = df.select(*points, F.md5(F.concat_ws("|", F.lit(str(seed)), *cells)).alias("order")).where(complete)
    n = data.count()
    return data.orderBy("order", "x", "y").limit(max_points).select("x", "y", F.lit(n).cast("bigint").alias("n_points"))


def heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, corr)``, the full symmetric matrix in long form, from one scan.

    Rows are taken pair by pair where both are present; NULL where a side is constant there or there are too few rows.
    """
    df = _ready(df, "heatmap", list(columns))
    moments = pair_moments(df, columns).select("i", F.posexplode(F.arrays_zip(*FIELDS)).alias("j", "m")).select("i", "j", "m.*")
    # a spread within the rounding of the mean is none
    spread = lambda s, m: F.when(F.col(s) > F.col("n") * F.pow(F.lit(4e-15) * F.abs(m), F.lit(2)), F.sqrt(s))
    corr = F.try_divide(F.col("product"), spread("square", "mean") * spread("other_square", "other_mean"))
    corr = F.when(F.col("i") == F.col("j"), corr * F.lit(0.0) + 1).otherwise(corr)
    found = moments.select("i", "j", F.when(F.col("n") > 1, corr).alias("corr"))
    return all_pairs(df, columns).join(found, ["i", "j"], "left").select("column_a", "column_b", "corr")


def pie(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Sum of a numeric column or number of rows per label, with the share of the total."""
    df = _ready(df, "pie", [category])
    labelled = df.where(ref(category).isNotNull())
    if value is not None and classes(df).get(value) == NUMERIC:
        size = F.coalesce(F.sum(ref(value).cast("double")), F.lit(0.0))
        name = "total"
        total = labelled.agg(size).first()[0]
    else:
        size, name = F.count(F.lit(1)), "n"
        total = labelled.agg(size).first()[0]
    parts = labelled.groupBy(ref(category).alias("label")).agg(size.alias(name))
    return parts.select("label", name, F.try_divide(F.col(name).cast("double"), F.lit(float(total))).alias("share"))


CHARTS = {
    "histogram": lambda df, c: histogram(df, c[0]),
    "box": lambda df, c: box(df, c[0], c[1] if len(c) > 1 else None),
    "bar": lambda df, c: bar(df, c[0], c[1] if len(c) > 1 else None),
    "scatter": lambda df, c: scatter(df, c[0], c[1]),
    "heatmap": lambda df, c: heatmap(df, c),
    "pie": lambda df, c: pie(df, c[0], c[1] if len(c) > 1 else None),
}


def chart_data(df: DataFrame, intent: Intent) -> DataFrame:
    """The data of any chart."""
    problem = chart_problem(intent.chart_type, list(intent.columns), classes(df))
    if problem:
        raise IncompatibleColumn(problem)
    if intent.chart_type == "line":
        return line(df, *intent.columns[:2], mean=intent.mean)
    return CHARTS[intent.chart_type](df, list(intent.columns))

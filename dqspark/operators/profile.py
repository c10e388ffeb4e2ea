"""Column profiles: one row per column, the same for raw and for cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.dates import CANDIDATE_FORMATS, ZONED_FORMATS, parse_date, sketch, sketches
from dqspark.operators.frequency import approximate_distinct_counts, distinct_counts, frequency_table, top_values
from dqspark.operators.quantiles import column_quantiles
from dqspark.operators.similarity import DEFAULT_THRESHOLD, near_duplicates
from dqspark.types import (
    CATEGORICAL,
    NUMERIC,
    OTHER,
    chunks,
    classes,
    double_literal,
    normalise_missing,
    quoted,
    require,
    text_literal,
)

FENCE = 1.5  # fixed value: fences lie this many interquartile ranges outside the quartiles
LOOKS_LIKE_DATE = 0.5  # fixed value: a column is date-like above this share of parsed labels
DIGITS = 4  # fixed value: shares and moments are rounded to this many digits
CHUNK = 40
LABELS = 1_000  # a text column of more different values is free text, unless named as one of labels


def fences(q1: float, q3: float) -> tuple[float, float]:
    spread = q3 - q1
    return q1 - FENCE * spread, q3 + FENCE * spread


def column_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple | None]:
    """``column -> (q1, q3, lower, upper)``, exact; ``None`` for a column without values."""
    quartiles = column_quantiles(df, columns, [0.25, 0.75])
    return {c: q and (*q, *fences(*q)) for c, q in quartiles.items()}


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


def column_moments(
    df: DataFrame, columns: Sequence[str], limits: dict[str, tuple | None] | None = None
) -> DataFrame:
    """Row and value counts, moments and outlier counts, all columns in one scan.

    Values outside ``limits`` are outliers. Aggregates are taken in groups of columns, since very
    wide ones leave whole-stage codegen.
    """
    kinds = classes(df)
    parts = []
    for group in chunks(list(columns), CHUNK):
        aggs, rows = ["count(1) AS n_rows"], []
        for i, c in enumerate(group):
            x, numeric, limit = f"cast({quoted(c)} AS double)", kinds[c] == NUMERIC, (limits or {}).get(c)
            aggs.append(f"count({quoted(c)}) AS valid{i}")
            if numeric:
                aggs += [f"{f}({x}) AS {f}{i}" for f in ("avg", "stddev_samp", "min", "max")]
            if limit:
                low, high = double_literal(limit[2]), double_literal(limit[3])
                aggs.append(f"count_if({x} < {low} OR {x} > {high}) AS out{i}")
            # A numeric column without values has no fences, and no outliers either.
            outliers = f"out{i}" if limit else ("0L" if numeric and limits is not None else "NULL")
            stat = lambda f: f"{f}{i}" if numeric else "cast(NULL AS double)"  # noqa: B023, E731
            rows.append(
                f"named_struct('column', {text_literal(c)}, "
                f"'dtype', {text_literal(df.schema[c].dataType.simpleString())}, "
                f"'n_rows', n_rows, 'n_valid', valid{i}, 'mean', {stat('avg')}, "
                f"'std', {stat('stddev_samp')}, 'min', {stat('min')}, 'max', {stat('max')}, "
                f"'iqr_outlier_count', cast({outliers} AS bigint))"
            )
        one_row = df.agg(*[F.expr(a) for a in aggs])
        parts.append(one_row.selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, parts)


def _missing(rows: Column, valid: Column) -> Column:
    return F.round(F.try_divide(rows - valid, rows), DIGITS)


def date_rates(frequencies: DataFrame, formats: Sequence[str] = (*CANDIDATE_FORMATS, *ZONED_FORMATS)) -> DataFrame:
    """``(column, date_format, rate)``: the best format per column, the earlier one on ties.

    Works on the frequency table, so each distinct text is looked at once. Its outline is looked up among the
    outlines that the formats can have, a few hundred; the text is parsed by the formats of that outline only, and
    free text, whose outline is none of them, by no format.
    """
    spark = frequencies.sparkSession
    outlines = [(s, i) for i, f in enumerate(formats) for s in sorted(sketches(f))]
    dictionary = F.broadcast(spark.createDataFrame(outlines, "outline string, place int"))
    known = frequencies.withColumn("outline", sketch(F.col("value"))).join(dictionary, "outline")
    parsed = None
    for i, f in enumerate(formats):
        is_date = parse_date(F.col("value"), f).isNotNull()
        parsed = F.when(F.col("place") == i, is_date) if parsed is None else parsed.when(F.col("place") == i, is_date)
    hits = known.where(parsed).groupBy("column", "place").agg(F.sum("n").alias("hit"))
    best = hits.groupBy("column").agg(F.max(F.struct("hit", (-F.col("place")).alias("place"))).alias("best"))
    totals = frequencies.groupBy("column").agg(F.sum("n").alias("n"))
    names = F.array(*[F.lit(f) for f in formats])
    return totals.join(best, "column", "left").select(
        "column",
        F.get(names, F.coalesce(-F.col("best.place"), F.lit(0))).alias("date_format"),
        F.try_divide(F.coalesce(F.col("best.hit"), F.lit(0)).cast("double"), F.col("n")).alias("rate"),
    )


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    near_duplicate_columns: Sequence[str] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """The full column profile; fields that do not apply to a column's class are NULL.

    Near-duplicate labels are counted here and listed by ``near_duplicates``: their number is
    unbounded, so they do not belong into one row. They are looked for in ``near_duplicate_columns``, by default in the text
    columns of about ``LABELS`` different labels at most: pairs of free text grow with its square, so such columns must be
    named. NULL pairs tell that a column was not looked at.
    """
    columns = list(columns or df.columns)
    require(df, *columns)
    kinds = classes(df)
    numeric = [c for c in columns if kinds[c] == NUMERIC]
    text = [c for c in columns if kinds[c] == CATEGORICAL]
    countable = [c for c in columns if kinds[c] != OTHER]
    labels = list(near_duplicate_columns or [])
    if near_duplicate_columns is None and text:
        found = approximate_distinct_counts(df, text).collect()  # a row per column
        labels = [r["column"] for r in found if r["n_unique"] <= LABELS]

    limits = column_fences(df, numeric)
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    edges = [
        F.when(F.col("column") == c, F.array(*[_number(x) for x in v])) for c, v in limits.items() if v
    ]
    edge = F.coalesce(*edges) if edges else F.lit(None).cast("array<double>")
    out = column_moments(normalise_missing(df), columns, limits).withColumn("edge", edge)
    if countable:
        out = out.join(distinct_counts(df, countable), "column", "left")
    else:
        out = out.withColumn("n_unique", F.lit(None).cast("bigint"))
    if text:
        frequencies = frequency_table(df, text)
        top = (
            top_values(frequencies)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("top"))
            .select(
                "column",
                F.map_from_entries(
                    F.transform("top", lambda t: F.struct(t["value"], t["n"]))
                ).alias("top_values"),
            )
        )
        out = out.join(top, "column", "left").join(
            date_rates(frequencies).where(F.col("rate") > LOOKS_LIKE_DATE), "column", "left"
        )
    else:
        out = out.select(
            "*",
            F.lit(None).cast("map<string,bigint>").alias("top_values"),
            F.lit(None).cast("string").alias("date_format"),
            F.lit(None).cast("double").alias("rate"),
        )
    if labels:
        near = near_duplicates(df, labels, threshold)
        near = near.groupBy("column").agg(F.count(F.lit(1)).alias("near"))
        out = out.join(near, "column", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("bigint"))
    return out.select(
        place[F.col("column")].alias("position"),
        "column",
        "dtype",
        "n_rows",
        _missing(F.col("n_rows"), F.col("n_valid")).alias("missing_pct"),
        F.when(F.col("column").isin(countable), F.coalesce("n_unique", F.lit(0))).alias("n_unique"),
        F.round("mean", DIGITS).alias("mean"),
        F.round("std", DIGITS).alias("std"),
        "min",
        "max",
        F.get("edge", 0).alias("q1"),
        F.get("edge", 1).alias("q3"),
        F.get("edge", 2).alias("lower_fence"),
        F.get("edge", 3).alias("upper_fence"),
        "iqr_outlier_count",
        "top_values",
        F.when(F.col("column").isin(labels), F.coalesce("near", F.lit(0))).alias("near_duplicate_pairs"),
        F.round("rate", DIGITS).alias("date_parse_success_rate"),
        "date_format",
        F.when(F.col("rate").isNotNull(), F.lit(True)).alias("looks_like_date"),
    )


def issue_count(profiled: DataFrame) -> DataFrame:
    """One row: how many columns were profiled, and how many show any issue."""
    issue = (
        (F.coalesce("missing_pct", F.lit(0.0)) > 0)
        | (F.coalesce("iqr_outlier_count", F.lit(0)) > 0)
        | (F.coalesce("near_duplicate_pairs", F.lit(0)) > 0)
        | F.coalesce("looks_like_date", F.lit(False))
    )
    return profiled.agg(
        F.count(F.lit(1)).alias("columns_audited"), F.count_if(issue).alias("columns_with_issues")
    )


STAT_FIELDS = [
    "dropped",
    "missing_count",
    "missing_pct",
    "n_unique",
    "dtype",
    "mean",
    "std",
    "min",
    "max",
]


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The snapshot kept before and after a cleaning action, one row per asked column.

    A column the table does not have comes back as ``dropped``, with nothing else set. The table
    must be free of NaN (see ``normalise_missing``).
    """
    present = [c for c in columns if c in df.columns]
    gone = [c for c in columns if c not in df.columns]
    spark = df.sparkSession
    parts = []
    if present:
        countable = [c for c in present if classes(df)[c] != OTHER]
        stats = column_moments(df, present)
        if countable:
            stats = stats.join(distinct_counts(df, countable), "column", "left")
        else:
            stats = stats.withColumn("n_unique", F.lit(None).cast("bigint"))
        parts.append(
            stats.select(
                "column",
                "n_rows",
                F.lit(False).alias("dropped"),
                (F.col("n_rows") - F.col("n_valid")).alias("missing_count"),
                _missing(F.col("n_rows"), F.col("n_valid")).alias("missing_pct"),
                F.when(F.col("column").isin(countable), F.coalesce("n_unique", F.lit(0))).alias("n_unique"),
                "dtype",
                F.round("mean", DIGITS).alias("mean"),
                F.round("std", DIGITS).alias("std"),
                "min",
                "max",
            )
        )
    if gone:
        ddl = (
            "column string, n_rows bigint, dropped boolean, missing_count bigint, "
            "missing_pct double, n_unique bigint, dtype string, mean double, std double, "
            "min double, max double"
        )
        parts.append(spark.createDataFrame([(c, None, True) + (None,) * 8 for c in gone], ddl))
    return reduce(DataFrame.unionByName, parts)


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every column of either profile, with the missing share gained back in percentage points."""
    b = before.select("column", *[F.col(c).alias(f"{c}_before") for c in ("dtype", "missing_pct", "n_unique")])
    a = after.select("column", *[F.col(c).alias(f"{c}_after") for c in ("dtype", "missing_pct", "n_unique")])
    gain = F.round((F.col("missing_pct_before") - F.col("missing_pct_after")) * 100, 1)
    return b.join(a, "column", "full_outer").select(
        "column",
        "dtype_before",
        "dtype_after",
        "missing_pct_before",
        "missing_pct_after",
        "n_unique_before",
        "n_unique_after",
        F.when(gain > 0, gain).alias("missing_pp_gained"),
    )

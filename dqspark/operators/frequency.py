"""Frequency tables: the one shuffle from which distinct counts, top labels and modes follow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.types import OTHER, class_of, melt, ref, require

TOP_LABELS = 10  # fixed value: how many frequent labels a profile lists


def frequency_table(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """``(column, value, n)``; missing cells are not counted.

    Counts are combined before the shuffle on ``(column, value)``, so a hot label is one row per
    map task, not a hot partition.
    """
    require(df, *columns)
    return melt(df, columns, as_type).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _exact_type(t: T.DataType) -> str:
    """A type all columns of a kind can be compared in without merging different values."""
    if isinstance(t, T.IntegralType):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, T.TimestampType):
        return "bigint"  # as microseconds: the hour that clocks repeat has one text for two instants
    return "string"


def _comparable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with instants as microseconds, other columns as they are."""
    zoned = {c for c in columns if isinstance(df.schema[c].dataType, T.TimestampType)}
    return df.select(*[F.unix_micros(ref(c)).alias(c) if c in zoned else ref(c) for c in columns])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_unique)``, exact; a column without values has no row."""
    wanted = columns or [f.name for f in df.schema.fields if class_of(f.dataType) != OTHER]
    require(df, *wanted)
    kinds: dict[str, list[str]] = {}
    for c in wanted:
        kinds.setdefault(_exact_type(df.schema[c].dataType), []).append(c)
    parts = [
        frequency_table(_comparable(df, cols), cols, kind).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
        for kind, cols in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def approximate_distinct_counts(df: DataFrame, columns: Sequence[str], rsd: float = 0.01) -> DataFrame:
    """As ``distinct_counts`` from sketches: one scan and no shuffle of values. ``rsd`` is the
    standard deviation of the relative error."""
    require(df, *columns)
    row = df.agg(*[F.approx_count_distinct(ref(c), rsd).alias(c) for c in columns])
    return row.unpivot([], [ref(c) for c in columns], "column", "n_unique")


def top_values(frequencies: DataFrame, k: int = TOP_LABELS) -> DataFrame:
    """``(column, value, n, place)``: the ``k`` most frequent labels, ties by label.

    The rank filter is applied per map task before the shuffle, so a column with many labels
    sends ``k`` rows per task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return frequencies.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def modes_of(df: DataFrame, columns: Sequence[str]) -> dict[str, Column | None]:
    """The mode of every column as a literal of its type, the smallest value on ties; ``None`` for an empty
    column. Columns of a kind share one pass, and instants never go through text.
    """
    kinds: dict[str, list[str]] = {}
    out: dict[str, Column | None] = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.TimestampType)):
            kinds.setdefault(_exact_type(kind), []).append(c)
        else:  # their text has another order than their values
            value = mode_of(df, c)
            out[c] = value if value is None else F.lit(value).cast(kind)
    for kind, cols in kinds.items():
        best = top_values(frequency_table(_comparable(df, cols), cols, kind), 1)
        found = {r["column"]: r["value"] for r in best.select("column", "value").collect()}  # a row per column
        for c in cols:
            value = found.get(c)
            if value is None:
                out[c] = None
            elif isinstance(df.schema[c].dataType, T.TimestampType):
                out[c] = F.timestamp_micros(F.lit(int(value)))
            else:
                out[c] = F.lit(value).cast(df.schema[c].dataType)
    return out


def mode_of(df: DataFrame, column: str) -> str | None:
    """The most frequent value as text, the smallest on ties; ``None`` for an empty column.

    A two-stage count and a distributed top-1, where ``mode()`` would hold every distinct value
    in one task.
    """
    counted = (
        df.where(ref(column).isNotNull())
        .groupBy(ref(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counted.orderBy(F.desc("n"), "value").limit(1).select(F.col("value").cast("string"))
    row = best.first()
    return row and row[0]

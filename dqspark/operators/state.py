"""Profiles that grow with their table: a small state per column, kept and merged, so that only new rows are read.

A state holds counts, moments, a HyperLogLog sketch of the different values and, for numbers, a KLL sketch of their
order. States of parts of a table add up to the state of the whole: counts and extremes exactly, moments by the
update of Chan et al. (1983), sketches within the errors of sketches of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.types import NUMERIC, chunks, classes, normalise_missing, ref, require

#: Columns of one aggregate; the size of the sketches (relative error of distinct counts about 0.8 %, of ranks about 0.7 %).
AT_ONCE, LG_HLL, K_KLL = 20, 14, 400
STATE = "column string, n_rows bigint, n bigint, mean double, m2 double, min double, max double, distinct_sketch binary, order_sketch binary"


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, schema ``STATE``, from one scan. Moments, extremes and the order sketch are of numbers only."""
    columns = list(columns or df.columns)
    require(df, *columns)
    df, kinds = normalise_missing(df), classes(df)
    parts = []
    for group in chunks(columns, AT_ONCE):
        aggs, rows = [F.count(F.lit(1)).alias("n_rows")], []
        for i, c in enumerate(group):
            numeric, x = kinds[c] == NUMERIC, ref(c).cast("double")
            text = ref(c).cast("string")
            aggs += [F.count(ref(c)).alias(f"n{i}"), F.hll_sketch_agg(text, F.lit(LG_HLL)).alias(f"d{i}")]
            if numeric:
                aggs += [F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
                aggs.append(F.kll_sketch_agg_double(x, F.lit(K_KLL)).alias(f"k{i}"))
            stat = lambda f, t="double": F.col(f"{f}{i}") if numeric else F.lit(None).cast(t)  # noqa: B023, E731
            rows.append(
                F.struct(
                    F.lit(c).alias("column"), F.col("n_rows"), F.col(f"n{i}").alias("n"), stat("a").alias("mean"),
                    (stat("v") * F.col(f"n{i}")).alias("m2"), stat("l").alias("min"), stat("h").alias("max"),
                    F.col(f"d{i}").alias("distinct_sketch"), stat("k", "binary").alias("order_sketch"),
                )
            )
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def merge_states(states: DataFrame) -> DataFrame:
    """The states of several parts as one row per column. A part without values adds its rows only."""
    whole = states.groupBy("column").agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("centre"))
    moved = states.join(whole, "column")
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2)))
    return moved.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        spread.alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("order_sketch").alias("order_sketch"),
    )


def described(states: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, n_rows, n_valid, mean, std, min, max, n_unique, q)`` from merged states; ``n_unique`` and the quantiles
    ``q`` are estimates, ``std`` is that of a sample."""
    at = F.array(*[F.lit(float(p)) for p in probs])
    return states.select(
        "column",
        "n_rows",
        F.col("n").alias("n_valid"),
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        "min",
        "max",
        F.hll_sketch_estimate("distinct_sketch").alias("n_unique"),
        F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("order_sketch", at)).alias("q"),
    )


def append_state(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Add the state of new rows to those stored below a path."""
    profile_state(df, columns).write.mode("append").parquet(path)


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """All states stored below a path, merged."""
    return merge_states(spark.read.schema(STATE).parquet(path))

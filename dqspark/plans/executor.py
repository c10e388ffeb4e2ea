"""Run a cleaning plan: one table out, a before/after record per action, and a log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.operators.clean import Fitted, apply_fitted, changed, check, fit
from dqspark.operators.profile import STAT_FIELDS, column_stats
from dqspark.plans.actions import Action, numbered
from dqspark.types import classes, normalise_missing

DIFF_DDL = (
    "seq int, column string, action_type string, rationale string, rows_affected bigint, "
    "cells_changed bigint, before_stat struct<{0}>, after_stat struct<{0}>"
).format(
    "dropped:boolean,missing_count:bigint,missing_pct:double,n_unique:bigint,dtype:string,"
    "mean:double,std:double,min:double,max:double"
)


@dataclass
class PlanResult:
    """The cleaned table, lazily computed records of what was done, and what was left out."""

    df: DataFrame
    diff: DataFrame
    applied: list[Action]
    skipped: list[tuple[Action, str, str]] = field(default_factory=list)


def _cells_changed(before: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """``(seq, cells_changed)`` for actions that change cells, in one scan.

    For parsed dates, whose type changes, this counts the cells lost.
    """
    both = changed(before, fitted, keep_old=True)
    counts, rows = [], []
    for f in fitted:
        seq, new = f.action.seq, F.col("`" + f.action.column.replace("`", "``") + "`")
        old = F.col(f"old_{seq}")
        if f.action.action_type == "parse_dates":
            differs = old.isNotNull() & new.isNull()
        else:
            differs = ~old.eqNullSafe(new)
        counts.append(F.count_if(differs).alias(f"n{seq}"))
        rows.append(F.struct(F.lit(seq).alias("seq"), F.col(f"n{seq}").alias("cells_changed")))
    return both.agg(*counts).select(F.inline(F.array(*rows)))


def _group_diff(before: DataFrame, after: DataFrame, group: Sequence[Fitted]) -> DataFrame:
    """Diff records for actions on different columns: one statistics pass before, one after."""
    spark = before.sparkSession
    names = [f.action.column for f in group]
    head = spark.createDataFrame(
        [(f.action.seq, f.action.column, f.action.action_type, f.action.rationale) for f in group],
        "seq int, column string, action_type string, rationale string",
    )
    cells = [f for f in group if f.action.action_type not in ("drop_rows", "drop_column")]

    def side(df: DataFrame, name: str) -> DataFrame:
        return column_stats(df, names).select(
            "column",
            F.col("n_rows").alias(f"rows_{name}"),
            *[F.col(s).alias(f"{name}_{s}") for s in STAT_FIELDS],
        )

    def snapshot(name: str):
        fields = [F.col(f"{name}_{s}").alias(s) for s in STAT_FIELDS]
        return F.struct(*fields).alias(f"{name}_stat")

    out = head.join(side(before, "before"), "column").join(side(after, "after"), "column")
    if cells:
        out = out.join(_cells_changed(before, cells), "seq", "left")
    else:
        out = out.withColumn("cells_changed", F.lit(None).cast("bigint"))
    lost = F.abs(F.col("before_missing_count") - F.col("after_missing_count"))
    affected = (
        F.when(F.col("action_type") == "drop_rows", F.col("rows_before") - F.col("rows_after"))
        .when(F.col("action_type") == "drop_column", F.col("rows_before"))
        .otherwise(lost)
    )
    return out.select(
        "seq",
        "column",
        "action_type",
        "rationale",
        affected.alias("rows_affected"),
        F.coalesce("cells_changed", affected).alias("cells_changed"),
        snapshot("before"),
        snapshot("after"),
    )


def apply_plan(
    df: DataFrame, actions: Sequence[Action], order_by: str | None = None
) -> PlanResult:
    """Apply the approved actions in order.

    Neighbouring actions on different columns are fused: they are fitted, applied and measured
    together. Dropping rows changes what later actions see, so it stands alone, as does a second
    action on the same column. An action that cannot run is recorded and skipped; the others go
    on.
    """
    df = normalise_missing(df)
    spark = df.sparkSession
    current = df
    group: list[Action] = []
    applied: list[Action] = []
    skipped: list[tuple[Action, str, str]] = []
    diffs: list[DataFrame] = []

    def flush() -> None:
        nonlocal current, group
        if not group:
            return
        fitted = fit(current, group, order_by)
        after = apply_fitted(current, fitted)
        diffs.append(_group_diff(current, after, fitted))
        applied.extend(group)
        current, group = after, []

    for action in numbered(actions):
        if action.action_type == "no_action":
            skipped.append((action, "skipped_no_action", ""))
            continue
        alone = action.action_type == "drop_rows"
        if alone or any(a.column == action.column for a in group):
            flush()
        try:
            check(action, classes(current))
        except ValueError as problem:
            skipped.append((action, "skipped_failed_action", str(problem)))
            continue
        group.append(action)
        if alone:
            flush()
    flush()
    diff = reduce(DataFrame.unionByName, diffs) if diffs else spark.createDataFrame([], DIFF_DDL)
    return PlanResult(current, diff, applied, skipped)

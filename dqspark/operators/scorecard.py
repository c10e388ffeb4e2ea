"""Totals per run over the stored check, diff and audit tables of all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ["verified", "flagged", "failed"]


def scorecard(checks: DataFrame, diffs: DataFrame, audit: DataFrame) -> DataFrame:
    """One row per ``run_id``: charts by status, actions applied, log entries.

    Each table is reduced to one row per run before they meet.
    """
    charts = checks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_charts"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_charts") for s in STATUSES],
    )
    actions = diffs.groupBy("run_id").agg(F.count(F.lit(1)).alias("cleaning_actions_applied"))
    entries = audit.groupBy("run_id").agg(F.count(F.lit(1)).alias("audit_log_entries"))
    numbers = ["total_charts", *[f"{s}_charts" for s in STATUSES]]
    numbers += ["cleaning_actions_applied", "audit_log_entries"]
    return (
        charts.join(actions, "run_id", "full_outer")
        .join(entries, "run_id", "full_outer")
        .select("run_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])
    )

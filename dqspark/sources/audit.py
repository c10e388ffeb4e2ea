"""The append-only audit trail, as a table partitioned by run."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqspark.plans.executor import PlanResult
from dqspark.types import ref

AUDIT_DDL = (
    "run_id string, seq bigint, ts timestamp, stage string, actor string, action string, detail string"
)
ACTORS = ["llm", "code"]  # fixed values: a proposal comes from a model, all else from code


def log_entries(
    spark: SparkSession, run_id: str, entries: Sequence[tuple[str, str, str, dict]], start: int = 0
) -> DataFrame:
    """Audit rows from ``(stage, actor, action, detail)``, numbered from ``start``, stamped now."""
    for _, actor, _, _ in entries:
        if actor not in ACTORS:
            raise ValueError(f"unknown actor {actor!r}")
    rows = [
        (run_id, start + i, stage, actor, action, json.dumps(detail, sort_keys=True, default=str))
        for i, (stage, actor, action, detail) in enumerate(entries)
    ]
    ddl = "run_id string, seq bigint, stage string, actor string, action string, detail string"
    return spark.createDataFrame(rows, ddl).select(
        "run_id", "seq", F.current_timestamp().alias("ts"), "stage", "actor", "action", "detail"
    )


def plan_log(result: PlanResult, run_id: str) -> DataFrame:
    """One audit row per planned action: executed with its effect, or skipped with the reason."""
    spark = result.df.sparkSession
    done = result.diff.select(
        F.lit(run_id).alias("run_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"),
        F.lit("cleaning_exec").alias("stage"),
        F.lit("code").alias("actor"),
        F.concat(F.lit("executed_"), F.col("action_type")).alias("action"),
        F.to_json(F.struct("column", "rationale", "rows_affected")).alias("detail"),
    )
    left_out = [
        (
            run_id,
            a.seq,
            "cleaning_exec",
            "code",
            outcome,
            json.dumps({"action_type": a.action_type, "column": a.column, "error": error}),
        )
        for a, outcome, error in result.skipped
    ]
    ddl = "run_id string, seq bigint, stage string, actor string, action string, detail string"
    skipped = spark.createDataFrame(left_out, ddl).withColumn("ts", F.current_timestamp())
    return done.unionByName(skipped)


def _logged(rows: DataFrame, stage: str, run_id: Column, seq: Column, actor: Column, action: Column, detail: list[str]) -> DataFrame:
    return rows.select(
        run_id.cast("string").alias("run_id"),
        seq.cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"),
        F.lit(stage).alias("stage"),
        actor.alias("actor"),
        action.alias("action"),
        F.to_json(F.struct(*[ref(c) for c in detail])).alias("detail"),
    )


def vetting_log(vetted: DataFrame, stage: str) -> DataFrame:
    """One audit row per vetted proposal (of plans or intents), with its data set as the run: proposed by the
    model, or rejected by code with the reason as the action."""
    rejected = F.col("reason").isNotNull()
    told = [c for c in vetted.columns if c not in ("dataset_id", "seq")]
    return _logged(
        vetted, stage, F.col("dataset_id"), F.col("seq"),
        F.when(rejected, "code").otherwise("llm"), F.coalesce("reason", F.lit("proposed")), told,
    )


def profile_log(profiled: DataFrame, run_id: str) -> DataFrame:
    """One audit row per profiled column, in the order of the columns."""
    told = ["column", "n_rows", "missing_pct", "n_unique", "iqr_outlier_count"]
    return _logged(
        profiled, "profiling", F.lit(run_id), F.col("position"), F.lit("code"), F.lit("profiled_column"), told
    )


def check_log(checks: DataFrame, run_id: str) -> DataFrame:
    """One audit row per checked chart, in the order of the charts' names."""
    seq = F.row_number().over(Window.orderBy("chart_id"))  # a report has a handful of charts
    action = F.concat(F.lit("check_"), "status")
    return _logged(checks, "self_check", F.lit(run_id), seq, F.lit("code"), action, ["chart_id", "chart_type", "notes"])


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to the trail; nothing already written is touched.

    The entries of a run are written together, a file for each million of them.
    """
    together = entries.repartition(F.col("run_id"), F.floor(F.col("seq") / 1_000_000))
    together.write.mode("append").partitionBy("run_id").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The trail; a filter on ``run_id`` prunes partitions. Order by ``run_id, seq`` to read it."""
    return spark.read.schema(AUDIT_DDL).parquet(path)


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All entries of all logs, repeats included."""
    merged = logs[0]
    for log in logs[1:]:
        merged = merged.unionByName(log)
    return merged

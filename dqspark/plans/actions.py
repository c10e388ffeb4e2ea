"""Cleaning plans and chart intents as data: their enums, their rules, and how rows are vetted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.types import CATEGORICAL, DATETIME, NUMERIC

# The actions a plan may name, and the charts an intent may name.
ACTION_TYPES = [
    "impute_mean",
    "impute_median",
    "impute_mode",
    "drop_rows",
    "drop_column",
    "standardize_categories",
    "parse_dates",
    "cap_outliers",
    "no_action",
]
CHART_TYPES = ["histogram", "box", "bar", "line", "scatter", "heatmap", "pie"]

PARAMS = "struct<fuzzy_threshold:double,format:string,cap_percentile:double>"
PLAN_DDL = f"seq int, column string, action_type string, rationale string, params {PARAMS}"
INTENT_DDL = (
    "seq int, chart_type string, columns array<string>, rationale string, "
    "priority_score double, category string"
)

# Least number of columns, classes allowed by position, and whether the last one goes on for all.
CHART_RULES: dict[str, tuple[int, list[tuple[str, ...]], bool]] = {
    "histogram": (1, [(NUMERIC,)], False),
    "box": (1, [(NUMERIC,)], False),
    "bar": (1, [(CATEGORICAL,)], False),
    "line": (2, [(NUMERIC, DATETIME, CATEGORICAL), (NUMERIC,)], False),
    "scatter": (2, [(NUMERIC,), (NUMERIC,)], False),
    "heatmap": (2, [(NUMERIC,)], True),
    "pie": (1, [(CATEGORICAL,)], False),
}


@dataclass(frozen=True)
class Action:
    """One step of a cleaning plan."""

    column: str
    action_type: str
    rationale: str = ""
    params: Mapping[str, object] = field(default_factory=dict)
    seq: int = 0

    def __post_init__(self) -> None:
        if self.action_type not in ACTION_TYPES:
            raise ValueError(f"unknown action type {self.action_type!r}")


@dataclass(frozen=True)
class Intent:
    """One wanted chart. ``mean`` says of a line that it shows one averaged point for each x."""

    chart_type: str
    columns: tuple[str, ...]
    category: str = ""
    priority_score: float = 0.0
    rationale: str = ""
    mean: bool = False

    def __post_init__(self) -> None:
        if self.chart_type not in CHART_TYPES:
            raise ValueError(f"unknown chart type {self.chart_type!r}")
        if not 0 <= self.priority_score <= 5:
            raise ValueError("priority_score must be between 0 and 5")
        object.__setattr__(self, "columns", tuple(self.columns))


def numbered(actions: Iterable[Action]) -> list[Action]:
    """The actions in order, with ``seq`` counted from 1."""
    return [
        Action(a.column, a.action_type, a.rationale, dict(a.params), i)
        for i, a in enumerate(actions, 1)
    ]


def read_plan(plan: DataFrame, dataset_id: str | None = None) -> list[Action]:
    """A vetted plan table as actions, those of one dataset where the table holds plans of many.

    The plan of one dataset has a handful of rows: it is read by the driver.
    """
    if "dataset_id" in plan.columns:
        if dataset_id is None:
            held = [r[0] for r in plan.select("dataset_id").distinct().limit(2).collect()]
            if len(held) > 1:
                raise ValueError("the plan table holds plans of many datasets: name one")
            dataset_id = held[0] if held else None
        plan = plan.where(F.col("dataset_id") == dataset_id)
    rows = plan.orderBy("seq").collect()
    return [
        Action(
            r["column"],
            r["action_type"],
            r["rationale"] or "",
            {k: v for k, v in (r["params"].asDict() if r["params"] else {}).items() if v is not None},
            r["seq"],
        )
        for r in rows
    ]


def approved(plan: DataFrame, rejected: DataFrame) -> DataFrame:
    """The plan without the actions turned down, named by ``seq``, and by ``dataset_id`` where both have one."""
    keys = [k for k in ("dataset_id", "seq") if k in plan.columns and k in rejected.columns]
    return plan.join(rejected.select(*keys), keys, "left_anti")


def chart_problem(chart_type: str, columns: list[str], kinds: Mapping[str, str]) -> str | None:
    """Why a chart cannot be made of these columns; ``None`` if it can. Needs the schema only."""
    missing = [c for c in columns if c not in kinds]
    if missing:
        return f"columns not found: {missing}"
    least, allowed, repeat = CHART_RULES[chart_type]
    if len(columns) < least:
        return f"{chart_type} needs at least {least} column(s), got {len(columns)}"
    checked = columns if repeat else columns[: len(allowed)]
    for i, c in enumerate(checked):
        wanted = allowed[min(i, len(allowed) - 1)]
        if kinds[c] not in wanted:
            return f"{chart_type} needs {' or '.join(wanted)} for {c!r}, got {kinds[c]}"
    return None


def _blank(name: str) -> Column:
    return F.col(name).isNull()


# Codes of rejected rows.
INVALID_ACTION, NO_SUCH_COLUMN = "rejected_invalid_action", "rejected_nonexistent_column"
INVALID_INTENT, NO_SUCH_COLUMNS = "rejected_invalid_intent", "rejected_nonexistent_columns"
WRONG_TYPES = "rejected_dtype_incompatible"


def vet_plan(plan: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A plan table with a ``reason`` column: NULL for accepted rows.

    ``catalogue`` holds ``(dataset_id, column)`` rows; plans of many datasets are vetted at once.
    """
    known = catalogue.select("dataset_id", "column").distinct().withColumn("known", F.lit(True))
    invalid = (
        _blank("column")
        | _blank("rationale")
        | ~F.coalesce(F.col("action_type").isin(ACTION_TYPES), F.lit(False))
    )
    return plan.join(known, ["dataset_id", "column"], "left").select(
        *plan.columns,
        F.when(invalid, INVALID_ACTION)
        .when(F.col("known").isNull(), NO_SUCH_COLUMN)
        .alias("reason"),
    )


def _fits(kinds: Column, columns: Column, chart_type: Column) -> Column:
    """The chart rules over a map of column classes, as one expression."""

    def allowed_class(c: Column, wanted: tuple[str, ...]) -> Column:
        return F.try_element_at(kinds, c).isin(*wanted)

    def all_allowed(wanted: tuple[str, ...]) -> Column:
        return F.forall(columns, lambda c: allowed_class(c, wanted))

    result = F.lit(False)
    for chart, (least, allowed, repeat) in CHART_RULES.items():
        ok = F.size(columns) >= least
        if repeat:
            ok &= all_allowed(allowed[0])
        else:
            for i, wanted in enumerate(allowed):
                ok &= allowed_class(F.get(columns, i), wanted)
        result = F.when(chart_type == chart, F.coalesce(ok, F.lit(False))).otherwise(result)
    return result


def vet_intents(intents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """An intent table with a ``reason`` column: NULL for accepted rows.

    ``catalogue`` holds ``(dataset_id, column, class)`` rows; of a column listed with several classes
    the first by name counts.
    """
    columns = catalogue.groupBy("dataset_id", "column").agg(F.min("class").alias("class"))
    kinds = columns.groupBy("dataset_id").agg(
        F.map_from_entries(F.collect_set(F.struct("column", "class"))).alias("kinds")
    )
    in_range = F.coalesce(F.col("priority_score").between(0, 5), F.lit(False))
    invalid = (
        ~F.coalesce(F.col("chart_type").isin(CHART_TYPES), F.lit(False))
        | _blank("columns")
        | _blank("rationale")
        | _blank("category")
        | ~in_range
    )
    lost = F.exists(
        "columns", lambda c: F.try_element_at(F.col("kinds"), c).isNull()
    ) | F.col("kinds").isNull()
    return intents.join(kinds, "dataset_id", "left").select(
        *intents.columns,
        F.when(invalid, INVALID_INTENT)
        .when(lost, NO_SUCH_COLUMNS)
        .when(
            ~_fits(F.col("kinds"), F.col("columns"), F.col("chart_type")),
            WRONG_TYPES,
        )
        .alias("reason"),
    )

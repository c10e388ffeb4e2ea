"""The cleaning actions.

Each action is fitted, then applied. Fitting reads the column and comes back with a few numbers
(a mean, two bounds, a mode) or with a mapping table; applying is a projection with these as
literals, so a cleaned table stays one narrow plan over its source however long the plan of
actions is. Actions on different columns that follow each other are fitted together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.dates import CANDIDATE_FORMATS, parse_date, spark_pattern
from dqspark.functions.text import clean_label
from dqspark.lineage import cut
from dqspark.operators.frequency import frequency_table, modes_of
from dqspark.operators.profile import date_rates, fences
from dqspark.operators.quantiles import column_quantiles
from dqspark.operators.similarity import DEFAULT_THRESHOLD, label_mapping
from dqspark.plans.actions import Action
from dqspark.types import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    OTHER,
    ColumnNotFound,
    IncompatibleColumn,
    classes,
    normalise_missing,
    ref,
    require,
)

@dataclass
class Fitted:
    """What an action needs to know about the data before it can be applied."""

    action: Action
    value: float | str | None = None
    bounds: tuple[float, float] | None = None
    mapping: DataFrame | None = None


def check(action: Action, kinds: dict[str, str]) -> None:
    """Raise what can be known to fail from the schema and the parameters."""
    if action.action_type == "no_action":
        return
    if action.column not in kinds:
        raise ColumnNotFound(f"column {action.column!r} is not in the table (any more)")
    kind, params = kinds[action.column], action.params
    for name, types in (("cap_percentile", (int, float)), ("fuzzy_threshold", (int, float)), ("format", (str,))):
        value = params.get(name)
        if value is not None and (not isinstance(value, types) or isinstance(value, bool)):
            raise ValueError(f"{name} has the wrong type: {value!r}")
    if action.action_type == "parse_dates":
        if kind not in (CATEGORICAL, DATETIME):
            raise IncompatibleColumn(f"cannot parse {kind} column {action.column!r} as dates")
        if params.get("format") is not None:
            spark_pattern(params["format"])
    if action.action_type in ("impute_mode", "standardize_categories") and kind == OTHER:
        raise IncompatibleColumn(f"{action.action_type} cannot work on {action.column!r}")
    p = params.get("cap_percentile")
    if action.action_type == "cap_outliers" and p is not None and not 0.5 < p <= 1:
        raise ValueError("cap_percentile must be above 0.5 and at most 1")
    t = params.get("fuzzy_threshold")
    if action.action_type == "standardize_categories" and t is not None and not 0 < t <= 1:
        raise ValueError("fuzzy_threshold must be above 0 and at most 1")


def _probs(action: Action) -> list[float]:
    if action.action_type == "impute_median":
        return [0.5]
    p = action.params.get("cap_percentile")
    return [0.25, 0.75] if p is None else [1 - p, p]


def fit(df: DataFrame, actions: Sequence[Action], order_by: str | None = None) -> list[Fitted]:
    """Fit actions on pairwise different columns: one pass for means, one set for quantiles.

    Here and below the table must be free of NaN (see ``normalise_missing``).
    """
    kinds = classes(df)
    fitted = {a.seq: Fitted(a) for a in actions}
    numeric = [a for a in actions if kinds.get(a.column) == NUMERIC]

    means = [a for a in numeric if a.action_type == "impute_mean"]
    if means:
        row = df.agg(*[F.avg(ref(a.column).cast("double")) for a in means]).first()
        for a, value in zip(means, row):
            fitted[a.seq].value = value

    ranked = [a for a in numeric if a.action_type in ("impute_median", "cap_outliers")]
    if ranked:
        probs = sorted({p for a in ranked for p in _probs(a)})
        quantiles = column_quantiles(df, [a.column for a in ranked], probs)
        for a in ranked:
            found = quantiles[a.column]
            if found is None:
                continue
            at = [found[probs.index(p)] for p in _probs(a)]
            if a.action_type == "impute_median":
                fitted[a.seq].value = at[0]
            else:
                capped = a.params.get("cap_percentile") is not None
                fitted[a.seq].bounds = tuple(at) if capped else fences(*at)

    filled = [a for a in actions if a.action_type == "impute_mode"]
    if filled:
        modes = modes_of(df, [a.column for a in filled])
        for a in filled:
            fitted[a.seq].value = modes[a.column]

    for a in actions:
        if a.action_type == "standardize_categories":
            t = a.params.get("fuzzy_threshold")
            mapping = cut(
                label_mapping(df, a.column, DEFAULT_THRESHOLD if t is None else t, order_by)
            )
            fitted[a.seq].mapping = mapping

    undated = [
        a
        for a in actions
        if a.action_type == "parse_dates" and kinds[a.column] == CATEGORICAL
    ]
    guess = [a.column for a in undated if a.params.get("format") is None]
    best = {}
    if guess:
        best = {r["column"]: r["date_format"] for r in date_rates(frequency_table(df, guess)).collect()}
    for a in undated:
        fitted[a.seq].value = a.params.get("format") or best.get(a.column, CANDIDATE_FORMATS[0])
    return list(fitted.values())


def _new_value(df: DataFrame, f: Fitted, mapped: Column | None) -> Column:
    """The cell after the action, as an expression over the row before it."""
    a, c = f.action, ref(f.action.column)
    kind = classes(df)[a.column]
    if a.action_type in ("impute_mean", "impute_median"):
        return F.coalesce(c.cast("double"), F.lit(f.value).cast("double")) if kind == NUMERIC else c
    if a.action_type == "impute_mode":
        return c if f.value is None else F.coalesce(c, f.value)
    if a.action_type == "cap_outliers":
        if kind != NUMERIC:
            return c
        x = c.cast("double")
        if f.bounds is None:
            return x
        # greatest and least pass over NULL, which would turn a missing cell into a bound.
        return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(f.bounds[1])), F.lit(f.bounds[0])))
    if a.action_type == "parse_dates":
        return parse_date(c, f.value) if kind == CATEGORICAL else c
    if a.action_type == "standardize_categories":
        return F.coalesce(mapped, clean_label(c))
    return c


def changed(df: DataFrame, fitted: Sequence[Fitted], keep_old: bool = False) -> DataFrame:
    """Apply fitted actions that change cells, in one projection.

    With ``keep_old`` the value before comes along as ``old_<seq>``, for counting changes.
    """
    names = list(df.columns)
    news, olds = {}, []
    wide = df
    for f in fitted:
        a, mapped = f.action, None
        if f.mapping is not None:
            label, to = f"label_{a.seq}", f"canonical_{a.seq}"
            side = f.mapping.select(F.col("label").alias(label), F.col("canonical").alias(to))
            wide = wide.join(side, clean_label(ref(a.column)) == F.col(label), "left")
            mapped = F.col(to)
        news[a.column] = _new_value(df, f, mapped)
        olds.append(ref(a.column).alias(f"old_{a.seq}"))
    return wide.select(
        *[news.get(n, ref(n)).alias(n) for n in names], *(olds if keep_old else [])
    )


def drop_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in the column."""
    require(df, column)
    return df.where(ref(column).isNotNull())


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.select(*[ref(c) for c in df.columns if c != column])


def apply_fitted(df: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    cells = [f for f in fitted if f.action.action_type not in ("drop_rows", "drop_column", "no_action")]
    out = changed(df, cells) if cells else df
    for f in fitted:
        if f.action.action_type == "drop_column":
            out = drop_column(out, f.action.column)
        elif f.action.action_type == "drop_rows":
            out = drop_rows(out, f.action.column)
    return out


def clean(
    df: DataFrame, column: str, action_type: str, order_by: str | None = None, **params
) -> DataFrame:
    """Run a single action: ``clean(df, "age", "impute_median")``."""
    action = Action(column, action_type, params=params)
    check(action, classes(df))
    if action_type == "no_action":
        return df
    df = normalise_missing(df)
    return apply_fitted(df, fit(df, [action], order_by))

"""Column classes and the missing-value rule shared by every operator."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


class ColumnNotFound(ValueError):
    """An operator was pointed at a column the DataFrame does not have."""


class IncompatibleColumn(ValueError):
    """An operator was pointed at columns of a class it cannot work on."""


def class_of(data_type: T.DataType) -> str:
    """Map a Spark type to the class that operators dispatch on."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def classes(df: DataFrame) -> dict[str, str]:
    """Column name -> class, read from the schema alone (no job)."""
    return {f.name: class_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [f.name for f in df.schema.fields if class_of(f.dataType) in wanted]


def quoted(name: str) -> str:
    """A literal column name, dots and backticks included, for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def double_literal(x: float) -> str:
    """A double as SQL text, every bit of it."""
    if math.isinf(x):
        return f"double('{'-' if x < 0 else ''}Infinity')"
    return f"({float(x)!r}D)"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """A column by its literal name."""
    return F.col(quoted(name))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnNotFound(f"columns not found: {missing}")


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float columns, so NULL is the only missing value."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.nanvl(ref(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def melt(df: DataFrame, columns: Iterable[str], as_type: str) -> DataFrame:
    """``(column, value)`` rows of the given columns, missing cells (NULL, NaN) left out."""
    cast = df.select(*[ref(c).cast(as_type).alias(c) for c in columns])
    rows = cast.unpivot([], [ref(c) for c in cast.columns], "column", "value")
    present = F.col("value").isNotNull()
    return rows.where(present & ~F.isnan("value") if as_type == "double" else present)


def chunks(items: list, size: int) -> Iterable[list]:
    """Slices of a column list: wide aggregates outgrow whole-stage codegen."""
    for start in range(0, len(items), size):
        yield items[start : start + size]

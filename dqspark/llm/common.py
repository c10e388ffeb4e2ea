"""Helpers that several operators share: words, keys of rows, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.lineage import scratch_path

#: What separates words: space and the characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A character that belongs to a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_of(text: Column, kept: str) -> Column:
    """How many characters of a text belong to a character class given by its content."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def row_keys(df: DataFrame, columns: Iterable[str]) -> list[Column]:
    """Two hashes that stand for the given cells of a row, never NULL; equal rows share them."""
    cells = [F.coalesce(df[c].cast("string"), F.lit("\x00")) for c in columns]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("k"), *reversed(cells))]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back; later steps start from its files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, for functions that run there."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="dqspark-code-"), "dqspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)  # served by the driver
    SHIPPED.add(context.applicationId)

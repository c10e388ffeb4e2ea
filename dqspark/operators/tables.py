"""Keyed reductions: best row per key, latest row per key, and row conformance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.lineage import cut
from dqspark.types import normalise_missing, ref, require

MIN_SCORE = 2.5  # fixed value: rows scored below this are not kept
BROADCAST_PARTITIONS = 100_000  # names of partitions sent to every task, else joined by key


def keep_best(
    df: DataFrame,
    keys: Sequence[Column | str],
    score: str,
    seq: str,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """The best-scored row per key, the first one on ties, best scores first.

    Equal scores keep the order in which their keys first appeared. A maximum is taken instead of
    ranking rows in a window, so a hot key is reduced before the shuffle. A NaN score counts as
    missing, and a missing score is never kept. An array key that stands for a set is passed as
    ``array_sort(array_distinct(c))``.
    """
    require(df, score, seq)
    kept = normalise_missing(df).where(ref(score) >= min_score)
    named = [(ref(k) if isinstance(k, str) else k).alias(f"key{i}") for i, k in enumerate(keys)]
    row = F.struct(*[ref(c) for c in df.columns])
    best = kept.groupBy(*named).agg(
        F.max_by(row, F.struct(ref(score), -ref(seq))).alias("row"), F.min(ref(seq)).alias("first_seq")
    )
    return (
        best.select("row.*", "first_seq").orderBy(ref(score).desc(), "first_seq").drop("first_seq")
    )


def upsert_latest(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str
) -> DataFrame:
    """Existing rows, replaced by incoming ones of equal key; new keys are added.

    Among incoming rows of one key the last one (by ``seq``) wins. ``first_seq`` keeps the place
    where the key first appeared; incoming rows come after all existing ones.
    """
    require(existing, *keys, seq)
    both = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    row = F.struct(*[ref(c) for c in existing.columns])
    at = F.struct("side", ref(seq))
    merged = both.groupBy(*[ref(k) for k in keys]).agg(
        F.max_by(row, at).alias("row"), F.min(at).alias("first")
    )
    return merged.select(
        "row.*", F.col("first.side").alias("first_side"), F.col(f"first.{seq}").alias("first_seq")
    )


@dataclass(frozen=True)
class Rule:
    """One conformance rule. ``kind`` is ``required``, ``one_of``, ``between`` or ``exists``."""

    kind: str
    column: str
    reason: str
    values: tuple = ()
    low: object = None
    high: object = None
    reference: DataFrame | None = None
    reference_column: str = ""


def required(column: str, reason: str) -> Rule:
    return Rule("required", column, reason)


def one_of(column: str, values: Sequence, reason: str) -> Rule:
    return Rule("one_of", column, reason, values=tuple(values))


def between(column: str, low, high, reason: str) -> Rule:
    return Rule("between", column, reason, low=low, high=high)


def exists_in(column: str, reference: DataFrame, reference_column: str, reason: str) -> Rule:
    return Rule("exists", column, reason, reference=reference, reference_column=reference_column)


def conformance(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The table with ``reasons``, the codes of all broken rules in rule order (empty: accepted).

    All rules are tested in one projection; a reference list costs one join on its distinct keys,
    broadcast or shuffled as its size at run time demands. A missing value (NaN too) breaks every rule but
    ``exists``, which it breaks too unless the reference holds NULL keys; both count as missing.
    """
    require(df, *[r.column for r in rules])
    marked = [f for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    real = {f.name: F.when(~F.isnan(ref(f.name)), ref(f.name)) for f in marked}
    wide, tests = df, []
    for i, r in enumerate(rules):
        c = real.get(r.column, ref(r.column))
        if r.kind == "required":
            ok = c.isNotNull()
        elif r.kind == "one_of":
            ok = F.coalesce(c.isin(*r.values), F.lit(False))
        elif r.kind == "between":
            ok = F.coalesce(c.between(r.low, r.high), F.lit(False))
        elif r.kind == "exists":
            known = (
                r.reference.select(ref(r.reference_column).alias(f"ref_{i}"))
                .where(F.col(f"ref_{i}").isNotNull())
                .distinct()
            )
            wide = wide.join(known, c == F.col(f"ref_{i}"), "left")
            ok = F.col(f"ref_{i}").isNotNull()
        else:
            raise ValueError(f"unknown rule kind {r.kind!r}")
        tests.append(F.when(~ok, F.lit(r.reason)))
    return wide.select(
        *[ref(c) for c in df.columns], F.array_compact(F.array(*tests)).alias("reasons")
    )


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: rows that break no rule, and the others with their reasons."""
    marked = conformance(df, rules)
    accepted = marked.where(F.size("reasons") == 0).drop("reasons")
    return accepted, marked.where(F.size("reasons") > 0)


def accepted_by_reference(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose value the reference knows (semi join)."""
    return df.join(reference.select(ref(key).alias(column)), column, "left_semi")


def rejected_by_reference(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose value the reference does not know (anti join)."""
    return df.join(reference.select(ref(key).alias(column)), column, "left_anti")


def sort_by(df: DataFrame, column: str) -> DataFrame:
    """Ascending, missing values last."""
    require(df, column)
    return df.orderBy(ref(column).asc_nulls_last())


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in an order, as a sample to look at: a distributed top-n, not a sort."""
    require(df, *order)
    return df.orderBy(*[ref(c).asc_nulls_last() for c in order]).limit(n)


def upsert_stored(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], seq: str, partition: str) -> int:
    """Upsert rows into a Parquet table stored by a partition column; gives the number of partitions rewritten.

    Only partitions that incoming rows fall into are read, merged and replaced, by a dynamic overwrite
    after the merged rows have been written elsewhere in full; files of other partitions are not touched. A key must stay in
    its partition. Among incoming rows of one key the last (by ``seq``) wins, and new keys are added.
    """
    require(incoming, *keys, seq, partition)
    schema = spark.read.parquet(path).schema  # from the table's footers and folder names
    stored = spark.read.schema(schema).parquet(path)
    require(stored, *keys, seq, partition)
    incoming = cut(incoming.select(*[ref(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
    touched = incoming.select(ref(partition).alias("touched")).distinct()
    same = ref(partition).eqNullSafe(F.col("touched"))
    existing = stored.join(F.broadcast(touched) if touched.count() <= BROADCAST_PARTITIONS else touched, same, "left_semi")
    merged = cut(upsert_latest(existing, incoming, keys, seq).select(*[ref(c) for c in schema.names]))
    # a large partition is split among tasks, small ones share one
    merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return merged.select(ref(partition)).distinct().count()

"""The most frequent labels without a full count: summaries first, then an exact count of the candidates.

Every task keeps a Misra-Gries summary of a column: ``ROOM`` counters at most, each at most as high as the label's true
count there, and never lower by more than what the task has written off. Summaries add up (Agarwal et al.,
2012): a label's true count lies between its sum and that sum plus all that was written off. Where the k-th sum is higher
than that error, labels in no summary cannot be among the first k, and a second scan counts the candidates alone. Where
nothing was written off, the sums are the counts. Only where neither holds is every label counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.lineage import cut
from dqspark.operators.frequency import TOP_LABELS, frequency_table, top_values
from dqspark.types import melt, ref, require

ROOM = 1_000


def summaries(df: DataFrame, columns: Sequence[str], room: int = ROOM) -> DataFrame:
    """``(column, value, low, lost)``: the counters of every task, and a row with NULL for what it wrote off."""
    names = list(columns)

    def reduced(held: dict[str, int]) -> tuple[dict[str, int], int]:
        less = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), len(held) - room - 1)[len(held) - room - 1])
        return {v: n - less for v, n in held.items() if n > less}, less

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in names]
        lost = [0] * len(names)
        for batch in batches:
            for k, column in enumerate(batch.columns):
                found = pc.value_counts(column.drop_null())
                own = held[k]
                for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    own[value] = own.get(value, 0) + n
                if len(own) > room:
                    held[k], less = reduced(own)
                    lost[k] += less
        for name, own, less in zip(names, held, lost):
            if own or less:
                n = len(own)
                columns_ = [[name] * (n + 1), [*own, None], [*own.values(), 0], [0] * n + [less]]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(columns_, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["column", "value", "low", "lost"])

    cells = df.select(*[ref(c).cast("string").alias(f"c{k}") for k, c in enumerate(names)])
    return cells.mapInArrow(scanned, "column string, value string, low bigint, lost bigint")


def frequent_values(df: DataFrame, columns: Sequence[str], k: int = TOP_LABELS, room: int = ROOM) -> DataFrame:
    """``(column, value, n, place)``, exactly the rows of ``top_values`` over the frequency table of these columns."""
    require(df, *columns)
    if k > room:
        raise ValueError("a summary must have room for more labels than are asked for")
    found = summaries(df, columns, room)
    found = cut(found.groupBy("column", "value").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost")))
    labels = found.where("value IS NOT NULL").select("column", "value", F.col("low").alias("n"))
    # two numbers per column
    lost = {r["column"]: r["lost"] for r in found.where("value IS NULL").collect()}
    floor = {r["column"]: r["n"] for r in top_values(labels, k).where(F.col("place") == k).collect()}
    whole = [c for c in columns if lost.get(c) == 0]
    proven = [c for c in columns if lost.get(c) and floor.get(c, 0) > lost[c]]
    open_ = [c for c in columns if lost.get(c) and c not in proven]
    parts = [labels.where(F.col("column").isin(whole))]
    if proven:
        least = F.coalesce(*[F.when(F.col("column") == c, F.lit(floor[c] - lost[c])) for c in proven])
        candidates = labels.where(F.col("column").isin(proven)).where(F.col("n") >= least).select("column", "value")
        again = melt(df, proven, "string").join(candidates, ["column", "value"], "left_semi")
        parts.append(again.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    if open_:
        parts.append(frequency_table(df, open_))
    return top_values(reduce(DataFrame.unionByName, parts), k)
